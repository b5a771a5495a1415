"""Centroid clustering by sort-means over exact integers.

Every component becomes an integer, floor(scale x).  A round knows the distances between all centroids, and for each centroid the
order of the others by their distance from it.  A vector starts with the centroid that it had in the round before and walks that
centroid's order: what is more than twice as far from it as the vector is, is farther from the vector too, so the walk ends
strictly beyond twice the current distance (a centroid exactly twice as far may tie and is looked at).  Distances are squared
integers, so twice is a factor of four, and no bound is lost to rounding.

Spark deals the vectors: each round reads the table of the round before (vec_id, values, cluster), writes the next one in the shared folder and
deletes the one that nothing reads any more.  Sums are made by task and centroid before they are shuffled, so a centroid that holds
nearly all vectors sends one row from each task.  Only centroids pass through the driver: `clusters` rows of `dims` numbers, both parameters.

Defined cases: vectors that are null, of another length than `dims`, or that hold a null or non-finite component take no part and
are not returned; repeated rows and equal vectors each take part, equal centroids are kept apart and the smaller number wins; starts of equal hash
follow their components; a null vec_id takes part (its decimal is empty) and is returned as null; with fewer vectors than centroids there are
as many centroids as vectors; an empty table gives no rows; other columns are ignored, whatever their names.  Components so large that four times a squared distance
could leave 63 bits (beyond 94,906,265 for 64 dimensions) end the job by an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

DIMS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64


def quantised(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and values of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where((F.size("embedding") == dims) & finite)
    largest = math.isqrt(((1 << 63) - 1) // (16 * dims))
    large = F.raise_error(F.lit(f"a component is beyond {largest} after scaling"))

    def whole(x):
        scaled = F.floor(x * F.lit(float(scale)))
        return F.when(F.abs(x * F.lit(float(scale))) <= largest, scaled).otherwise(large.cast("long")).cast("int")

    return rows.select("vec_id", F.transform("embedding", whole).alias("values"))


def starts(rows: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, by hash."""
    of = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(of.alias("hash"), "values").orderBy("hash", "values").limit(clusters).collect()
    return np.array([r["values"] for r in first], dtype=np.int64)


def between(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all centroids, and for each the others by distance (equal ones by number)."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    own = np.arange(len(centroids))[:, None]
    return apart, order[order != own].reshape(len(centroids), -1)


def nearest(values: np.ndarray, before: np.ndarray, centroids: np.ndarray, apart: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row (smaller number on ties), and the count of distances made."""
    cluster, distance, made = before.copy(), np.empty(len(values), dtype=np.int64), 0
    for at in np.unique(before):
        rows = np.flatnonzero(before == at)
        here = ((values[rows] - centroids[at]) ** 2).sum(axis=1)
        made += len(rows)
        best, number = here.copy(), np.full(len(rows), at)
        walking = np.arange(len(rows))
        for other in order[at]:
            walking = walking[apart[at, other] <= 4 * here[walking]]
            if not len(walking):
                break
            there = ((values[rows[walking]] - centroids[other]) ** 2).sum(axis=1)
            made += len(walking)
            better = (there < best[walking]) | ((there == best[walking]) & (other < number[walking]))
            won = walking[better]
            best[won], number[won] = there[better], other
        cluster[rows], distance[rows] = number, best
    return cluster, distance, made


def matrix(values: pa.Array, dims: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assigned(rows: DataFrame, centroids: np.ndarray, dims: int = DIMS) -> DataFrame:
    """rows (vec_id, values, cluster: the one before) with the nearest centroid and its squared distance."""
    apart, order = between(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                before = batch.column("cluster").to_numpy().astype(np.int64)
                cluster, distance, _ = nearest(matrix(batch.column("values"), dims), before, centroids, apart, order)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("values"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "values", "cluster", "distance"])

    return rows.select("vec_id", "values", "cluster").mapInArrow(assign, "vec_id long, values array<int>, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without vectors stays."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), dims), dtype=np.int64)
        counts = np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column("cluster").to_numpy()
                np.add.at(sums, cluster, matrix(batch.column("values"), dims))
                counts += np.bincount(cluster, minlength=len(centroids))
        held = np.flatnonzero(counts)
        place = np.tile(np.arange(-1, dims, dtype=np.int32), len(held))  # -1: the count
        total = np.concatenate([counts[held, None], sums[held]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, dims + 1).astype(np.int32)), pa.array(place), pa.array(total)], ["cluster", "place", "total"])

    parts = rows.select("values", "cluster").mapInArrow(add, "cluster int, place int, total long")
    sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # clusters x (dims + 1) rows
    of = {(r["cluster"], r["place"]): int(r["total"]) for r in sums}
    new = centroids.copy()
    for k in range(len(centroids)):
        if n := of.get((k, -1)):
            new[k] = [of[k, d] // n for d in range(dims)]
    return new


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of each vector after the last assignment, and the centroids by number."""
    rows = written(quantised(embeddings, dims, scale).withColumn("cluster", F.lit(0)), "vectors")
    centroids = starts(rows, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        nearer = written(assigned(rows, centroids, dims).drop("distance"), "vectors")
        discard(rows)
        rows, centroids = nearer, moved(nearer, centroids, dims)
    if not len(centroids):
        return rows.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance")), centroids
    last = written(assigned(rows, centroids, dims).drop("values"), "assigned")
    discard(rows)
    return last, centroids


def clustered(embeddings: DataFrame, **parameters: int) -> DataFrame:
    """`cluster` with the inertia of each cluster and of all, and the hash of each cluster's centroid."""
    spark = embeddings.sparkSession
    found, centroids = cluster(embeddings, **parameters)
    of = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # one row for each centroid
    rows = [(k, of.get(k, 0), sum(of.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
