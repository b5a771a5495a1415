"""Exact top-k search by inner product over a bit-sliced index.

Every component becomes an integer, floor(256 x).  Rows are dealt to blocks; in a block, each dimension is
shifted to start at 0 and its SLICES highest bits are stored as bitmaps over the rows, one for each bit.
For a query, the slices of all dimensions are added with weights by bitmap arithmetic (full adders on
whole bitmaps; a negative weight adds the complement), which gives the slices of a score that leaves out the
low bits.  Walking these from the most significant slice downward finds the k-th highest such score.  What was
left out is bounded by the query's weights, so only rows within that bound of the k-th score can be among the
first k: these boundary rows are resolved by their exact scores.

Each query meets each block once: groups of up to QUERY_ROWS queries, fewer where blocks are few, are joined with the blocks; k rows of each meeting go on to the final ranking.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take
no part; vectors of unequal length are compared as if zeros filled the shorter; a query never finds its
own row but may find other rows with its id; repeated queries are answered once each; an empty table gives no
rows; other columns are ignored.  Components so large that a score could leave 63 bits end the search by an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

K = 5
SCALE = 256
SLICES = 7
BLOCK_ROWS = 16_384
#: Queries of a group at most: the index is sent once for each group of queries.
QUERY_ROWS = 8192


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and values (array of long) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("values"))


def matrix(lists: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists as a matrix, filled with zeros."""
    out = np.zeros((len(lists), width), dtype=np.int64)
    for k, row in enumerate(lists):
        values = row.values.to_numpy(zero_copy_only=False)
        out[k, : len(values)] = values
    return out


# ---------------------------------------------------------------- bitmaps


def bitmap(flags: np.ndarray) -> np.ndarray:
    packed = np.packbits(flags, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view("<u8")


def slice_block(values: np.ndarray, slices: int = SLICES) -> tuple[int, np.ndarray]:
    """The shift, and the bitmaps by dimension and bit."""
    low = values.min(axis=0, initial=0) if not len(values) else values.min(axis=0)
    over = values - low
    shift = max(0, int(over.max(initial=0)).bit_length() - slices)
    high = over >> shift
    maps = [bitmap(((high[:, d] >> b) & 1).astype(bool)) for d in range(values.shape[1]) for b in range(slices)]
    return shift, np.array(maps, dtype=np.uint64).reshape(values.shape[1], slices, -1)


def add_slices(columns: list[list[np.ndarray]]) -> list[np.ndarray | None]:
    """Sum bitmaps that stand at weights 1, 2, 4, ... to the slices of the sum."""
    out: list[np.ndarray | None] = []
    at = 0
    while at < len(columns):
        here = columns[at]
        if len(here) > 1 and at + 1 == len(columns):
            columns.append([])
        while len(here) > 2:
            a, b, c = here.pop(), here.pop(), here.pop()
            odd = a ^ b
            here.append(odd ^ c)
            columns[at + 1].append((a & b) | (odd & c))
        if len(here) == 2:
            a, b = here
            columns[at + 1].append(a & b)
            here = [a ^ b]
        out.append(here[0] if here else None)
        at += 1
    return out


def weighted_sum(query: np.ndarray, plain: list[list[np.ndarray]], inverse: list[list[np.ndarray]]) -> list[np.ndarray | None]:
    columns: list[list[np.ndarray]] = [[] for _ in range(max(1, int(np.abs(query).max(initial=0)).bit_length()) + (len(plain[0]) if plain else 0))]
    for q, up, down in zip(query.tolist(), plain, inverse, strict=True):
        weight, maps, at = abs(q), up if q > 0 else down, 0
        while weight:
            if weight & 1:
                for b, m in enumerate(maps):
                    columns[at + b].append(m)
            weight >>= 1
            at += 1
    return add_slices(columns)


def count(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def kth_highest(slices: list[np.ndarray | None], rows: np.ndarray, k: int) -> int:
    """The k-th highest value among rows; from the most significant slice downward."""
    value, left = 0, rows
    for bit in range(len(slices) - 1, -1, -1):
        if slices[bit] is None:
            continue
        ones = left & slices[bit]
        n = count(ones)
        if n >= k:
            left, value = ones, value | 1 << bit
        else:
            left, k = left & ~slices[bit], k - n
    return value


def at_least(slices: list[np.ndarray | None], rows: np.ndarray, value: int) -> np.ndarray:
    if value <= 0:
        return rows
    above, equal = np.zeros_like(rows), rows
    if value >> len(slices):
        return above
    for bit in range(len(slices) - 1, -1, -1):
        of = slices[bit]
        if value >> bit & 1:
            equal = equal & of if of is not None else np.zeros_like(rows)
        elif of is not None:
            above = above | (equal & of)
            equal = equal & ~of
    return above | equal


def block_top(query: np.ndarray, own: int, k: int, values: np.ndarray, ids: np.ndarray, shift: int, plain: list, inverse: list) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a block, by score and id: places and scores.  own: the query's place here, or -1."""
    flags = np.ones(len(values), dtype=bool)
    if own >= 0:
        flags[own] = False
    rows = bitmap(flags)
    if flags.sum() > k:
        slices = weighted_sum(query, plain, inverse)
        slack = -(-int(np.abs(query).sum()) * ((1 << shift) - 1) // (1 << shift))
        rows = at_least(slices, rows, kth_highest(slices, rows, k) - slack)
    places = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little", count=len(values)))
    scores = values[places] @ query
    best = np.lexsort((ids[places], -scores))[:k]
    return places[best], scores[best]


# ---------------------------------------------------------------- Spark


def build_index(rows: DataFrame, blocks: int, width: int) -> DataFrame:
    """One row for each block: its ids, row numbers, values, shift and slices.  rows: rid, vec_id, values, block."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        values = matrix(group.column("values"), width)
        shift, maps = slice_block(values)
        packed = {
            "block": pa.array([group.column("block")[0].as_py()], pa.int32()),
            "ids": pa.array([group.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "rids": pa.array([group.column("rid").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "cells": pa.array([values.astype("<i8").tobytes()], pa.binary()),
            "shift": pa.array([shift], pa.int32()),
            "maps": pa.array([maps.tobytes()], pa.binary()),
        }
        return pa.table(packed)

    return rows.groupBy("block").applyInArrow(build, "block int, ids binary, rids binary, cells binary, shift int, maps binary")


def pack_queries(rows: DataFrame, groups: int, width: int) -> DataFrame:
    """One row for each group of queries."""

    def build(group: pa.Table) -> pa.Table:
        packed = {
            "query_group": pa.array([group.column("query_group")[0].as_py()], pa.int32()),
            "query_ids": pa.array([group.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "query_rids": pa.array([group.column("rid").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "query_cells": pa.array([matrix(group.column("values"), width).astype("<i8").tobytes()], pa.binary()),
        }
        return pa.table(packed)

    dealt = rows.withColumn("query_group", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(groups)).cast("int")).select("rid", "vec_id", "values", "query_group")
    return dealt.groupBy("query_group").applyInArrow(build, "query_group int, query_ids binary, query_rids binary, query_cells binary")


def scored(k: int, width: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                ids, rids = np.frombuffer(of["ids"], "<i8"), np.frombuffer(of["rids"], "<i8")
                values = np.frombuffer(of["cells"], "<i8").reshape(len(ids), width)
                maps = np.frombuffer(of["maps"], "<u8").reshape(width, SLICES, -1)
                plain, inverse = [list(m) for m in maps], [list(m) for m in ~maps]
                place = {r: n for n, r in enumerate(rids.tolist())}
                query_rids = np.frombuffer(of["query_rids"], "<i8")
                queries = np.frombuffer(of["query_cells"], "<i8").reshape(len(query_rids), width)
                found = [block_top(q, place.get(r, -1), k, values, ids, of["shift"], plain, inverse) for q, r in zip(queries, query_rids.tolist(), strict=True)]
                sizes = [len(p) for p, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_rids, sizes)),
                        pa.array(np.repeat(np.frombuffer(of["query_ids"], "<i8"), sizes)),
                        pa.array(ids[np.concatenate([p for p, _ in found])]),
                        pa.array(np.concatenate([s for _, s in found]).astype("<i8")),
                    ],
                    ["query_rid", "query_id", "vec_id", "score"],
                )

    return score


def top_k(embeddings: DataFrame, is_query, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the highest inner product for each query row.

    is_query: a condition on vec_id.  Ties go to the smaller vec_id.
    """
    spark = embeddings.sparkSession
    rows = written(quantised(embeddings).withColumn("rid", F.monotonically_increasing_id()), "quantised")
    most = F.max(F.greatest(F.array_max("values"), -F.array_min("values")))
    n, queries, width, largest = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.coalesce(F.max(F.size("values")), F.lit(0)), F.coalesce(most.cast("decimal(20,0)"), F.lit(0))).first()
    if width * int(largest) ** 2 >= 1 << 62:
        raise ValueError(f"{width} components of up to {largest}: scores could leave 63 bits")
    blocks = max(1, -(-n // block_rows))
    groups = max(1, -(-queries // query_rows), min(-(-3 * partitions(spark) // blocks), queries // 32))  # at least, so that few blocks still make enough tasks
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).select("rid", "vec_id", "values", "block")
    index = written(build_index(dealt, blocks, width), "bit-slices")
    packed = pack_queries(rows.where(is_query), groups, width)
    meetings = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(index, "block")
    spread = meetings.repartition(max(partitions(spark), 1), "block", "query_group")
    best = spread.mapInArrow(scored(k, width), "query_rid long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
