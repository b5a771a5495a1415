"""Alleles: connected runs of off-reference nodes, the reference interval each replaces, and how it differs.

nodes: rec_no, node_id, name, length, sn, so, sr; edges: edge_no, from_id, to_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import pansn_haplotype, pansn_sample
from ..storage import cut as checkpoint
from ..storage import partitions
from .components import components
from .spans import is_backbone, is_off_reference, neighbours


def runs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id and run (the smallest node id) of every off-reference node; runs grow along edges between such nodes."""
    off = nodes.where(is_off_reference()).select("node_id")
    a, b = off.select(F.col("node_id").alias("from_id")), off.select(F.col("node_id").alias("to_id"))
    inner = edges.join(a, "from_id", "left_semi").join(b, "to_id", "left_semi").select(F.col("from_id").alias("u"), F.col("to_id").alias("v"))
    roots = components(inner).select(F.col("node").alias("node_id"), "root")
    return off.join(roots, "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("run"))


def anchors(nodes: DataFrame, edges: DataFrame, run_of: DataFrame) -> DataFrame:
    """run and each backbone node beside one of its members, once for each adjacency."""
    backbone = nodes.where(is_backbone()).select(F.col("node_id").alias("other"), "sn", "so", "length")
    return neighbours(edges).join(run_of.select(F.col("node_id").alias("node"), "run"), "node").join(backbone, "other").select("run", F.col("other").alias("anchor"), "sn", "so", "length")


def intervals(anchor_rows: DataFrame) -> DataFrame:
    """run, ref, start, end, entry: from the end of the first anchor to the start of the last.

    Only for two anchors or more on one sequence, and no interval that runs backward.
    """
    first, last = F.struct("so", "anchor"), F.struct("so", "anchor")
    of = anchor_rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("sn").alias("refs"),
        F.min("sn").alias("ref"),
        F.min_by(F.col("so") + F.col("length"), first).alias("start"),
        F.min_by("anchor", first).alias("entry"),
        F.max_by("so", last).alias("end"),
    )
    return of.where("n >= 2 and refs = 1 and end >= start").select("run", "ref", "start", "end", "entry")


def sweep(members: list[dict], links: list[dict], entry: str) -> Iterator[tuple[str, int, int]]:
    """node_id, offset and order of discovery of the members of one run, in order.  members by rec_no, links by edge_no.

    Members are ordered by their distance from the entry (in bp, over the run's links), then by discovery; a member starts where the last
    of its neighbours before it ends.
    """
    size = {m["node_id"]: m["length"] for m in members}
    near: dict[str, list[str]] = {}
    for link in links:
        near.setdefault(link["from_id"], []).append(link["to_id"])
        near.setdefault(link["to_id"], []).append(link["from_id"])
    first = members[0]["node_id"]
    found, stack, seen = [], [first], {first}
    while stack:
        here = stack.pop()
        found.append(here)
        for other in near.get(here, ()):
            if other in size and other not in seen:
                seen.add(other)
                stack.append(other)
    queue = list(dict.fromkeys(n for n in near.get(entry, ()) if n in size)) or list(found)
    away = dict.fromkeys(queue, 0)
    for here in queue:
        reach = away[here] + size[here]
        for other in near.get(here, ()):
            if other in size and reach < away.get(other, float("inf")):
                away[other] = reach
                queue.append(other)
    place = {n: k for k, n in enumerate(found)}
    offset: dict[str, int] = {}
    for here in sorted(found, key=lambda n: away.get(n, float("inf"))):
        offset[here] = max((offset[o] + size[o] for o in near.get(here, ()) if o in offset), default=0)
        yield here, offset[here], place[here]


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(r["run"], node, at, offset, found) for r in batch.to_pylist() for at, (node, offset, found) in enumerate(sweep(r["members"], r["links"] or [], r["entry"]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PLACED.types, strict=True)], schema=PLACED) if rows else pa.RecordBatch.from_pylist([], schema=PLACED)


PLACED = pa.schema([("run", pa.string()), ("node_id", pa.string()), ("at", pa.int64()), ("offset", pa.int64()), ("found", pa.int64())])


def placements(nodes: DataFrame, edges: DataFrame, run_of: DataFrame, spans: DataFrame) -> DataFrame:
    """run, node_id, at (order), offset, found (order of discovery) of the members of runs with an interval.

    A run's own members and links are one row; everything between runs stays distributed, many runs to a batch.
    """
    members = run_of.join(spans.select("run", "entry"), "run").join(nodes.select("node_id", "rec_no", "length"), "node_id")
    keyed = members.select("run", "node_id", "rec_no", "length", "entry")
    by_from = edges.join(keyed.select(F.col("node_id").alias("from_id"), F.col("run").alias("_a"), F.col("entry").alias("_ea")), "from_id", "left")
    both = by_from.join(keyed.select(F.col("node_id").alias("to_id"), F.col("run").alias("_b"), F.col("entry").alias("_eb")), "to_id", "left")
    links = both.where("(_a = _b) or (_a is not null and to_id = _ea) or (_b is not null and from_id = _eb)").select(F.coalesce("_a", "_b").alias("run"), "edge_no", "from_id", "to_id")
    of = keyed.groupBy("run", "entry").agg(F.array_sort(F.collect_list(F.struct("rec_no", "node_id", "length"))).alias("members"))
    beside = links.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("edge_no", "from_id", "to_id"))).alias("links"))
    rows = of.join(beside, "run", "left").repartition(partitions(nodes.sparkSession), "run")  # few bytes, but work: not to be brought into one task
    return rows.mapInArrow(swept, "run string, node_id string, at long, offset long, found long")


def project(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alleles, members and the count of unanchored runs.

    Alleles: run, ref, start, end, sample, haplotype, source_ref, rank, ref_span, alt_length, delta, kind, path_length, segments, nodes, offsets.
    """
    run_of = checkpoint(runs(nodes, edges))
    spans = checkpoint(intervals(anchors(nodes, edges, run_of)))
    placed = checkpoint(placements(nodes, edges, run_of, spans).join(nodes.select("node_id", "name", "length", "sn", "sr"), "node_id"))
    longest = F.struct("length", (-F.col("found")).alias("first"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "name", "node_id", "offset")))
    of = placed.groupBy("run").agg(
        F.sum("length").cast("long").alias("alt_length"),
        F.max(F.col("offset") + F.col("length")).alias("path_length"),
        F.max_by("sn", longest).alias("source_ref"),
        F.max_by("sr", longest).alias("rank"),
        in_order.alias("_m"),
    )
    span, delta = F.col("end") - F.col("start"), F.col("alt_length") - (F.col("end") - F.col("start"))
    kind = F.when(delta > 0, "insertion").when(delta < 0, "deletion").otherwise("substitution")
    alleles = spans.join(of, "run").select(
        "run",
        "ref",
        "start",
        "end",
        pansn_sample(F.col("source_ref")).alias("sample"),
        pansn_haplotype(F.col("source_ref")).alias("haplotype"),
        "source_ref",
        "rank",
        span.alias("ref_span"),
        "alt_length",
        delta.alias("delta"),
        kind.alias("kind"),
        "path_length",
        *[F.col(f"_m.{c}").alias(n) for c, n in (("name", "segments"), ("node_id", "nodes"), ("offset", "offsets"))],
    )
    unanchored = run_of.select("run").distinct().join(spans, "run", "left_anti").agg(F.count(F.lit(1)).alias("unanchored"))
    return alleles, placed, unanchored


def allele_deletions(alleles: DataFrame, least: int = 1) -> DataFrame:
    """Alleles that stand for more reference than their longest path carries."""
    return alleles.select("run", "nodes", (F.col("ref_span") - F.col("path_length")).alias("bp")).where(F.col("bp") >= least)


def samples(alleles: DataFrame) -> DataFrame:
    return alleles.select("sample").distinct()


def in_order(alleles: DataFrame) -> DataFrame:
    """Alleles by start, then by sample as people sort names, then by run."""
    return alleles.orderBy("start", F.collate(F.col("sample"), "UNICODE"), "ref", "run")


def sample_list(alleles: DataFrame) -> DataFrame:
    """One row: the distinct samples, sorted by code."""
    return alleles.agg(F.array_sort(F.collect_set("sample")).alias("samples"))
