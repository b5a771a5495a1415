"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots (4,096 by default).  The bytes and rows of every slot
are summed, and a versioned slot-to-shard map is stored as a table: version 0 deals the slots out in turn,
each further version is an edit of the one before that moves whole slots from full shards to emptier
ones.  Only the map, which is as long as the number of slots, passes through the driver; records are only
ever joined with it.  All record work is DataFrame expressions.

Law: sizes (``bytes``).  Sizes of the shards differ by less than the largest record plus one slot.

Defined cases: a null text has size 1 and the checksum of no bytes; null ids and repeated rows are hashed
with their size and checksum, so no group of equal ids or texts is tied to one slot unless the rows are
equal throughout; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SLOTS = 4096
SHARDS = 8


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    return narrow.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def slot_sizes(recs: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that holds any."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalanced(old: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """An edit of a map: slots leave the fullest shard for the emptiest while that lowers the difference.

    With more shards than the old map knows, the new ones begin empty and so only receive slots.
    The work is bounded by the number of slots; sizes has one entry for each slot.
    """
    new = list(old)
    held: list[list[int]] = [[] for _ in range(shards)]
    load = [0] * shards
    for slot, shard in enumerate(new):
        if sizes.get(slot, 0):
            held[shard].append(slot)
            load[shard] += sizes[slot]
    for _ in range(4 * len(new)):
        full = max(range(shards), key=load.__getitem__)
        bare = min(range(shards), key=load.__getitem__)
        gap = load[full] - load[bare]
        # the slot nearest to half of the gap, or the exchange of two slots nearest to it
        best = min(((abs(gap - 2 * sizes[s]), s, -1) for s in held[full] if sizes[s] < gap), default=(gap, -1, -1))
        if best[0] * 50 > gap and held[bare]:
            small = sorted(held[bare], key=sizes.__getitem__)
            at = 0
            for s in sorted(held[full], key=sizes.__getitem__):
                while at + 1 < len(small) and 2 * (sizes[s] - sizes[small[at + 1]]) >= gap:
                    at += 1
                for k in (at, at + 1):
                    if k < len(small) and 0 < (d := sizes[s] - sizes[small[k]]) < gap and abs(gap - 2 * d) < best[0]:
                        best = (abs(gap - 2 * d), s, small[k])
        left, slot, back = best
        if slot < 0 or left >= gap:
            break
        for s, a, b in ((slot, full, bare), (back, bare, full)):
            if s >= 0:
                held[a].remove(s)
                held[b].append(s)
                load[a] -= sizes[s]
                load[b] += sizes[s]
                new[s] = b
    return new


def shard_map(recs: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """The stored map: version, virtual_slot, shard, bytes, rows and first, the number of rows in lower slots of its shard.

    Version 0 is the map before any record was seen, version 1 its edit for these records.
    """
    spark = recs.sparkSession
    found = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in slot_sizes(recs).collect()}  # at most one row for each slot
    plain = first_map(slots, shards)
    versions = [plain, rebalanced(plain, {s: b for s, (b, _) in found.items()}, shards)]
    rows = []
    for version, of in enumerate(versions):
        before = [0] * shards
        for slot in range(slots):
            size, n = found.get(slot, (0, 0))
            rows.append((version, slot, of[slot], size, n, before[of[slot]]))
            before[of[slot]] += n
    return written(spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long, rows long, first long").coalesce(1), "slot-map")


def shard_documents(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in its shard), grown_shard, virtual_slot and map_version.

    A record's place is the number of rows in the lower slots of its shard, which the map holds, plus its
    place in its own slot; so no shard is ever numbered, or sorted, by one task.
    """
    recs = records(docs, slots)
    current = shard_map(recs, slots, shards).where("version = 1")
    placed = recs.withColumn("_at", F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1)
    joined = placed.join(F.broadcast(current.select("virtual_slot", "shard", "first", "version")), "virtual_slot")  # `slots` rows, always
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("_at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )


def grow_map(current: DataFrame, shards: int) -> DataFrame:
    """The next version of a stored map with one more shard: only slots that move to the new shard change."""
    spark = current.sparkSession
    rows = sorted(current.collect(), key=lambda r: r["virtual_slot"])
    sizes = {r["virtual_slot"]: r["bytes"] for r in rows}
    old = [r["shard"] for r in rows]
    share = sum(sizes.values()) / (shards + 1)
    load: dict[int, int] = {}
    for r in rows:
        load[r["shard"]] = load.get(r["shard"], 0) + r["bytes"]
    new, taken = list(old), 0
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        if sizes[slot] and load[old[slot]] - sizes[slot] >= share * 0.98 and taken + sizes[slot] <= share * 1.02:
            new[slot], taken = shards, taken + sizes[slot]
            load[old[slot]] -= sizes[slot]
    before = [0] * (shards + 1)
    out = []
    for r, shard in zip(rows, new, strict=True):
        out.append((r["version"] + 1, r["virtual_slot"], shard, r["bytes"], r["rows"], before[shard]))
        before[shard] += r["rows"]
    return written(spark.createDataFrame(out, current.schema).coalesce(1), "slot-map")
