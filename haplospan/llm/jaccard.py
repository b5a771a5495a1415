"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct word shingles; shingles are ordered by a 64-bit hash.  Documents with
equal sets are one node.  Two sets of n and m shingles with Jaccard similarity of at least 3/4 share o >= 3(n+m)/7,
so for any l the first n - ceil(3n/4) + l shingles of the one and the first m - ceil(3m/4) + l of the other have about
l in common: a longer prefix, but more matches.

1. Prefixes with l = n/4 are dealt to buckets of shingles, each of which counts how many sets hold a shingle.  A bucket of several times its share (it holds shingles of
   very many sets) is dealt to parts by set: the parts count, slices of the bucket's shingles add the counts, and every part gets the sums back.
2. A node survives if enough of its prefix is shared with anyone; the rest cannot have a link.
3. A survivor orders its shared prefix by count, rare first, and keeps r - need + j of the r for which it needs j
   matches with a partner.  j is chosen for the least estimated cost: the sum of the counts kept, over j.
4. Nodes with the same anchor (the first by hash of the most frequent kept shingles, to a factor of two) and the same
   size class form a group, cut into blocks of bounded size.
   Blocks that share enough kept shingles, and lie no more than one size class apart, meet once, and each pair
   of nodes across them is verified exactly on whole sets.  A meeting returns a node's local root and its number
   of linked documents, not its pairs; so a group of g copies gives g rows.
5. Connected components of (node, local root) give the classes.

Equality of shingles is equality of 64-bit hashes.

Defined cases: null texts and texts without words have an empty set and link with nothing, so their class is
their own id; fewer words than a shingle has make one shingle; documents with a null id take part and never name
a class unless all ids of the class are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, release_memory, written
from .graph import components

WORDS = 5
#: So many shingles of prefixes go to a bucket on average.
BUCKET_SHINGLES = 2_000_000
#: Bounds of a block: so many shingles on average, and documents.
BLOCK_SHINGLES = 1 << 18
BLOCK_NODES = 512
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


# ---------------------------------------------------------------- sets


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    bytes.lower and bytes.split treat just A-Z and the six ASCII white space characters.
    """
    import pandas as pd

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    of = np.empty(len(words), dtype=object)
    of[:] = words
    h = pd.util.hash_array(of, categorize=False)
    width = min(k, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        total = mixed(total * np.uint64(MIX[i % 5]) + h[i : i + n]) if k > 5 else total + h[i : i + n] * np.uint64(MIX[i])
    return np.unique(mixed(total))


def node_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_overlap(n):
    return -(-3 * n // 4)


def matches(n):
    """l of a set of n."""
    return np.maximum(1, n // 4)


def prefix(n):
    return np.minimum(n, n - least_overlap(n) + matches(n))


def needed(n):
    """Shingles that the prefixes of a set of n and of any similar set share at least."""
    return np.maximum(1, matches(n) - 2)


def size_class(n):
    """Similar sets are in the same class or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(4 / 3) + 1e-9).astype(np.int64)


# ---------------------------------------------------------------- stages


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes = [], []
        for t in batch.column("text"):
            s = shingles(t.as_py())
            sizes.append(len(s))
            nodes.append(node_of(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], ["doc_id", "text_hash", "n", "node"])


def with_hash(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n (size of the set) and node (null for an empty set) of every document."""
    return written(with_hash(docs).mapInArrow(_describe, "doc_id long, text_hash long, n long, node long"), "sets")


#: A bucket of more than so many times its share is dealt to parts.
HEAVY = 4
POSTINGS = "bucket int, held long, prints binary, which binary, nodes binary, sizes binary"


def post(buckets: int):
    """Prefixes by bucket; a task sends each set once, however many copies it meets."""

    def flush(held: list[np.ndarray], nodes: list[int], sizes: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(held)
        which = np.repeat(np.arange(len(held), dtype=np.int64), [len(x) for x in held])
        bucket = ((flat & np.uint64(0xFFFFF)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        flat, which, bucket = flat[order], which[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        node_of_doc, size_of_doc = np.array(nodes, dtype="<i8"), np.array(sizes, dtype="<u4")
        rows: list[list] = [[], [], [], [], [], []]
        for a, b in zip(cuts, [*cuts[1:], len(flat)], strict=True):
            local = np.diff(which[a:b], prepend=-1) != 0
            docs = which[a:b][local]
            for to, value in zip(rows, (int(bucket[a]), int(b - a), (flat[a:b] >> np.uint64(20)).astype("<u4").tobytes(), (np.cumsum(local) - 1).astype("<u2").tobytes(), node_of_doc[docs].tobytes(), size_of_doc[docs].tobytes()), strict=True):
                to.append(value)
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["bucket", "held", "prints", "which", "nodes", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, nodes, sizes, total = [], [], [], 0
        for batch in batches:
            for t in batch.column("text"):
                s = shingles(t.as_py())
                node = node_of(s) if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                held.append(s[: int(prefix(len(s)))])
                nodes.append(node)
                sizes.append(len(s))
                total += len(held[-1])
                if total >= 1 << 20 or len(held) == 1 << 16:
                    yield flush(held, nodes, sizes)
                    held, nodes, sizes, total = [], [], [], 0
        if held:
            yield flush(held, nodes, sizes)
        held, seen = [], set()
        release_memory()

    return run


SHARED = "home int, bucket int, prints binary, nodes binary, sizes binary, counts binary"


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """bucket, parts (1 where the rows name none), prints, nodes and sizes of the rows of postings."""
    for batch in batches:
        for row in batch.to_pylist():
            at = np.frombuffer(row["which"], "<u2")
            yield row["bucket"], row.get("parts", 1), np.frombuffer(row["prints"], "<u4"), np.frombuffer(row["nodes"], "<i8")[at], np.frombuffer(row["sizes"], "<u4")[at]


def each_once(prints: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings in order of prints and nodes, each once (a set may come from several tasks), and where a print begins."""
    order = np.lexsort((nodes, prints))
    prints, nodes, sizes = prints[order], nodes[order], sizes[order]
    new = np.diff(prints.astype(np.int64), prepend=-1) != 0
    first = new | (np.diff(nodes, prepend=0) != 0)
    return prints[first], nodes[first], sizes[first], new[first]


def homeward(bucket: int, prints: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, count: np.ndarray, homes: int) -> pa.RecordBatch | None:
    """Postings of shingles that two or more sets hold, by the homes of the sets."""
    keep = count > 1
    prints, nodes, sizes, count = prints[keep], nodes[keep], sizes[keep], count[keep]
    if not len(prints):
        return None
    home = (nodes.view(np.uint64) % np.uint64(homes)).astype(np.int32)
    order = np.argsort(home, kind="stable")
    prints, nodes, sizes, count, home = prints[order], nodes[order], sizes[order], count[order], home[order]
    cuts = np.flatnonzero(np.diff(home, prepend=-1))
    parts = list(zip(cuts, [*cuts[1:], len(home)], strict=True))
    columns = [
        pa.array([int(home[a]) for a, _ in parts], pa.int32()),
        pa.array([bucket] * len(parts), pa.int32()),
        pa.array([prints[a:b].tobytes() for a, b in parts], pa.binary()),
        pa.array([nodes[a:b].tobytes() for a, b in parts], pa.binary()),
        pa.array([sizes[a:b].tobytes() for a, b in parts], pa.binary()),
        pa.array([count[a:b].astype("<u4").tobytes() for a, b in parts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["home", "bucket", "prints", "nodes", "sizes", "counts"])


def count_shared(homes: int):
    """For each bucket, the shingles that two or more sets hold, sent to the homes of those sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for bucket, _, *postings in unpacked(batches):
            found.setdefault(bucket, []).append(postings)
        for bucket in list(found):
            prints, nodes, sizes, new = each_once(*(np.concatenate(x) for x in zip(*found.pop(bucket), strict=True)))
            run_no = np.cumsum(new) - 1
            if (out := homeward(bucket, prints, nodes, sizes, np.bincount(run_no)[run_no] if len(run_no) else run_no, homes)) is not None:
                yield out
        release_memory()

    return run


# a bucket in parts: rows of postings (with nodes) and of sums (with counts) have one form
PART = "bucket int, part int, parts int, prints binary, nodes binary, sizes binary, counts binary"
PART_NAMES = ["bucket", "part", "parts", "prints", "nodes", "sizes", "counts"]
PART_KINDS = [pa.int32()] * 3 + [pa.binary()] * 4


def part_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), PART_KINDS, strict=True)], PART_NAMES)


def deal_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of heavy buckets by part: all postings of one set in a bucket go to one part, whatever task they come from."""
    for bucket, parts, prints, nodes, sizes in unpacked(batches):
        part = ((nodes.view(np.uint64) >> np.uint64(17)) % np.uint64(parts)).astype(np.int64)
        rows = [(bucket, int(p), parts, prints[m].tobytes(), nodes[m].tobytes(), sizes[m].tobytes(), None) for p in np.unique(part) for m in (part == p,)]
        if rows:
            yield part_rows(rows)


def by_part(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int, int], tuple[list, list]]:
    """Rows of postings and of counts of each (bucket, part, parts)."""
    found: dict[tuple[int, int, int], tuple[list, list]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            of = found.setdefault((r["bucket"], r["part"], r["parts"]), ([], []))
            prints = np.frombuffer(r["prints"], "<u4")
            if r["counts"] is None:
                of[0].append((prints, np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["sizes"], "<u4")))
            else:
                of[1].append((prints, np.frombuffer(r["counts"], "<u4")))
    return found


def count_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a part hold each shingle, by slices of the shingles (in the column part)."""
    for (bucket, _, parts), (postings, _) in by_part(batches).items():
        prints, _, _, new = each_once(*(np.concatenate(x) for x in zip(*postings, strict=True)))
        counts = np.diff(np.append(np.flatnonzero(new), len(prints))).astype("<u4")
        prints = prints[new]
        slices = prints % np.uint32(parts)
        yield part_rows([(bucket, int(s), parts, prints[m].tobytes(), None, None, counts[m].tobytes()) for s in np.unique(slices) for m in (slices == s,)])
    release_memory()


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums over all parts of the shingles of a slice that two or more sets hold."""
    for (bucket, slice_no, parts), (_, counted) in by_part(batches).items():
        prints, code = np.unique(np.concatenate([p for p, _ in counted]), return_inverse=True)
        sums = np.bincount(code, weights=np.concatenate([c for _, c in counted])).astype("<u4")
        keep = sums > 1
        if keep.any():
            yield part_rows([(bucket, slice_no, parts, prints[keep].tobytes(), None, None, sums[keep].tobytes())])
    release_memory()


def part_home(homes: int):
    """The postings of a part with the sums over all parts, sent to the homes of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, _, _), (postings, counted) in by_part(batches).items():
            if not postings or not counted:
                continue
            prints, nodes, sizes, _ = each_once(*(np.concatenate(x) for x in zip(*postings, strict=True)))
            known, sums = (np.concatenate(x) for x in zip(*counted, strict=True))
            order = np.argsort(known)
            known, sums = known[order], sums[order]
            at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
            if (out := homeward(bucket, prints, nodes, sizes, np.where(known[at] == prints, sums[at], 1), homes)) is not None:
                yield out
        release_memory()

    return run


def shared_shingles(postings: DataFrame, share: int, buckets: int) -> DataFrame:
    """Rows of SHARED from written postings; share: what a bucket should hold."""
    sizes = postings.groupBy("bucket").agg(F.sum("held").alias("_held")).where(F.col("_held") > HEAVY * share)
    heavy = written(sizes.select("bucket", F.ceil(F.col("_held") / share).cast("int").alias("parts")), "heavy")
    if heavy.isEmpty():
        return postings.repartition(buckets, "bucket").mapInArrow(count_shared(buckets), SHARED)
    light = postings.join(heavy, "bucket", "left_anti").repartition(buckets, "bucket").mapInArrow(count_shared(buckets), SHARED)
    dealt = postings.join(heavy, "bucket").mapInArrow(deal_parts, PART)
    counted = dealt.repartition(buckets, "bucket", "part").mapInArrow(count_part, PART)
    sums = counted.repartition(buckets, "bucket", "part").mapInArrow(add_counts, PART)
    back = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return light.union(dealt.union(back).repartition(buckets, "bucket", "part").mapInArrow(part_home(buckets), SHARED))


SURVIVORS = "node long, n long, anchor long, class long, j long, kept array<long>"


def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes whose prefix is shared often enough, their kept shingles and their anchor."""
    parts: list[tuple] = []
    for batch in batches:
        for k in range(batch.num_rows):
            _, bucket, prints, nodes, sizes, counts = (batch.column(c)[k].as_py() for c in range(6))
            tokens = np.frombuffer(prints, "<u4").astype(np.int64) | (bucket << 32)
            parts.append((np.frombuffer(nodes, "<i8"), np.frombuffer(sizes, "<u4"), tokens, np.frombuffer(counts, "<u4")))
    if not parts:
        return
    nodes, sizes, tokens, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort((tokens, counts, nodes))
    nodes, sizes, tokens, counts = nodes[order], sizes[order].astype(np.int64), tokens[order], counts[order].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    ends = np.append(cuts[1:], len(nodes))
    rows: list[list] = [[], [], [], [], [], []]
    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
        n, r = int(sizes[a]), b - a
        need = int(needed(n))
        if r < need:
            continue
        sums = np.cumsum(counts[a:b])
        choices = [j for j in (1, 2, 4, 8, 16, 32, 64) if j <= need]
        j = min(choices, key=lambda j: (sums[r - need + j - 1] / j, j))
        kept = r - need + j
        # kept shingles lie in order of count: those of at least half the highest are the last ones
        often = a + int(np.searchsorted(counts[a : a + kept] * 2, counts[a + kept - 1]))
        anchor = int(tokens[often : a + kept].min())
        for to, value in zip(rows, (int(nodes[a]), n, anchor, int(size_class(np.float64(n))), j, tokens[a : a + kept]), strict=True):
            to.append(value)
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["node", "n", "anchor", "class", "j", "kept"])


def with_blocks(survivors: DataFrame) -> DataFrame:
    """Adds block: nodes of one anchor and size class, dealt by hash to as many blocks as their number and size ask for."""
    sizes = survivors.groupBy("anchor", "class").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).alias("_parts"))
    return survivors.join(sizes, ["anchor", "class"]).withColumn("block", F.xxhash64("anchor", "class", F.pmod(F.xxhash64("node"), "_parts"))).drop("_parts")


def meetings(survivors: DataFrame) -> DataFrame:
    """a and b, the blocks that have to meet; a block of several nodes meets itself."""
    tokens = survivors.select(F.explode("kept").alias("token"), "block", "class", "j").groupBy("token", "block", "class").agg(F.min("j").alias("j"))
    left = tokens.select("token", F.col("block").alias("a"), F.col("class").alias("_ca"), F.col("j").alias("_ja"))
    right = tokens.select("token", F.col("block").alias("b"), F.col("class").alias("_cb"), F.col("j").alias("_jb"))
    across = left.join(right, "token").where("a < b and abs(_ca - _cb) <= 1").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_shared"), F.least(F.min("_ja"), F.min("_jb")).alias("_j"))
    within = survivors.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
    return across.where("_shared >= _j").select("a", "b").union(within)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            found = [shingles(t.as_py()).tobytes() for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("block"), part.column("copies"), pa.array(found, pa.binary())], ["node", "block", "copies", "shingles"])


def linked(sets: list[np.ndarray], side: np.ndarray | None) -> np.ndarray:
    """Which pairs are similar, as a matrix; side: if given, only pairs of different sides."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[code] > 1
    code, owner = code[shared], owner[shared]
    _, code = np.unique(code, return_inverse=True)
    width = int(code.max(initial=-1)) + 1
    both = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = max(256, (1 << 22) // len(sets))
    for low in range(0, width, step):
        a, b = np.searchsorted(code, [low, low + step])
        held = np.zeros((len(sets), min(step, width - low)), dtype=np.float32)
        held[owner[a:b], code[a:b] - low] = 1
        both += held @ held.T
    union = sizes[:, None] + sizes[None, :] - both
    out = 100 * both >= 75 * union
    np.fill_diagonal(out, False)
    if side is not None:
        out &= side[:, None] != side[None, :]
    return out


def local_roots(near: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches by links of this meeting."""
    root = nodes.copy()
    left = set(range(len(nodes)))
    while left:
        start = left.pop()
        reached, edge = np.zeros(len(nodes), dtype=bool), np.zeros(len(nodes), dtype=bool)
        reached[start] = edge[start] = True
        while edge.any():
            edge = near[edge].any(axis=0) & ~reached
            reached |= edge
        root[reached] = nodes[reached].min()
        left.difference_update(np.flatnonzero(reached).tolist())
    return root


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root and links (documents linked) of the nodes that a meeting links; rows come ordered by meeting."""

    def meeting(rows: list[tuple]) -> pa.RecordBatch | None:
        once = {(r[2], r[3]): r for r in rows}  # repeated rows of a table count once
        rows = [once[k] for k in sorted(once)]
        if len(rows) < 2:
            return None
        nodes = np.array([r[3] for r in rows], dtype=np.int64)
        weight = np.array([r[4] for r in rows], dtype=np.int64)
        side = None if rows[0][0] == rows[0][1] else np.array([r[2] == r[0] for r in rows])
        near = linked([np.frombuffer(r[5], "<u8") for r in rows], side)
        has = near.any(axis=1)
        if not has.any():
            return None
        root = local_roots(near, nodes)
        links = near.astype(np.int64) @ weight
        return pa.RecordBatch.from_arrays([pa.array(nodes[has]), pa.array(root[has]), pa.array(links[has])], ["node", "root", "links"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:2] != row[:2]:
                if (out := meeting(held)) is not None:
                    yield out
                held = []
            held.append(row)
    if held and (out := meeting(held)) is not None:
        yield out


def node_links(docs: DataFrame, info: DataFrame) -> DataFrame:
    """node, root and links for all meetings that link a node; info: from described()."""
    spark = docs.sparkSession
    shingles_in_all = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 2  # prefixes are about half of the sets
    buckets = max(partitions(spark), -(-shingles_in_all // BUCKET_SHINGLES))
    postings = written(with_hash(docs).select("text").mapInArrow(post(buckets), POSTINGS), "postings")
    shared = shared_shingles(postings, max(1, shingles_in_all // buckets), buckets).repartition(buckets, "home")
    alone = written(shared.mapInArrow(survive, SURVIVORS), "survivors")
    discard(postings)
    survivors = written(with_blocks(alone), "blocks")
    pairs = written(meetings(survivors), "meetings")
    # the whole sets of the survivors that meet anyone, from one document of each
    busy = pairs.select(F.col("a").alias("block")).union(pairs.select(F.col("b").alias("block"))).distinct()
    chosen = info.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id"), F.col("text_hash"))).alias("_of"), F.count(F.lit(1)).alias("copies"))
    wanted = survivors.select("node", "block").join(busy, "block", "left_semi").join(chosen, "node")
    wanted = wanted.select("node", "block", "copies", F.col("_of.doc_id").alias("_id"), F.col("_of.text_hash").alias("_hash"))
    texts = with_hash(docs).alias("d").join(wanted, F.expr("d.text_hash = _hash and d.doc_id <=> _id")).select("node", "block", "copies", "text")
    sets = texts.mapInArrow(_sets, "node long, block long, copies long, shingles binary")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    met = sides.join(sets, "block").select("a", "b", "block", "node", "copies", "shingles")
    found = written(met.repartition(buckets, "a", "b").sortWithinPartitions("a", "b").mapInArrow(verify, "node long, root long, links long"), "node-links")
    discard(alone, survivors, pairs)
    return found


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents it links with) and two keys: text_hash, class_node."""
    info = described(docs)
    met = node_links(docs, info)
    roots = components(met.select(F.col("node").alias("u"), F.col("root").alias("v")))
    nodes = info.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    linked_to = met.groupBy("node").agg(F.sum("links").alias("links"))
    linked = written(nodes.join(roots, "node").join(linked_to, "node", "left"), "linked")
    # a class may hold very many nodes: its least id is aggregated, written and joined from files, so that large partitions can be split
    ids = written(linked.groupBy("root").agg(F.min("least").alias("class_id")), "class-ids")
    in_class = linked.join(ids, "root").select("node", "root", "class_id", "links")
    # a node may be very many copies: written as well, for the same reason
    by_node = nodes.join(in_class, "node", "left").select(
        "node",
        F.coalesce("root", "node").alias("class_node"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    full = info.join(written(by_node, "by-node"), "node", "left")
    discard(met, linked, ids)
    return full.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
        "class_node",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, of which no other row of the class comes first (smallest id, then text hash).

    Rows with an empty set are their own class and stay.
    """
    classes = written(jaccard_classes(docs), "classes")
    first = classes.where("class_node is not null").groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("_of"))
    kept = first.select(F.col("_of.id").alias("id"), F.col("_of.hash").alias("hash")).alias("kept")
    # rows are packed, so that no column of docs can clash with the keys
    packed = docs.select(F.struct("*").alias("row"))
    same = F.expr("xxhash64(cast(row.text as string)) = kept.hash and cast(row.doc_id as long) <=> kept.id")
    chosen = packed.join(kept, same).dropDuplicates(["hash", "id"]).select("row.*")
    wordless = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return chosen.union(wordless)
