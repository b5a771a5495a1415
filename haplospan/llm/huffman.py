"""Token ids in a compact file format: length-limited canonical Huffman codes.

File format.  A folder of Parquet files with one row for each block:

    part, block     place of the block: blocks follow one another by part, then block
    doc_ids, sizes  the documents of the block in order, and the number of ids of each
    n_ids           ids in the block
    checkpoints     little-endian unsigned 32-bit bit offsets of ids 0, 128, 256, ... of the block
    payload         the codes of the ids, most significant bit first, padded to whole bytes

Beside it lies the code: a table of (id, bits), from which the canonical codes follow (shorter codes
first, then smaller ids).  Code lengths come from the counts of all ids by package-merge, at most 18 bits.
A block needs nothing but the code, so blocks are decoded independently; within a block, all runs
between checkpoints are decoded side by side by one table look-up for each id.

Documents are dealt to parts by ranges of (doc_id, checksum), so order holds across parts and many rows
with one id can still be dealt out.  A block has whole documents: it ends with the one that fills it.

Defined cases: a null or empty text is the end id alone; null ids come first; rows with equal ids are
ordered by the checksum of their text and keep one row each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written
from .tokens import word_encoder

MAX_BITS = 18
RUN = 128
BLOCK_IDS = 262_144
#: UTF-8 bytes of the texts that are encoded at a time, or one longer text.
TEXT_BYTES = 8 << 20


# ---------------------------------------------------------------- code


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Bits of each id with a positive count: package-merge, so no code is longer than limit.

    The input has one entry for each id of the vocabulary at most.
    """
    ids = sorted((i for i in counts if counts[i] > 0), key=lambda i: (counts[i], i))
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids do not fit into codes of {limit} bits")
    if len(ids) <= 1:
        return dict.fromkeys(ids, 1)
    weights = np.array([counts[i] for i in ids], dtype=np.float64)
    # level by level: which of the merged list's items are leaves, in order of weight
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        ordered = both[order]
        even = len(ordered) // 2 * 2
        packages = ordered[0:even:2] + ordered[1:even:2]
    bits = np.zeros(len(ids), dtype=np.int64)
    take = 2 * len(ids) - 2
    for leaf in reversed(levels):
        chosen = leaf[:take]
        n = int(chosen.sum())
        bits[:n] += 1
        take = 2 * (take - n)
    return {i: int(b) for i, b in zip(ids, bits, strict=True)}


def canonical(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and bits in canonical order, and the codes."""
    order = np.lexsort((ids, bits))
    ids, bits = ids[order], bits[order].astype(np.int64)
    steps = np.left_shift(np.int64(1), MAX_BITS - bits)
    return ids, bits, (np.cumsum(steps) - steps) >> (MAX_BITS - bits)


def pack(ids: np.ndarray, bits_of: np.ndarray, code_of: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The payload of a block, and its checkpoints."""
    bits = bits_of[ids]
    ends = np.cumsum(bits)
    starts = ends - bits
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return b"", starts[::RUN].astype("<u4")
    # codes that begin in the same 32 bits are added up in 64; codes are shorter than 32 bits, so one begins in all of them
    shifted = code_of[ids].astype(np.uint64) << (64 - bits - (starts & 31)).astype(np.uint64)
    sums = np.add.reduceat(shifted, np.searchsorted(starts, np.arange(0, int(starts[-1]) + 1, 32)))
    out = np.zeros(len(sums) + 1, dtype=np.uint32)
    out[:-1] = sums >> np.uint64(32)
    out[1:] |= (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], starts[::RUN].astype("<u4")


def look_up(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The id, and the bits of its code in the low byte, by the next MAX_BITS bits; ids and bits in canonical order."""
    joined = np.repeat(ids << 8 | bits, 1 << (MAX_BITS - bits))
    joined = np.pad(joined, (0, (1 << MAX_BITS) - len(joined)), constant_values=1)
    return joined.astype(np.uint32 if joined.max() < 1 << 32 else np.uint64)


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, symbol: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The ids of a block; symbol and width by the next MAX_BITS bits."""
    return unpack_joined(payload, checkpoints, n, symbol.astype(np.uint64) << np.uint64(8) | width.astype(np.uint64))


def unpack_joined(payload: bytes, checkpoints: np.ndarray, n: int, joined: np.ndarray) -> np.ndarray:
    """The ids of a block; joined as look_up has it."""
    data = np.frombuffer(payload + bytes(8), dtype=np.uint8).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # the 32 bits from each byte on
    at = checkpoints.astype(np.uint32)
    out = np.zeros((RUN, len(at)), dtype=joined.dtype)
    for k in range(RUN):
        peek = (words.take(at >> 3, mode="clip") << (at & 7)) >> np.uint32(32 - MAX_BITS)
        joined.take(peek, out=out[k], mode="clip")
        at += out[k].astype(np.uint8)
    return (out >> joined.dtype.type(8)).astype(np.uint32).T.reshape(-1)[:n]


# ---------------------------------------------------------------- tokens


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, tie (checksum of the text) and ids (packed unsigned 16-bit) of each document, the end id included."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_encoder(path)
        end = pa.scalar(np.array([end_id], dtype=words.kind).tobytes(), pa.binary())
        for batch in batches:
            sums = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(sums)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(start, stop - start)
                ids = pc.binary_join_element_wise(words.encode_array(part.column("text")), end, pa.scalar(b"", pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), ids], ["doc_id", "tie", "ids"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).alias("tie"), text.alias("text"))
    return narrow.mapInArrow(encode, "doc_id long, tie long, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """id and n, the count over all documents; each task sends one row for each id it has seen at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                here = np.bincount(np.frombuffer(b"".join(batch.column("ids").slice(start, 1024).to_pylist()), dtype=kind))
                if len(here) > len(total):
                    total = np.concatenate([total, np.zeros(len(here) - len(total), dtype=np.int64)])
                total[: len(here)] += here
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- files

BLOCKS = "part int, block long, doc_ids array<long>, sizes array<int>, n_ids long, checkpoints binary, payload binary"


def write_blocks(tokens: DataFrame, code: list[tuple[int, int]], kind: str, size: int = BLOCK_IDS) -> DataFrame:
    """Write the blocks in ascending order of doc_id, and return the table read back."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids, bits, codes = canonical(*np.array(code, dtype=np.int64).reshape(-1, 2).T)
        bits_of, code_of = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int64), np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int64)
        bits_of[ids], code_of[ids] = bits, codes
        block, names, arrays, held = 0, [], [], 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate(arrays).astype(np.int64)
            payload, points = pack(flat, bits_of, code_of)
            values = [[part], [block], [list(names)], [[len(a) for a in arrays]], [len(flat)], [points.tobytes()], [payload]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "block", "doc_ids", "sizes", "n_ids", "checkpoints", "payload"])

        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id"), batch.column("ids"), strict=True):
                names.append(doc_id.as_py())
                arrays.append(np.frombuffer(packed.as_py(), dtype=kind))
                held += len(arrays[-1])
                if held >= size:
                    yield row()
                    block, names, arrays, held = block + 1, [], [], 0
        if names:
            yield row()

    n = partitions(tokens.sparkSession)
    ordered = tokens.repartitionByRange(n, F.asc_nulls_first("doc_id"), F.asc("tie")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("tie"))
    return written(ordered.select("doc_id", "ids").mapInArrow(encode, BLOCKS), "id-blocks")


def read_blocks(blocks: DataFrame, code: list[tuple[int, int]]) -> DataFrame:
    """part, block, place (in the block), first (ids of the block before the document), doc_id and ids of every document, decoded."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits, _ = canonical(*np.array(code, dtype=np.int64).reshape(-1, 2).T)
        joined = look_up(ids, bits)
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, doc_ids, sizes, n, points, payload = (batch.column(k)[row].as_py() for k in range(7))
                flat = unpack_joined(payload, np.frombuffer(points, dtype="<u4"), n, joined)
                ends = np.cumsum([0, *sizes])
                docs = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * docs, pa.int32()),
                        pa.array([block] * docs, pa.int64()),
                        pa.array(range(docs), pa.int32()),
                        pa.array(ends[:-1], pa.int64()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array([flat[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                    ],
                    ["part", "block", "place", "first", "doc_id", "ids"],
                )

    return blocks.mapInArrow(decode, "part int, block long, place int, first long, doc_id long, ids binary")


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, block and start: the ids before each block.

    Sums over parts (as many rows as partitions) are put in order first, then blocks within their part.
    """
    from pyspark.sql import Window

    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = by_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.select("part", "block", F.coalesce(inner, F.lit(0)).alias("_inner")).join(F.broadcast(before), "part").select("part", "block", (F.col("_inner") + F.col("_before")).alias("start"))


def store_documents(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Encode all documents, write the files, and return the block table and the code."""
    kind = word_encoder(path).kind
    tokens = written(tokenized(docs, path, end_id), "ids")
    counts = {r["id"]: r["n"] for r in id_counts(tokens, kind).collect()}  # one row for each id of the vocabulary at most
    code = sorted(code_lengths(counts).items())
    return write_blocks(tokens, code, kind), code


def ids_from_files(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files written."""
    blocks, code = store_documents(docs, path, end_id)
    decoded = read_blocks(blocks, code).select("part", "block", "first", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
    return decoded.join(block_starts(blocks), ["part", "block"]).select("doc_id", (F.col("start") + F.col("first")).cast("long").alias("start"), "n_tokens", "ids_crc32")
