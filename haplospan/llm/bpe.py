"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton of pyahocorasick holds the
vocabulary.  A piece is encoded by backtracking: at each place the longest token is tried first, then its
shorter prefixes; a token may stand after another only if merging their joined bytes by rank would
give just these two, which is decided by undoing merges across the border and remembered for each pair.
Every place is left at most once in vain, so the number of trials is linear in the piece.

The new pieces of a slice of texts go through the automaton together, set apart by a character that no token has; pieces
whose longest tokens all fit are done then, and only the others backtrack.  Pieces are remembered in two
generations: when the young one is full it becomes the old one, and what is met again moves over, so frequent
pieces are never forgotten.

Defined cases: a null or empty text gives no ids and decodes to no bytes; a null id is kept; repeated
rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import slices_of

#: Entries of a generation of pieces, and of the memory of pairs, in each Python worker.
PIECES = 250_000
PAIRS = 500_000
#: No byte is mapped to it.
APART = "\u0100"


class Codec:
    """Tables of one vocabulary file of ranks."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.bytes_of = {int(rank): base64.b64decode(token) for token, rank in (x.split() for x in lines if x.strip())}
        self.split_text = regex.compile(pattern).findall
        self.whole = {token.decode("latin-1"): rank for rank, token in self.bytes_of.items()}
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge that makes a token
        self.merged: dict[tuple[int, int], int] = {}  # the token that a pair merges to
        self.fits: dict[int, bool] = {}  # by left and right, 32 bits each
        self.length = [0] * (max(self.bytes_of, default=0) + 1)
        for rank, token in self.bytes_of.items():
            self.length[rank] = len(token)
        self.shorter = [-1] * len(self.length)  # the longest proper prefix that is a token
        reached: dict[str, int] = {}
        for text, rank in sorted(self.whole.items(), key=lambda x: x[1]):
            if len(text) == 1:
                self.halves[rank] = (rank, rank)
                reached[text] = rank
        for text, rank in sorted(self.whole.items(), key=lambda x: x[1]):
            for cut in range(len(text) - 1, 0, -1):
                left, right = reached.get(text[:cut]), reached.get(text[cut:])
                if left is not None and right is not None and self.may_follow(left, right):
                    self.halves[rank], self.merged[left, right] = (left, right), rank
                    reached[text] = rank
                    break
        self.fits.clear()
        self.automaton = ahocorasick.Automaton()
        for text, rank in reached.items():
            self.automaton.add_word(text, rank)
            self.shorter[rank] = next((reached[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in reached), -1)
        self.automaton.make_automaton()
        self.kind = "<u2" if max(self.bytes_of, default=0) < 1 << 16 else "<u4"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes by rank gives just these two tokens.

        The later of the two last merges is undone again and again; a merge across the border that comes
        before the one undone would have been done first.
        """
        known = self.fits.get(left << 32 | right)
        if known is not None:
            return known
        pair, limit, answer = left << 32 | right, float("inf"), None
        while answer is None:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                answer = False
            elif left > right:
                limit, inner = left, self.halves[left][1]
                if inner != left:
                    left = inner
                else:
                    limit, inner = right + 0.5, self.halves[right][0]
                    answer = True if inner == right else None
                    right = inner
            else:
                limit, inner = right + 0.5, self.halves[right][0]
                if inner != right:
                    right = inner
                else:
                    limit, inner = left, self.halves[left][1]
                    answer = True if inner == left else None
                    left = inner
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[pair] = answer
        return answer

    def backtrack(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each piece in Latin-1."""
        length, shorter, may_follow, known = self.length, self.shorter, self.may_follow, self.fits.get
        joined = APART.join(texts)
        longest = [-1] * (len(joined) + 1)
        for last, rank in self.automaton.iter(joined):
            longest[last + 1 - length[rank]] = rank  # later matches from one place are longer
        at = 0
        for text in texts:
            stop, closed, ids = at + len(text), set(), []
            before, token = -1, longest[at]
            while at < stop:
                while token >= 0:
                    end = at + length[token]
                    if end not in closed:
                        if before < 0:
                            break
                        fits = known(before << 32 | token)
                        if fits or (fits is None and may_follow(before, token)):
                            break
                    token = shorter[token]
                if token >= 0:
                    ids.append(token)
                    before, at = token, end
                    token = longest[at]
                else:
                    closed.add(at)
                    token = ids.pop()
                    before = ids[-1] if ids else -1
                    at -= length[token]
                    token = shorter[token]
            yield ids
            at = stop + 1

    def learn(self, pieces: list[str]) -> None:
        """Remember the packed ids of pieces: those of the longest tokens where all neighbours fit, else by backtracking."""
        texts = [p.encode("utf-8", "surrogatepass").decode("latin-1") for p in pieces]
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(APART.join(texts))), np.int64).reshape(-1, 2)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        ids, owner = found[:, 1], np.searchsorted(starts, found[:, 0], side="right") - 1
        pairs, which = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)
        fits = np.array([self.may_follow(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()], dtype=bool)
        wrong = np.unique(owner[1:][(owner[1:] == owner[:-1]) & ~fits[which]]).tolist() if len(ids) > 1 else []
        width = np.dtype(self.kind).itemsize
        cuts = (np.searchsorted(owner, np.arange(len(texts) + 1)) * width).tolist()
        packed = ids.astype(self.kind).tobytes()
        self.young.update(zip(pieces, map(packed.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
        again = list(self.backtrack([texts[k] for k in wrong]))
        cuts = (np.cumsum([0, *map(len, again)]) * width).tolist()
        packed = np.fromiter(chain.from_iterable(again), self.kind).tobytes()
        self.young.update(zip([pieces[k] for k in wrong], map(packed.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
        whole = self.whole
        for p, t in zip(pieces, texts, strict=True):
            if t in whole:
                self.young[p] = whole[t].to_bytes(width, "little")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.split_text(t) if t else () for t in texts]
        if len(self.young) > PIECES:
            self.young, self.old = {}, self.young
        new = set().union(*split).difference(self.young)
        for p in self.old.keys() & new if self.old else ():
            self.young[p] = self.old[p]
            new.discard(p)
        if new:
            self.learn(list(new))
        of = self.young.__getitem__
        return [b"".join(map(of, pieces)) for pieces in split]


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@functools.cache
def codec_bytes(path: str) -> dict[int, bytes]:
    with open(path, "rb") as lines:
        return {int(rank): base64.b64decode(token) for token, rank in (x.split() for x in lines if x.strip())}


@functools.cache
def decimals(path: str) -> dict[int, str]:
    return {rank: str(rank) for rank in codec_bytes(path)}


def encoded(batches: Iterator[pa.RecordBatch], tables: Codec) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids of documents and of their tokens, slice by slice."""
    for batch in batches:
        for part in slices_of(batch):
            yield part.column("doc_id"), [np.frombuffer(x, tables.kind) for x in tables.encode(part.column("text").to_pylist())]


def as_lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids or [np.zeros(0)]).astype("<i4")))


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each whole text.  path: a file of ranks that every machine has."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in encoded(batches, codec(path, pattern)):
            yield pa.RecordBatch.from_arrays([doc_id, as_lists(ids)], ["doc_id", "ids"])

    return narrow(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (binary) of each row of doc_id and ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec_bytes(path).__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column("ids")
                decoded = [b"".join(map(of, ids[k].values.to_pylist() if ids[k].is_valid else [])) for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded of each whole text: encoded and decoded in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec_bytes(path).__getitem__
        for doc_id, ids in encoded(batches, codec(path, pattern)):
            decoded = [b"".join(map(of, x.tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([doc_id, as_lists(ids), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return narrow(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the decimal ids and of the bytes decoded from them, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, decimal = codec_bytes(path).__getitem__, decimals(path).__getitem__
        for doc_id, packed in encoded(batches, codec(path, pattern)):
            counts, sums, back = [], [], []
            for x in packed:
                ids = x.tolist()
                counts.append(len(ids))
                sums.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(of, ids))).hexdigest())
            columns = [doc_id, pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
