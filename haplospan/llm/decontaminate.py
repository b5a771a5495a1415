"""Benchmark decontamination by template canonicalisation.

Texts become sequences of words and numbers in which numbers, names and units are placeholders of their type: a
name is a capitalised word; one that starts a sentence is a word as well as a name, and its windows have both forms; short units count as such after a number only.  Windows of WIDTH template words of the benchmark and of the documents
are joined by hash; a template needs five literal words.  Every window is also joined by its own tokens (in lower case if five are words or
names, else as they stand), so that verbatim copies of every item are found.  A document then holds an occurrence of an item for each offset between the two at which
windows match; its windows count if their slots are unchanged or consistent in the run of overlapping windows: each value of the item
stands for one value of the document, and at most two in the occurrence for the same.  Windows that hold a slot in conflict are left out, not the others.  So re-parameterised questions are found and chance matches of templates are not.
An item leaks into a document if its consistent occurrences cover HITS windows of it, or all it has, or as many of those that are templates.

Up to BROADCAST_WINDOWS benchmark windows, counted first, go to every task and each document is judged where it is
read; beyond that, windows of both sides are shuffled by hash and judged for each document and item.

Defined cases: null texts and items match nothing; items of equal text are one, named by the smallest id; items shorter than
a window are one window of their own length, down to one token; items without words and numbers match nothing; repeated documents are all reported; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory
from .langid import slices_of

WIDTH = 8
LITERAL = 5
HITS = 3
SHARED = 2
BROADCAST_WINDOWS = 200_000
MEMORY = 300_000
NUMBER, NAME, UNIT, STOP, WORD, CAPITAL, SHORT = range(7)
EITHER = CAPITAL  # a capitalised word that starts a sentence
EXACT = -1
NAME_HASH = np.uint64(0x6E616D65)
# Units of measure.  Those of up to three letters and the ambiguous ones are units after a number only, else words.
UNITS = frozenset((
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec min h hr hrs day days week weeks year years mph kmh "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit watt watts volt volts "
    "meter meters metre metres mile miles gram grams litre litres liter liters hour hours minute minutes second seconds"
).split())
AMBIGUOUS = {"second"}


@functools.cache
def patterns():
    """Tokens of any text; tokens of a text whose only letters are Latin ones with a code of their own up to 255; and what such a text has not."""
    import regex

    latin = "A-Za-zÀ-ÖØ-öø-ÿ"
    any_text = regex.compile(r"\p{N}+(?:[.,]\p{N}+)*|\p{L}[\p{L}\p{M}]*|[.!?\n]")
    return any_text, re.compile(rf"[0-9]+(?:[.,][0-9]+)*|[{latin}]+|[.!?\n]"), re.compile(rf"[^\x00-\x7f{latin}]")


def tokens_of(text: str | None) -> list[str]:
    """Words, numbers and stops, in order.  Both patterns find the same in Latin texts; the standard library's is faster."""
    if not text:
        return []
    any_text, latin, other = patterns()
    return (any_text if other.search(text) else latin).findall(text)


class Tokens(NamedTuple):
    """Tokens of texts one after another: all of them, the places of those that are no stops, and of the latter their three hashes, their kinds
    (NUMBER, NAME, UNIT, WORD, or EITHER: a word or name that starts a sentence) and the numbers of their texts."""

    flat: list[str]
    places: np.ndarray
    hashes: np.ndarray
    kinds: np.ndarray
    owner: np.ndarray

    def slots(self, at: int, width: int, form: int) -> list[str]:
        if form == EXACT:
            return []
        of = [NAME if form >> i & 1 else WORD if kind == EITHER else kind for i, kind in enumerate(self.kinds[at : at + width].tolist())]
        return [f"{kind}{self.flat[self.places[at + i]].lower()}" for i, kind in enumerate(of) if kind != WORD]


class Templates:
    """Hashes and kinds of tokens, remembered by token number."""

    def __init__(self):
        self.memory: dict[str, int] = {}
        self.hashes = np.zeros((3, 1024), dtype=np.uint64)
        self.kinds = np.zeros(1024, dtype=np.int8)

    def code(self, token: str) -> tuple[int, int, int, int]:
        """Hashes as part of a template, in lower case and as it stands, and the kind."""
        import xxhash

        first = token[0]
        if first in ".!?\n":
            kind, name = STOP, ""
        elif not first.isalpha():
            kind, name = NUMBER, "<number>"
        elif token.lower() in UNITS:
            kind, name = SHORT if len(token) <= 3 or token.lower() in AMBIGUOUS else UNIT, "<unit>"
        else:
            kind = CAPITAL if len(token) > 1 and first.isupper() and token[1:].islower() else WORD
            name = token.lower()
        return *(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in (name, token.lower(), token)), kind

    def __call__(self, texts: list[str | None]) -> Tokens:
        """The tokens of texts, without stops."""
        split = [tokens_of(t) for t in texts]
        if len(self.memory) > MEMORY:
            self.memory.clear()
        for t in sorted(set().union("\n", *split).difference(self.memory)):
            k = self.memory[t] = len(self.memory)
            if k == len(self.kinds):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
                self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
            *self.hashes[:, k], self.kinds[k] = self.code(t)
        flat = ["\n"]  # a stop goes before each text
        for tokens in split:
            flat += tokens
            flat.append("\n")
        found = np.fromiter(map(self.memory.__getitem__, flat), np.int64, len(flat))
        kinds = self.kinds[found]
        names = np.flatnonzero((kinds[1:] == CAPITAL) & (kinds[:-1] != STOP)) + 1
        kinds[names] = NAME
        kinds[np.flatnonzero((kinds[1:] == SHORT) & (kinds[:-1] == NUMBER)) + 1] = UNIT
        places = np.flatnonzero(kinds != STOP)
        hashes = self.hashes[:, found[places]]
        hashes[0, kinds[places] == NAME] = NAME_HASH
        words = kinds[places] == SHORT
        hashes[0, words] = hashes[1, words]
        kinds[kinds == SHORT] = WORD
        sizes = [len(tokens) + 1 for tokens in split]
        owner = np.repeat(np.arange(len(texts)), sizes)[places - 1] if texts else np.zeros(0, dtype=np.int64)
        return Tokens(flat, places, hashes, kinds[places], owner)


def mixed(hashes: np.ndarray, at: np.ndarray | None, width: int, seed: int, form: np.ndarray | None = None) -> np.ndarray:
    """The hash of the window from each given place on, or from all; a bit of the form makes its word a name."""
    n = len(hashes) - width + 1
    total = np.full(n if at is None else len(at), width + seed, dtype=np.uint64)
    for i in range(width):
        own = hashes[i : i + n] if at is None else hashes[at + i]
        if form is not None:
            own[form >> i & 1 == 1] = NAME_HASH
        total ^= own
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def count(which: np.ndarray, width: int) -> np.ndarray:
    """How many of the tokens of the window from each place on are marked."""
    sums = np.concatenate([[0], np.cumsum(which)])
    return sums[width:] - sums[:-width]


def rich(kinds: np.ndarray, width: int) -> np.ndarray:
    """Whether the window from each place on has enough literal words for a template."""
    return count((kinds == WORD) | (kinds == EITHER), width) >= LITERAL


def windows(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and form of the windows that lie within a text: EXACT for their tokens (in lower case if enough of them are words), else for a template, with a bit for each EITHER that is a name in it."""
    hashes, kinds = tokens.hashes, tokens.kinds
    n = len(kinds) - width + 1
    if n <= 0 or width < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int16)
    within = tokens.owner[:n] == tokens.owner[width - 1 :]
    words = (kinds == WORD) | (kinds == EITHER)
    wordy = count(words | (kinds == NAME), width) >= LITERAL
    plain, poor = np.flatnonzero(wordy & within), np.flatnonzero(~wordy & within)
    literal = count(words, width)
    template = np.flatnonzero((literal >= LITERAL) & (count(kinds != WORD, width) > 0) & within)
    found = [
        (plain, mixed(hashes[1], None, width, 0)[plain], np.full(len(plain), EXACT, dtype=np.int16)),
        (poor, mixed(hashes[2], poor, width, 1 << 32), np.full(len(poor), EXACT, dtype=np.int16)),
        (template, mixed(hashes[0], None, width, 2 << 32)[template], np.zeros(len(template), dtype=np.int16)),
    ]
    # words that may be names as well: one form more for each of them, as long as enough literal words are left
    either = kinds == EITHER
    some = template[(count(either, width)[template] > 0) & (literal[template] > LITERAL)]
    form, spare = np.zeros(len(some), dtype=np.int16), literal[some] - LITERAL
    for i in range(width if len(some) else 0):
        more = np.flatnonzero(either[some + i] & (spare > 0))
        some, form, spare = np.concatenate([some, some[more]]), np.concatenate([form, form[more] | 1 << i]), np.concatenate([spare, spare[more] - 1])
    some, form = some[form > 0], form[form > 0]
    found.append((some, mixed(hashes[0], some, width, 2 << 32, form), form))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


WINDOWS = "item_id long, at int, width int, of int, rich int, template boolean, forms array<struct<hash: bigint, slots: array<string>>>"
FORMS = pa.list_(pa.struct([("hash", pa.int64()), ("slots", pa.list_(pa.string()))]))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    template = Templates()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            tokens = template([text])
            if not len(tokens.kinds):
                continue
            width = min(WIDTH, len(tokens.kinds))
            forms: dict[int, list[dict]] = defaultdict(list)
            for at, value, form in zip(*(c.tolist() for c in windows(tokens, width)), strict=True):
                forms[at].append({"hash": value - (1 << 64) if value >> 63 else value, "slots": tokens.slots(at, width, form)})
            enough = rich(tokens.kinds, width).tolist()
            rows += [(item, at, width, len(enough), sum(enough), enough[at], forms[at]) for at in sorted(forms)]
        kinds_of = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), FORMS]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds_of)], ["item_id", "at", "width", "of", "rich", "template", "forms"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Each window of each different item: item_id, at, width, of (windows of the item), rich (those that may match as templates), template (whether it may), and its forms."""
    items = benchmark.where(F.col("text").isNotNull()).groupBy(F.col("text").cast("string").alias("text")).agg(F.min(F.col("item_id").cast("long")).alias("item_id"))
    return items.select("item_id", "text").mapInArrow(_item_windows, WINDOWS)


class Match(NamedTuple):
    """A window of an item in a document: places, windows of the item in all and as templates, whether this is one, and the slots."""

    place: int
    at: int
    width: int
    of: int
    rich: int
    template: bool
    slots: list[str]
    here: list[str]


def kept_pairs(run: list[Match]) -> set[tuple[str, str]]:
    """The pairs of slots of a run without those in conflict: the document's value that most windows give to each value of the item (on ties its own, then the least)."""
    counts = Counter(p for m in run for p in zip(m.slots, m.here, strict=True))
    best: dict[str, tuple[int, bool, str]] = {}
    for a, b in sorted(counts):
        if a not in best or (counts[a, b], a == b) > best[a][:2]:
            best[a] = (counts[a, b], a == b, b)
    return {(a, b) for a, (_, _, b) in best.items()}


def runs(matches: list[Match]) -> Iterator[list[Match]]:
    """Matches of one offset, cut where the windows of the item neither overlap nor touch."""
    matches = sorted(matches, key=lambda m: m.at)
    start = 0
    for k in range(1, len(matches) + 1):
        if k == len(matches) or matches[k].at - matches[k - 1].at > matches[k].width:
            yield matches[start:k]
            start = k


class Judge:
    """Judges the matches of one item in one document, which come by place.

    An offset between document and item is settled when no window of the item can come at it any more, so no more than the item's length of
    offsets is held, however long the document and however often the item's windows repeat in it.
    """

    def __init__(self, reach: int):
        self.reach, self.by_offset = reach, defaultdict(list)
        self.covered: dict[int, bool] = {}
        self.changed, self.of, self.as_templates, self.next = False, 0, 0, 0

    def add(self, m: Match) -> None:
        if m.place >= self.next:
            for offset in [o for o in self.by_offset if o + self.reach < m.place]:
                self.settle(self.by_offset.pop(offset))
            self.next = m.place + self.reach + 1
        self.of, self.as_templates = m.of, m.rich
        self.by_offset[m.place - m.at].append(m)

    def settle(self, some: list[Match]) -> None:
        parts = [(run, kept_pairs(run)) for run in runs(some)]
        sharing = Counter(b for _, b in {p for _, kept in parts for p in kept})
        for run, kept in parts:
            for m in run:
                pairs = set(zip(m.slots, m.here, strict=True))
                if m.slots == m.here or (pairs <= kept and all(sharing[b] <= SHARED for _, b in pairs)):
                    self.covered[m.at] = self.covered.get(m.at, False) or m.template
                    self.changed = self.changed or m.slots != m.here

    def verdict(self) -> tuple[int, bool, int] | None:
        """Windows covered, whether a slot was changed and the item's windows, if the item leaks."""
        for some in self.by_offset.values():
            self.settle(some)
        self.by_offset.clear()
        enough = len(self.covered) >= min(HITS, self.of) or (self.as_templates and sum(self.covered.values()) >= min(HITS, self.as_templates))
        return (len(self.covered), self.changed, self.of) if enough else None


def judge(matches: list[Match]) -> tuple[int, bool, int] | None:
    one = Judge(max(m.at for m in matches))
    for m in sorted(matches, key=lambda m: m.place):
        one.add(m)
    return one.verdict()


class Matcher:
    """The benchmark's windows in a task."""

    def __init__(self, rows: list[tuple]):
        self.by_hash: dict[int, list[tuple]] = defaultdict(list)
        for item, at, width, of, as_templates, template, forms in rows:
            for value, values in forms:
                self.by_hash[value].append((item, at, width, of, as_templates, template, values))
        self.widths = sorted({r[2] for r in rows})
        self.reach: dict[int, int] = defaultdict(int)
        for item, at, *_ in rows:
            self.reach[item] = max(self.reach[item], at)
        self.known = np.sort(np.array(list(self.by_hash), dtype=np.int64).view(np.uint64))
        self.flags = np.zeros(1 << 22, dtype=bool)
        self.flags[self.known % np.uint64(1 << 22)] = True
        self.template = Templates()

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, bool, int]]:
        """Number of the text, item, windows covered, changed, windows of the item."""
        tokens = self.template(texts)
        parts = []
        for width in self.widths:
            places, found, forms = windows(tokens, width)
            hit = np.flatnonzero(self.flags[found % np.uint64(1 << 22)])
            near = np.searchsorted(self.known, found[hit])
            hit = hit[self.known[np.minimum(near, len(self.known) - 1)] == found[hit]]
            parts.append((places[hit], found[hit].astype(np.int64), forms[hit], np.full(len(hit), width)))
        if not parts:
            return []
        at, value, form, width = (np.concatenate(p) for p in zip(*parts, strict=True))
        out, owner, judges = [], -1, {}
        order = np.argsort(at, kind="stable")
        rows = (x[order].tolist() for x in (tokens.owner[at], at, width, value, form))
        for text, place, wide, hashed, kind in zip(*rows, strict=True):
            if text != owner:
                out += [(owner, item, *found) for item in sorted(judges) if (found := judges[item].verdict())]
                owner, judges = text, {}
            here = tokens.slots(place, wide, kind)
            for item, start, of_width, of, as_templates, template, values in self.by_hash[hashed]:
                if of_width == wide and len(here) == len(values):
                    if item not in judges:
                        judges[item] = Judge(self.reach[item])
                    judges[item].add(Match(place, start, wide, of, as_templates, template, values, here))
        return out + [(owner, item, *found) for item in sorted(judges) if (found := judges[item].verdict())]


LEAKS = "doc_id long, text_hash long, item_id long, windows int, changed boolean, item_windows int"
LEAK_NAMES = ["doc_id", "text_hash", "item_id", "windows", "changed", "item_windows"]
LEAK_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32()]


def known_windows(benchmark: DataFrame, bound: int) -> list[tuple] | None:
    """The benchmark's windows, if there are no more than the bound."""
    found = item_windows(benchmark).limit(bound + 1).collect()
    return None if len(found) > bound else sorted(tuple(r) for r in found)


def find_leaks(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, text_hash, item_id, windows (covered), changed (re-parameterised) and item_windows of each leak."""
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = known_windows(benchmark, bound)
    if rows is None:
        return joined_leaks(narrow, item_windows(benchmark))
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            for part in slices_of(batch):
                found = matcher.leaks(part.column("text").to_pylist())
                at = pa.array([r[0] for r in found], pa.int64())
                columns = [part.column("doc_id").take(at), part.column("text_hash").take(at), *[pa.array([r[k] for r in found], LEAK_KINDS[k + 1]) for k in range(1, 5)]]
                yield pa.RecordBatch.from_arrays(columns, LEAK_NAMES)

    return narrow.mapInArrow(run, LEAKS)


def joined_leaks(narrow: DataFrame, items: DataFrame) -> DataFrame:
    """The leaks by a shuffled join of windows, for benchmarks of any size."""
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # WIDTH values at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Templates()
        for batch in batches:
            for part in slices_of(batch, 1 << 20):
                tokens, rows = template(part.column("text").to_pylist()), []
                for width in widths:
                    places, found, forms = windows(tokens, width)
                    rows += [
                        (int(tokens.owner[at]), at, width, value, tokens.slots(at, width, form))
                        for at, value, form in zip(places.tolist(), found.astype(np.int64).tolist(), forms.tolist(), strict=True)
                    ]
                at = pa.array([r[0] for r in rows], pa.int64())
                columns = [part.column("row").take(at), part.column("doc_id").take(at), part.column("text_hash").take(at)]
                columns += [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text_hash", "place", "wide", "value", "here"])

    def verdict(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        found = judge([Match(*(r[k] for k in Match._fields)) for r in rows])
        out = [(rows[0]["doc_id"], rows[0]["text_hash"], rows[0]["item_id"], *found)] if found else []
        return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(LEAK_KINDS)], names=LEAK_NAMES)

    own = narrow.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, text_hash long, place int, wide int, value long, here array<string>")
    items = items.select("*", F.explode("forms").alias("form")).select("item_id", "at", "width", "of", "rich", "template", "form.hash", "form.slots")
    met = own.join(items, F.expr("value = hash and wide = width and size(here) = size(slots)"))
    return met.groupBy("row", "item_id").applyInArrow(verdict, LEAKS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, bound: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows and columns of docs into which no item leaks."""
    rows = known_windows(benchmark, bound)
    if rows is None:
        bad = find_leaks(docs, benchmark, bound).select("doc_id", "text_hash").distinct().alias("bad")
        packed = docs.select(F.struct("*").alias("row"))  # so that no column of docs can clash with the keys
        same = F.expr("cast(row.doc_id as long) <=> bad.doc_id and xxhash64(cast(row.text as string)) = bad.text_hash")
        return packed.join(bad, same, "left_anti").select("row.*")
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            for part in slices_of(batch):
                leaky = {r[0] for r in matcher.leaks(part.column("text").to_pylist())}
                yield part.filter(pa.array([k not in leaky for k in range(part.num_rows)], pa.bool_()))
        del matcher
        release_memory()

    return docs.mapInArrow(run, docs.schema)
