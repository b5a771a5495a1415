"""Language of the words of a text by a linear-chain conditional random field.

Every word (a run of letters, lower-cased) has affix, character n-gram and lexicon features, hashed into DIMENSIONS
places; a state is a language; transitions between the states of neighbouring words are learned.  Forward-backward gives
each word its probabilities over the languages given the whole text, which labels code-switched text
word by word; a text's language is the one with the highest mean.

Training takes a bounded sample of labelled rows (about SAMPLE for each of the LANGUAGES most frequent languages, chosen by a hash of
the id, at most WINDOW code points of each) and composes sequences of one to three segments in different languages, so that
transitions are learned as well.  Prediction reads whole texts and nothing but the text.

A model for filtering has one state more, for words of no language: it learns it from words of the sample whose letters are
dealt out anew.  A document goes if that state takes more than half of its words on the mean, however the rest is
shared among languages, and its letters look unlike any language, or if it has no letter; where no language could be learned, all documents
with letters stay.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is every text if nothing could be
learned; repeated rows give repeated rows; a null id is kept and never trained on; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

DIMENSIONS = 1 << 16
SAMPLE = 400
LANGUAGES = 200
OTHER = "und"
WINDOW = 4000
EPOCHS = 3
RATE = 0.3
DECAY = 1e-6
#: Words of a generation remembered with their scores in each Python worker.
MEMORY = 100_000
CHUNK_WORDS = 300_000


@functools.cache
def letters():
    import regex

    return regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    return letters().findall(text.lower()) if text else []


def hashed(seed: int, *columns: np.ndarray) -> np.ndarray:
    h = np.full(len(columns[0]), seed + 1, dtype=np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of words, word by word, and their numbers.

    A word is framed by ^ and $; it has its n-grams of two and three characters, its first and last two to four, and itself.  Every kind
    of feature has a seed of its own, so no two kinds share a name.
    """
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    c = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    end = np.cumsum(size)
    start = end - size
    owner = np.repeat(np.arange(len(words)), size)
    found, owners = [], []
    for k in (2, 3):
        at = np.flatnonzero(owner[: len(c) - k + 1] == owner[k - 1 :])
        found.append(hashed(k, *(c[at + j] for j in range(k))))
        owners.append(owner[at])
    for k in (2, 3, 4):
        some = np.flatnonzero(size >= k)
        for seed, at in ((10 + k, start[some]), (20 + k, end[some] - k)):
            found.append(hashed(seed, *(c[at + j] for j in range(k))))
            owners.append(some)
    found.append(hashed(30, np.add.reduceat(hashed(31, c, (np.arange(len(c)) - start[owner]).astype(np.uint64)), start)))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    return (np.concatenate(found) % np.uint64(DIMENSIONS)).astype(np.int64)[np.argsort(owner, kind="stable")], np.bincount(owner)


def padded(words: list[str]) -> np.ndarray:
    """Features of words as a matrix; DIMENSIONS, a place without weight, fills it."""
    flat, sizes = features(words)
    out = np.full((len(words), int(sizes.max(initial=1))), DIMENSIONS, dtype=np.int32)
    row = np.repeat(np.arange(len(words)), sizes)
    out[row, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]] = flat
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMENSIONS + 1 by languages
    moves: np.ndarray  # languages by languages
    start: np.ndarray


def marginals(scores: np.ndarray, sizes: list[int], model: Model, with_moves: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probabilities of each word, and if wanted the expected moves, of texts whose words lie one after another in scores.

    Forward-backward runs over all texts side by side; longer texts come first, so the texts still running are always the first ones.
    """
    labels = scores.shape[1]
    order = np.argsort(-np.array(sizes, dtype=np.int64), kind="stable")
    length = np.array(sizes, dtype=np.int64)[order]
    first = (np.cumsum(sizes) - sizes)[order]
    running = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(model.moves).astype(emit.dtype)
    ahead, behind = np.empty_like(emit), np.ones_like(emit)
    for t, n in enumerate(running.tolist()):
        at = first[:n] + t
        a = (ahead[at - 1] @ move if t else np.exp(model.start).astype(emit.dtype)[None, :]) * emit[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(running) - 2, -1, -1):
        at = first[: running[t + 1]] + t
        b = (emit[at + 1] * behind[at + 1]) @ move.T
        behind[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * behind
    both /= both.sum(axis=1, keepdims=True)
    if not with_moves:
        return both, None
    inner = np.ones(len(emit), dtype=bool)
    inner[first[length > 0]] = False
    at = np.flatnonzero(inner)
    pair = ahead[at - 1][:, :, None] * move[None] * (emit[at] * behind[at])[:, None, :]
    moved = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(at) else np.zeros((labels, labels))
    return both, moved


def compose(samples: list[list[list[str]]], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Sequences of one to three segments; each word of the samples is used once."""
    pieces = []
    for label, texts in enumerate(samples):
        for words in texts:
            at = 0
            while at < len(words):
                n = int(rng.integers(4, 60))
                pieces.append((label, words[at : at + n]))
                at += n
    rng.shuffle(pieces)
    out, at = [], 0
    while at < len(pieces):
        n = int(rng.integers(1, 4))
        some = pieces[at : at + n]
        out.append(([w for _, p in some for w in p], [label for label, p in some for _ in p]))
        at += n
    return out


def dealt_anew(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Texts with as many words as given, as long as those, of letters of the texts that follow one another by chance."""
    words = [words_of(t) for t in texts]
    alphabet = sorted({c for ws in words for w in ws for c in w})
    return [" ".join("".join(alphabet[i] for i in rng.integers(len(alphabet), size=len(w))) for w in ws) for ws in words]


def train(samples: dict[str, list[str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Model:
    """Fit by AdaGrad on the log-likelihood.  samples: texts by language."""
    names = sorted(samples)
    rng = np.random.default_rng(seed)
    sequences = compose([[words_of(t) for t in samples[n]] for n in names], rng)
    vocabulary = {w: k for k, w in enumerate(sorted({w for ws, _ in sequences for w in ws}))}
    table = padded(list(vocabulary))
    model = Model(names, np.zeros((DIMENSIONS + 1, len(names))), np.zeros((len(names), len(names))), np.zeros(len(names)))
    squares = [np.full_like(x, 1e-6) for x in (model.weights, model.moves, model.start)]
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // 64)):
            some = [sequences[k] for k in batch if sequences[k][0]]
            if not some:
                continue
            ids = np.array([vocabulary[w] for ws, _ in some for w in ws])
            gold = np.array([y for _, ys in some for y in ys])
            sizes = [len(ws) for ws, _ in some]
            used, place = np.unique(ids, return_inverse=True)
            scores = model.weights[table[used]].sum(axis=1)[place]
            found, moved = marginals(scores, sizes, model, with_moves=True)
            found[np.arange(len(gold)), gold] -= 1
            starts = np.cumsum(sizes) - sizes
            inner = np.ones(len(gold), dtype=bool)
            inner[starts] = False
            at = np.flatnonzero(inner)
            np.subtract.at(moved, (gold[at - 1], gold[at]), 1)
            by_word = np.stack([np.bincount(place, weights=found[:, k], minlength=len(used)) for k in range(len(names))], axis=1)
            flat = table[used].ravel()
            slopes = np.stack([np.bincount(flat, weights=np.repeat(by_word[:, k], table.shape[1]), minlength=DIMENSIONS + 1) for k in range(len(names))], axis=1)
            for of, slope, square in zip((model.weights, model.moves, model.start), (slopes, moved, found[starts].sum(axis=0)), squares, strict=True):
                slope = slope / len(some) + DECAY * of
                square += slope**2
                of -= rate * slope / np.sqrt(square)
            model.weights[DIMENSIONS] = 0
    return model


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def fit(docs: DataFrame, sample: int = SAMPLE, window: int = WINDOW, languages: int = LANGUAGES, other: bool = False) -> Model:
    """Learn from about `sample` labelled rows of each language whose id is not held out; other: also a state for words of no language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    samples: dict[str, list[str]] = {n: [] for n in counts}
    if counts:
        of = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
        bound = F.element_at(F.create_map(*[x for n, c in counts.items() for x in (F.lit(n), F.lit(min(1.0, sample / c) * (1 << 30)))]), F.col("lang"))
        start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - window + 1, F.lit(1))) + 1
        chosen = known.where(of < bound).select("lang", F.substring("text", start.cast("int"), F.lit(window)).alias("text"), of.alias("of"), "doc_id")
        for r in chosen.orderBy("of", "doc_id", "text").limit(2 * sample * len(counts)).collect():
            samples[r["lang"]].append(r["text"])
    if other and any(words_of(t) for texts in samples.values() for t in texts):
        some = [t for texts in samples.values() for t in texts[: sample // len(samples) + 1]]
        samples[OTHER] = samples.get(OTHER, []) + dealt_anew(some, np.random.default_rng(1))
    return train(samples)


class Scorer:
    """Scores of words, remembered in two generations: when the young one is full it becomes the old one, and words met again move over."""

    def __init__(self, model: Model):
        self.model, self.place, self.old_place = model, {}, {}
        self.weights = model.weights.astype(np.float32)
        self.table = self.old_table = np.zeros((0, len(model.languages)), dtype=np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.place) > MEMORY:
            self.old_place, self.old_table = self.place, self.table
            self.place, self.table = {}, self.table[:0]
        new = set(words).difference(self.place)
        again = [w for w in new if w in self.old_place]
        fresh = list(new.difference(again))
        parts = [self.table, self.old_table[np.fromiter(map(self.old_place.__getitem__, again), np.int64, len(again))]]
        for at in range(0, len(fresh), 8192):
            places, sizes = features(fresh[at : at + 8192])
            parts.append(np.add.reduceat(self.weights[places], np.cumsum(sizes) - sizes, axis=0))
        if new:
            self.place.update(zip([*again, *fresh], range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate(parts)
        return self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]

    def chunks(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
        """Numbers of texts, their word counts and the probabilities of their words, one after another.

        Texts are taken by length, so that those side by side end together.
        """
        held = [words_of(t) for t in texts]
        order = sorted((k for k in range(len(held)) if held[k]), key=lambda k: -len(held[k]))
        at = 0
        while at < len(order):
            n, some = 0, []
            while at < len(order) and (not some or n + len(held[order[at]]) <= CHUNK_WORDS):
                some.append(order[at])
                n += len(held[order[at]])
                at += 1
            flat = [w for k in some for w in held[k]]
            sizes = [len(held[k]) for k in some]
            yield some, sizes, marginals(self.scores(flat), sizes, self.model)[0]


def predicted(scorer: Scorer, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, best = ["und"] * len(texts), [0.0] * len(texts)
    if scorer.model.languages:
        for some, sizes, found in scorer.chunks(texts):
            means = np.add.reduceat(found, np.cumsum(sizes) - sizes, axis=0) / np.array(sizes)[:, None]
            for k, m in zip(some, means, strict=True):
                names[k], best[k] = scorer.model.languages[int(m.argmax())], float(min(1.0, m.max()))
    return names, best


def slices_of(batch: pa.RecordBatch, chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many characters of text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        floor = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, floor + chars, side="right")))
        yield batch.slice(start, end - start)
        start = end


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices_of(batch):
                names, best = predicted(scorer, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(best, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        del scorer
        release_memory()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_runs(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and runs: array of (lang, start, end), the runs of words with one most probable language, by code points."""
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices_of(batch):
                texts = part.column("text").to_pylist()
                out: list[list[dict]] = [[] for _ in texts]
                for some, _, found in scorer.chunks(texts) if model.languages else ():
                    best, at = found.argmax(axis=1).tolist(), 0
                    for k in some:
                        for m in letters().finditer(texts[k] if len(texts[k].lower()) == len(texts[k]) else texts[k].lower()):
                            lang = model.languages[best[at]]
                            if out[k] and out[k][-1]["lang"] == lang:
                                out[k][-1]["end"] = m.end()
                            else:
                                out[k].append({"lang": lang, "start": m.start(), "end": m.end()})
                            at += 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "runs"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, runs array<struct<lang:string,start:int,end:int>>")


#: Code points with a place of their own in the tables below; scripts beyond (ideographs, syllables of Korean) are never doubted.
NEAR = 0x3000
#: When the letters of a text give reason for doubt: least number, how evenly they are used at most, share of words that come once,
#: of words with a capital after a small letter or letters of two scripts, and of letters among visible characters.
LEAST_LETTERS, EVEN, ONCE, ODD_WORDS, LEAST_SHARE = 100, 1.25, 0.8, 0.3, 0.3


@functools.cache
def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point below NEAR: visible, case (1 small, 2 capital, 3 other letters, else 0), script, small form."""
    chars = [chr(k) for k in range(NEAR)]
    visible = np.array([not c.isspace() and c.isprintable() for c in chars])
    case = np.array([(1 if c.islower() else 2 if c.isupper() else 3) if c.isalpha() else 0 for c in chars], dtype=np.int8)
    script = np.searchsorted([0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900], np.arange(NEAR), side="right").astype(np.int8)
    script[0x1E00:0x1F00], script[0x1F00:0x2000] = 0, 2  # more of Latin and Greek
    small = np.array([ord(c.lower()) if len(c.lower()) == 1 and ord(c.lower()) < NEAR else k for k, c in enumerate(chars)])
    return visible, case, script, small


def doubtful(text: str) -> bool:
    """Whether a text looks unlike any language, whatever its words: letters used about as often as each other in words that hardly come again,
    words with capitals or other scripts inside, or few letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    visible, case, script, small = letter_tables()
    near = codes[codes < NEAR]
    far = len(codes) - len(near)
    kinds = case[near]
    n = int((kinds > 0).sum())
    if far > n or n < LEAST_LETTERS:
        return False
    if n < LEAST_SHARE * int(visible[near].sum()):
        return True
    words = int((kinds > 0)[:1].sum() + ((kinds[1:] > 0) & (kinds[:-1] == 0)).sum())
    inside = (kinds[1:] > 0) & (kinds[:-1] > 0)
    odd = ((kinds[:-1] == 1) & (kinds[1:] == 2)) | (script[near[1:]] != script[near[:-1]])
    if (odd & inside).sum() > ODD_WORDS * words:
        return True
    counts = np.bincount(small[near[kinds > 0]])
    counts = counts[counts > 0].astype(np.float64)
    if (counts**2).sum() / n**2 * len(counts) >= EVEN:
        return False
    found = words_of(text)
    return len(set(found)) > ONCE * len(found)


def identified(scorer: Scorer, texts: list[str | None]) -> np.ndarray:
    """Whether each text has letters and is not one that the model holds for no language and that is doubtful as well."""
    keep = np.array([bool(t and letters().search(t)) for t in texts], dtype=bool)
    if OTHER in scorer.model.languages:
        other = scorer.model.languages.index(OTHER)
        for some, sizes, found in scorer.chunks(texts):
            share = np.add.reduceat(found[:, other], np.cumsum(sizes) - sizes) / np.array(sizes)
            for k in np.array(some)[share > 0.5].tolist():
                keep[k] &= not doubtful(texts[k])
    return keep


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows and columns of docs with letters, without those of which words of no language take more than half and that are doubtful.

    The model reads every text with letters.  What it holds for no language is checked by its letters alone, so texts of languages that the model
    has never met stay.  Without a state for no language in the model, all rows with letters stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices_of(batch):
                yield part.filter(pa.array(identified(scorer, part.column("text").to_pylist())))
        del scorer
        release_memory()

    return docs.mapInArrow(run, docs.schema)
