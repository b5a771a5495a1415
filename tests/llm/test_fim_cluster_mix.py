"""Fill-in-middle, sort-means and mixing: against plain versions, and the cases at the edges."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from haplospan.llm import fim, mixing, queries, sortmeans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op9_ngram_jaccard", "op11_fill_in_middle", "op12_sort_means", "op13_mixing"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    got = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    assert got == sorted(repr(r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()) and got


# ---------------------------------------------------------------- fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    pieces = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(pieces)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (pieces[:low], pieces[low:high], pieces[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, output, sizes = "plain", text, (None, None)
    else:
        form = "spm" if h[3] % 100 < 20 else "psm"
        output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
        sizes = len(prefix), len(middle)
    return (doc_id, n, form, *sizes, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


ODD = [
    None, "", " ", "a", "😀", "😀😀", "a😀b", "😀a😀", "\n\n", "\r\n\x85 x", "<P>", "a<S>b", "x<M", "<P", "P>", "<S<P", "é", "é", "word", "two words", "\x00a\x00",
    "𝒜𝒷A", "ſK", "<<P>>", "a.b*c|d\\e$f^", "퟿\U0010ffff", "ab " * 3000, "x" * 100_000, "\U0001f468‍\U0001f469 " * 500,
]


def test_fim_odd_texts(spark):
    draw = random.Random(3)
    letters = "abZ <>PSM\n\t.é😀𝒜1"
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id here"), (5, "😀😀"), (5, "😀😀"), (-7, "negative id")]
    rows += [(1000 + k, "".join(draw.choice(letters) for _ in range(draw.randrange(40)))) for k in range(1500)]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, form string, pieces int")
    got = [tuple(r) for r in fim.digests(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr(plain_fim(*r)) for r in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(fim.GRAMMARS))
def test_units_of_every_grammar(spark, name):
    texts = [t or "" for t in ODD] + ["one\ntwo\n\nthree", "\na", "a\n", "  a \t b", "\n"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", fim.units(F.col("text"), fim.GRAMMARS[name]).alias("u")).collect()
    for k, pieces in got:
        assert pieces == re.findall(fim.GRAMMARS[name], texts[k])


def test_grammars_that_do_not_hold_all_characters_once():
    for grammar in ("[a-z]+|[0-9]", "[a-z]+|[^0-9]|[0-9]", "(a|b)", "[a-z]{2}|[^a-z]"):
        with pytest.raises(ValueError):
            fim.boundary(grammar)


# ---------------------------------------------------------------- sort-means


def plain_means(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:clusters]
    centroids = [q for _, q in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        of = assign()
        for k in range(len(centroids)):
            mine = [q for (_, q), (_, n) in zip(kept, of, strict=True) if n == k]
            if mine:
                centroids[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    of = assign()
    total = {k: sum(d for d, n in of if n == k) for k in range(len(centroids))}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, n, d, total[n], sum(total.values()), hashes[n])) for (i, _), (d, n) in zip(kept, of, strict=True))


def test_sort_means_with_ties_and_odd_rows(spark):
    draw = random.Random(5)
    rows = [(k, [draw.choice([-1.0, 0.0, 1 / 64, 0.5]) if d < 3 else 0.25 for d in range(64)]) for k in range(300)]  # few different vectors, so many ties
    rows += [(0, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (None, rows[3][1])]
    bad = [(400, None), (401, [0.1] * 63), (402, [0.1] * 65), (403, [None] + [0.1] * 63), (404, [math.nan] * 64), (405, [math.inf] + [0.0] * 63), (406, [])]
    frame = spark.createDataFrame([(*r, 9, 9) for r in rows + bad], "vec_id long, embedding array<double>, cluster int, distance int")
    assert sorted(repr(tuple(r)) for r in sortmeans.clustered(frame).collect()) == plain_means(rows)
    few = spark.createDataFrame([(*r, 9) for r in rows[:5]], "vec_id long, embedding array<double>, values int")
    assert sorted(repr(tuple(r)) for r in sortmeans.clustered(few).collect()) == plain_means(rows[:5])
    assert sortmeans.clustered(few.limit(0)).count() == 0


def test_too_large_components(spark):
    frame = spark.createDataFrame([(1, [1e18] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component is beyond"):
        sortmeans.clustered(frame).collect()


def test_the_walk_is_exact_and_short():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-3, 4, (40, 4))  # small numbers, so many distances are equal
    values = rng.integers(-3, 4, (2000, 4))
    apart, order = sortmeans.between(centroids)
    want = ((values[:, None] - centroids[None]) ** 2).sum(axis=2)
    cluster, distance, _ = sortmeans.nearest(values, rng.integers(0, 40, 2000), centroids, apart, order)
    assert (cluster == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
    again, _, made = sortmeans.nearest(values, cluster, centroids, apart, order)
    assert (again == cluster).all() and made < want.size / 2


# ---------------------------------------------------------------- mixing


def plain_mix(rows, quality):
    """rows: doc_id, text, source; ids tell them apart."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    of = {}
    for i, _, s in rows:
        of.setdefault(s, []).append(i)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    has = {s: sum(size[i] for i in of[s]) for s in names}
    whole, held = sum(has.values()), set()
    while True:
        left = whole - sum(3 * has[s] for s in held)
        open_weight = sum(weight[s] for s in names if s not in held)
        level = left / open_weight if open_weight else 0
        more = {s for s in names if s not in held and weight[s] * level > 3 * has[s]}
        if not more:
            break
        held |= more
    out = {}
    for s in names:
        target = float(3 * has[s]) if s in held else weight[s] * level
        budget = round(target)
        epochs, rest = divmod(budget, has[s]) if has[s] else (0, 0)

        def key(i):
            u = (int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[:13], 16) + 1) / 2**52
            return -math.log(u) / quality.get(i, 1.0), i

        for i in sorted(of[s], key=key):
            part = max(0, min(size[i], rest))
            rest -= size[i]
            out[i] = (size[i], has[s], target, size[i] * epochs + part)
    return out


SOURCES = ["a", "b", "B", "é", "😀", "￿", "", None]


def mix_rows(seed, n=400):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        s = "b" if draw.random() < 0.4 else draw.choice(SOURCES)
        words = 0 if s == "" else draw.randrange(2000) if draw.random() < 0.02 else draw.randrange(30)
        rows.append((k, None if draw.random() < 0.05 else draw.choice([" ", "\n", "\x0b"]).join(["w x"] * words), s))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_against_a_loop(spark, seed):
    rows = mix_rows(seed)
    quality = {k: [0.5, 2.0, 1.25][k % 3] for k in range(0, 400, 2)}
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, weight int")
    weights = spark.createDataFrame(list(quality.items()), "labelled long, weight double")
    got = mixing.mixed(docs, weights).collect()
    assert {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in got} == plain_mix(rows, quality) and len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] == r["copies"] * r["size"] + r["part"] <= 3 * r["size"] and r["part"] < max(1, r["size"])
        by.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(t) - target) <= 0.5 for (_, target), t in by.items())
    assert abs(sum(t for _, t in by) - sum({r["source"]: r["source_size"] for r in got}.values())) < 1e-6


def test_mixing_odd_tables(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (1, "a b", "s"), (1, "a b", "s"), (1, "other text", "s"), (2, None, "t"), (3, "", None), (4, "one two three", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    again = [sorted(map(repr, mixing.mixed(docs.repartition(k)).collect())) for k in (1, 3)]
    assert again[0] == again[1] and len(again[0]) == len(rows)
    assert mixing.mixed(docs.limit(0)).count() == 0
    nothing = mixing.mixed(docs.where("doc_id = 2")).first()
    assert (nothing["size"], nothing["target"], nothing["taken"]) == (0, 0.0, 0)
    bad = spark.createDataFrame([(1, -1.0), (4, math.nan)], "labelled long, weight double")
    assert mixing.mixed(docs, bad).count() == len(rows)


def test_quality_decides_who_is_taken(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("w x y z").alias("text"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    got = mixing.mixed(docs, mixing.label_weights(labels)).where("source = 'a'").groupBy(F.col("doc_id") % 2).agg(F.sum("taken")).collect()
    of = dict(map(tuple, got))
    assert of[0] + of[1] == 8000 and of[1] > 1.6 * of[0]


def test_the_mixture_itself(spark):
    rows = [r for r in mix_rows(9, 120)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, copies int")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs).collect()}
    made = mixing.mixture(docs).collect()
    words = {}
    for r in made:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == {k: v for k, v in taken.items() if v}
