"""Sharding, url filters, top-k search and the Jaccard join: against plain versions, and the cases at the edges."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplospan.llm import jaccard, queries, sharding, topk, urlfilter

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- sharding


def test_sharding(spark):
    rows = queries.op3_sharding(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    load, seen = [0] * 8, {}
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r["shard"]] += r["size"]
        seen.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in seen.values())
    assert max(load) - min(load) <= max(r["size"] for r in rows)


def test_sharding_odd_rows(spark):
    rows = [(None, None, "s"), (None, "a", "s"), (1, "a", "s"), (1, "a", "s"), (2, "", "s"), (3, "é" * 1000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard_documents(docs).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 2, 2, 2, 2001]
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_growth_moves_rows_into_the_new_shard_only(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    old = sharding.shard_map(sharding.records(docs, 512), 512, 4).where("version = 1")
    new = sharding.grow_map(old, 4)
    a, b = ({r["virtual_slot"]: r["shard"] for r in m.collect()} for m in (old, new))
    assert all(b[s] in (a[s], 4) for s in a) and 4 in b.values()
    load = {r["shard"]: r["n"] for r in new.groupBy("shard").agg(F.sum("bytes").alias("n")).collect()}
    assert min(load.values()) > 0.9 * sum(load.values()) / 5


# ---------------------------------------------------------------- urls


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    after = rest[cut:]
    path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


ODD_URLS = [None, "", "no scheme", "http://A.Com/x", "http://a.com", "http://example.com/en/1?x=1", "http://www.example.com/en/", "ftp://x.net/es/#a", "http://net/fr/b", "http://É.net/de/c?k=v", "http://a://b/c", "http://?x", "x://y.example.com/en/z"]


def test_urls_odd(spark):
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(ODD_URLS)] + [(3, ODD_URLS[3], "r"), (None, ODD_URLS[5], "r")], "page_id long, url string, rule string")
    got = urlfilter.judge_urls(pages).collect()
    assert len(got) == len(ODD_URLS) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, verdict = plain_url(ODD_URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_mined_rules_equal_plain_counts(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        tokens = sorted({rng.choice("abcdefg") for _ in range(rng.randint(1, 4))})
        rows.append((tokens, "block" if "a" in tokens and rng.random() < 0.95 else "allow"))
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    kept = urlfilter.mined_rules(labelled, 0.02, 0.8).collect()
    found = {}
    for size in range(1, 5):
        for items in combinations("abcdefg", size):
            have = [v for t, v in rows if set(items) <= set(t)]
            for verdict in ("allow", "block"):
                n = sum(v == verdict for v in have)
                if n >= 0.02 * len(rows) and have and n / len(have) >= 0.8:
                    found[items, verdict] = n / len(have)
    want = {k: c for k, c in found.items() if not any(found.get((tuple(x for x in k[0] if x != i), k[1]), -1) >= c for i in k[0])}
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in kept}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    urls = spark.createDataFrame([(str(k), t) for k, (t, _) in enumerate(rows)], "url string, tokens array<string>")
    verdicts = {r["url"]: r["_mined"] for r in urlfilter.mined_verdicts(urls, urlfilter.mined_rules(labelled, 0.02, 0.8)).collect()}
    support = {(tuple(r["antecedent"]), r["verdict"]): r["support"] for r in kept}
    for k, (t, _) in enumerate(rows):
        fits = [(got[a, v], support[a, v], -len(a), "\n".join(a), v) for a, v in got if set(a) <= set(t)]
        assert verdicts.get(str(k)) == (max(fits)[4] if fits else None)


def test_long_urls_end(spark):
    """Rules of a table whose frequent urls have very many tokens."""
    rng = random.Random(3)
    deep = "/".join(f"dir{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    urls = [f"http://{'.'.join(rng.choice('abcdef') for _ in range(300))}.com/en/{rng.choice('xyz')}" for _ in range(3)]
    urls += [f"http://a.com/en/{deep[: rng.randint(1, len(deep))]}?{'&'.join(f'k{c}=1' for c in 'abcdefghij' * 20)}" for _ in range(20)]
    urls += [f"http://example.com/en/{deep}/{rng.choice('xyz')}" for _ in range(20)]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, *[u.replace(".com", ".org") for u in urls]])], "page_id long, url string")
    got = urlfilter.judge_urls(pages).collect()
    assert len(got) == 2 * len(urls) and all(r["verdict"] in ("allow", "block") for r in got)


def test_few_tokens_combine_with_exact_counts(spark):
    """With a bound on the tokens that combine, what is found is a part of all rules, with the same figures, and all rules of one token."""
    rng = random.Random(11)
    rows = []
    for _ in range(400):
        tokens = sorted({rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))})
        rows.append((tokens, "block" if {"a", "b"} <= set(tokens) or rng.random() < 0.1 else "allow"))
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    whole, part = ({(tuple(r["antecedent"]), r["verdict"]): (r["confidence"], r["support"]) for r in urlfilter.mined_rules(labelled, 0.02, 0.7, n).collect()} for n in (8, 3))
    assert whole.items() >= {k: v for k, v in part.items() if len(k[0]) == 1}.items()
    for (antecedent, verdict), (confidence, support) in part.items():
        have = [v for t, v in rows if set(antecedent) <= set(t)]
        assert confidence == pytest.approx(have.count(verdict) / len(have)) and support == pytest.approx(have.count(verdict) / len(rows))
    assert (("a", "b"), "block") in whole


def test_mined_rules_on_held_out_labels(spark):
    """What mined rules say of urls whose label they have not seen, against calling all of them by the most frequent label."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    known = urlfilter.judge_urls(pages).where("rule is not null").select("page_id", "verdict")
    rows = pages.join(known, "page_id").select("page_id", "url", "verdict", (F.crc32("url") % 3 == 0).alias("out"))
    got = urlfilter.judge_urls(rows.where("out").drop("verdict"), rows.where("not out"), rules=()).select("page_id", F.col("verdict").alias("said"))
    n, right, most = rows.where("out").join(got, "page_id").agg(F.count(F.lit(1)), F.sum((F.col("said") == F.col("verdict")).cast("int")), F.sum((F.col("verdict") == "allow").cast("int"))).first()
    print(f"held out {n}: right {right / n:.3f}, one label for all {max(most, n - most) / n:.3f}")
    assert right / n >= 0.95 and right > max(most, n - most)


# ---------------------------------------------------------------- search


def plain_top(vectors, k=5):
    width = max((len(v) for _, v in vectors), default=0)
    m = np.array([[*v, *[0] * (width - len(v))] for _, v in vectors], dtype=np.int64).reshape(len(vectors), width)
    out = []
    for n, (q, _) in enumerate(vectors):
        if q % 50 == 0:
            scores = m @ m[n]
            order = sorted((i for i in range(len(vectors)) if i != n), key=lambda i: (-scores[i], vectors[i][0]))[:k]
            out += [(q, r + 1, vectors[i][0], int(scores[i])) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("rows", [7, 130, 900])
def test_top_k(spark, rows):
    rng = np.random.default_rng(rows)
    data = [(k, rng.normal(0, 0.2, 12).round(3).tolist()) for k in range(rows)]
    for k in range(0, rows, 3):
        data[k] = (k, data[0][1])  # a third of all rows is one vector
    data[5] = (5, data[5][1][:4])
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=200, query_rows=3).collect()
    want = plain_top([(k, [int(np.floor(256 * x)) for x in v]) for k, v in data])
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_top_k_odd_rows(spark):
    data = [(0, [1.0, 2.0], "r"), (50, None, "r"), (1, [None, 1.0], "r"), (2, [float("nan"), 1.0], "r"), (3, [float("inf"), 1.0], "r"), (None, [1.0, 1.0], "r"), (4, [], "r"), (5, [1e6, -1e6], "r")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, rank string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 4, 0), (0, 5, 256 * 256_000_000 - 512 * 256_000_000)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- similar documents


def word_sets(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def plain_classes(rows):
    sets = [word_sets(t) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), 1 << 60), i)
    return sorted((i, len(sets[k]), low[find(k)], links[k]) for k, (i, _) in enumerate(rows))


def near_copies(rng, n):
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(55))
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words[rng.randint(0, 2) :])
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 150)))
            if kind > 0.8:
                text += " " + passage
        texts.append(text or "w1")
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_all_pairs(spark, seed):
    rows = near_copies(random.Random(seed), 250)
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == plain_classes(rows)


def test_jaccard_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 3)
    rows = near_copies(random.Random(3), 150)
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == plain_classes(rows)


def with_passage(rng, n):
    """Texts of which many hold one passage, some twice in the table."""
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 40))) + (" " + passage if k % 3 else "")) for k in range(n)]
    return rows + [(n + k, rows[k][1]) for k in range(0, n, 7)]


def test_jaccard_deals_heavy_buckets_to_parts(spark, monkeypatch):
    rows = near_copies(random.Random(5), 120) + [(1000 + k, t) for k, t in with_passage(random.Random(6), 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    postings = jaccard.written(jaccard.with_hash(docs).select("text").mapInArrow(jaccard.post(4), jaccard.POSTINGS), "postings")

    def expanded(shared):
        return sorted(
            (r["bucket"], int(p), int(n), int(s), int(c), r["home"])
            for r in shared.collect()
            for p, n, s, c in zip(*(np.frombuffer(r[name], kind) for name, kind in (("prints", "<u4"), ("nodes", "<i8"), ("sizes", "<u4"), ("counts", "<u4"))), strict=True)
        )

    whole = jaccard.shared_shingles
    light = expanded(whole(postings, 1 << 40, 4))
    held = postings.groupBy("bucket").agg(F.sum("held").alias("n")).agg(F.min("n"), F.max("n")).first()
    monkeypatch.setattr(jaccard, "HEAVY", 1)
    some = held[1] - 1  # the largest bucket alone, or all, in few or many parts
    assert light and all(expanded(whole(postings, share, 4)) == light for share in (some, held[0] // 3, 25))
    monkeypatch.setattr(jaccard, "shared_shingles", lambda p, _, buckets: whole(p, 40, buckets))
    got = jaccard.jaccard_classes(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == plain_classes(rows)


def test_prefix_bounds():
    for n in range(1, 1200):
        m = np.arange(-(-3 * n // 4), 4 * n // 3 + 1)
        o = -(-3 * (n + m) // 7)
        both = np.minimum(np.minimum(jaccard.prefix(np.int64(n)) - n + o, jaccard.prefix(m) - m + o), o)
        assert (both >= jaccard.needed(n)).all()
        assert (abs(jaccard.size_class(m.astype(float)) - jaccard.size_class(float(n))) <= 1).all()


def test_jaccard_odd_rows(spark):
    long = " ".join(f"q{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (5, "a  B"), (None, "a b"), (6, "b a"), (7, long), (8, long + " end"), (9, long), (None, "only null id"), (10, "a b c d e")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (4, 1, 4, 3), (5, 1, 4, 3), (5, 1, 4, 3), (0, 1, 4, 3), (6, 1, 6, 0), (7, 2996, 7, 2), (8, 2997, 7, 2), (9, 2996, 7, 2), (0, 1, None, 0), (10, 1, 10, 0)], key=str)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 10]
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0


def test_scores_that_could_overflow_are_refused(spark):
    for large, said in ((2e7, "63 bits"), (-1e17, "")):
        rows = spark.createDataFrame([(k, [large] * 64) for k in range(3)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match=said):
            topk.top_k(rows, F.col("vec_id") == 0)


def all_rules(rows, support, confidence, verdicts=("allow", "block")):
    """Every rule of every subset of every url, pruned as stated."""
    least = max(urlfilter.MIN_COUNT, -(-int(support * len(rows) * 1000) // 1000))
    sets = {frozenset(c) for t, _ in rows for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}
    found = {}
    for s in sets:
        have = [v for t, v in rows if s <= set(t)]
        for v in verdicts:
            if have.count(v) >= least and have.count(v) / len(have) >= confidence:
                found[s, v] = have.count(v) / len(have)
    return {(tuple(sorted(s)), v): c for (s, v), c in found.items() if not any(found.get((s - {x}, v), 0) >= c for x in s if len(s) > 1)}


def test_no_rule_of_a_full_enumeration_is_lost(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(urlfilter, "WIDE", 20)
    rows = []
    for _ in range(150):
        tokens = {rng.choice("abcdefghijklmn") for _ in range(rng.randint(3, 12))}
        tokens |= {"twin of a", "third of a"} if "a" in tokens else set()  # tokens of the same urls
        rows.append((sorted(tokens), "block" if {"a", "b"} <= tokens or {"c", "d", "e"} <= tokens or rng.random() < 0.05 else "allow"))
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in urlfilter.mined_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.04, 0.8).collect()}
    want = all_rules(rows, 0.04, 0.8)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    monkeypatch.setattr(urlfilter, "WIDE", 0)
    again = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in urlfilter.mined_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.04, 0.8).collect()}
    assert again == got
    assert max(len(a) for a, _ in want) >= 3 and any("twin of a" in a and len(a) > 1 for a, _ in want)


def test_very_long_urls_end(spark):
    long = [f"s{k}" for k in range(1000)]
    rows = [(["x", *long], "allow"), (["x", *long], "block"), (["x", *long], "block"), *[(["x", f"y{k % 3}"], "allow" if k % 2 else "block") for k in range(40)]]
    assert urlfilter.mined_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.01, 0.6).count() >= 1000
