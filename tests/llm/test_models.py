"""Language ID, decontamination, HTML text and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haplospan.llm import decontaminate, htmltext, jaccard, langid, pii, queries

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- language


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language_id(spark, SF).join(docs, "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 200 and right / n > 0.97


def test_language_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !"), (4, "the and of the with that for"), (4, "the and of the with that for"), (None, "der und die nicht ein")]
    docs = spark.createDataFrame([(i, t, "xx", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[None][0] == "de"
    assert langid.keep_identified(docs, model).count() == 3
    empty = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_texts_of_no_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, other=True)
    one = {r["lang"]: r["text"] for r in docs.where("length(text) > 1500 and not contains(text, '%%%')").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    parts = {k: " ".join(t.split()[:60]) for k, t in one.items()}
    rng = random.Random(5)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rng.randint(2, 9))) for _ in range(200))
    rows = [(1, " ".join(parts.values())), (2, noise), (3, "12 34 !"), (4, None), (5, parts["de"]), (6, parts["en"] + " " + noise[:150]), (7, "the and of " * 20_000)]
    own = spark.createDataFrame([(k, t, "y") for k, t in rows], "doc_id long, text string, share string")
    kept = langid.keep_identified(own, model)
    assert kept.columns == own.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 5, 6, 7]
    assert langid.keep_identified(own, langid.fit(docs.limit(0), other=True)).count() == 5
    clean = docs.where("text rlike '[A-Za-z]'")
    assert langid.keep_identified(clean, model).count() >= 0.999 * clean.count()


UNSEEN = [
    "The quick brown fox jumps over the lazy dog and the people were happy. " * 4,
    "click here buy now cheap watches free shipping click here buy now " * 10,
    "Большинство людей никогда не задумывается о том, откуда берётся вода в их кранах и куда она потом уходит. " * 2,
    "Wer reitet so spät durch Nacht und Wind? Es ist der Vater mit seinem Kind; er hat den Knaben wohl in dem Arm, er faßt ihn sicher, er hält ihn warm.",
    "多数の人々は水がどこから来るのか考えたことがない。这是一个关于语言识别的测试句子，没有训练过的词汇。" * 5,
    "Η πλειονότητα των ανθρώπων δεν σκέφτεται ποτέ από πού έρχεται το νερό στις βρύσες τους και πού πηγαίνει μετά από αυτό. ",
    "def total(rows):\n    result = 0\n    for row in rows:\n        result += row.price * row.count\n    return result\n" * 4,
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
]


def test_languages_that_were_never_met_stay_and_junk_goes(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), other=True)
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = [
        " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(150)),
        " ".join("".join(rng.choice(letters + letters.upper()) for _ in range(rng.randint(6, 12))) for _ in range(120)),
        " ".join("".join(rng.choice(letters + "абвгдежзиклмнопрст") for _ in range(rng.randint(4, 9))) for _ in range(120)),
    ]
    docs = spark.createDataFrame(list(enumerate(UNSEEN + junk)), "doc_id long, text string")
    kept = {r["doc_id"] for r in langid.keep_identified(docs, model).collect()}
    assert kept == set(range(len(UNSEEN))), kept
    assert [langid.doubtful(t) for t in UNSEEN] == [False] * len(UNSEEN) and all(map(langid.doubtful, junk))


def test_the_model_reads_every_text_with_letters():
    class Seen(langid.Scorer):
        def scores(self, words):
            self.words = getattr(self, "words", []) + words
            return super().scores(words)

    model = langid.Model(["en", langid.OTHER], np.zeros((langid.DIMENSIONS + 1, 2)), np.zeros((2, 2)), np.array([0.0, 9.0]))  # holds any first word for no language
    scorer = Seen(model)
    assert langid.identified(scorer, [UNSEEN[0], None, "12", "one"]).tolist() == [True, False, False, True]
    assert sorted(scorer.words) == sorted(langid.words_of(UNSEEN[0]) + ["one"])


def test_kinds_of_features_have_their_own_names():
    places, sizes = langid.features(["in", "win", "a", "straße"])
    split = np.split(places, np.cumsum(sizes)[:-1])
    assert len(set(split[0]) & set(split[1])) == 5  # in, n$ and in$ as n-grams, n$ and in$ as endings, but no word
    assert [sorted(langid.features([w])[0].tolist()) for w in ("in", "win", "a", "straße")] == [sorted(x.tolist()) for x in split]
    assert len(langid.features([])[0]) == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    sizes = [4, 1, 5]
    scores = rng.normal(size=(10, 3))
    got, _ = langid.marginals(scores, sizes, model)
    at = 0
    for n in sizes:
        total = np.zeros((n, 3))
        for labels in np.ndindex(*[3] * n):
            w = model.start[labels[0]] + sum(scores[at + t, y] for t, y in enumerate(labels)) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))
            for t, y in enumerate(labels):
                total[t, y] += np.exp(w)
        assert np.allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True))
        at += n


def test_code_switching(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r["lang"]: r["text"] for r in docs.where("length(text) > 1500 and not contains(text, '%%%')").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    a, b = " ".join(one["en"].split()[:60]), " ".join(one["de"].split()[:60])
    runs = langid.label_runs(spark.createDataFrame([(1, a + " " + b)], "doc_id long, text string"), model).first()["runs"]
    assert runs[0]["lang"] == "en" and runs[-1]["lang"] == "de"
    longest = sorted(runs, key=lambda r: r["start"] - r["end"])[:2]
    assert {r["lang"] for r in longest} == {"en", "de"} and sum(r["end"] - r["start"] for r in longest) > 0.8 * len(a + b)


# ---------------------------------------------------------------- benchmark

ITEMS = [
    (1, "A train leaves Berlin at 9 and travels 120 km to reach Paris in 3 hours how fast does it go"),
    (2, "Short item here"),
    (3, None),
    (4, "12 34 56 78 90 12 34 56 78"),
    (5, "A train leaves Berlin at 9 and travels 120 km to reach Paris in 3 hours how fast does it go"),
]
CASES = [
    (10, "Intro words. A train leaves Berlin at 9 and travels 120 km to reach Paris in 3 hours how fast does it go. More.", {(1, False)}),
    (11, "Look: a train leaves Madrid at 7 and travels 450 miles to reach Rome in 5 hours how fast does it go, then", {(1, True)}),
    (12, "a train leaves Madrid at 7 and travels 7 miles to reach Madrid in 7 hours how fast does it go", set()),
    (13, "trains leave at noon and nobody travels anywhere", set()),
    (14, None, set()),
    (15, "", set()),
    (16, "11 22 33 44 55 66 77 88 99", set()),
    (17, "so this short item here is", set()),
]


@pytest.mark.parametrize("bound", [0, decontaminate.BROADCAST_WINDOWS])
def test_leaks(spark, bound):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in CASES] + [(None, CASES[0][1], 1, "x"), (10, CASES[0][1], 1, "x")], "doc_id long, text string, item_id int, hash string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = [(r["doc_id"], r["item_id"], r["changed"]) for r in decontaminate.find_leaks(docs, items, bound).collect()]
    want = [(i, item, changed) for i, _, found in CASES for item, changed in found] + [(None, 1, False), (10, 1, False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = decontaminate.without_leaks(docs, items, bound)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [12, 13, 14, 15, 16, 17]
    assert decontaminate.find_leaks(docs.limit(0), items, bound).count() == 0 and decontaminate.find_leaks(docs, items.limit(0), bound).count() == 0


def test_both_ways_agree(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    a, b = (sorted(map(tuple, decontaminate.find_leaks(docs, items, n).collect())) for n in (0, decontaminate.BROADCAST_WINDOWS))
    assert a == b and a


def test_planted_items_are_found(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    texts = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in docs.collect()}
    want = {(d, i["item_id"]) for d, t in texts.items() for i in items if " ".join(i["text"].split()) in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontamination(spark, SF).collect()}
    assert want <= got and len(got - want) <= 3


def leaks_of(spark, items, docs, bound):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"], r["changed"]) for r in decontaminate.find_leaks(docs, items, bound).collect()}


BOUNDS = pytest.mark.parametrize("bound", [0, decontaminate.BROADCAST_WINDOWS])


@BOUNDS
def test_copies_of_items_with_few_plain_words(spark, bound):
    items = ["John has 3 apples, Mary has 4", "12 kg 34 Anna 56 Berta 78 Clara 90 David", "Name it", "Paris", "John 3 Mary 4 Anna 5 Berta 6 Clara 7 David 8"]
    docs = [f"Some words, then {i} and more" for i in items] + ["John has 5 apples, Paul has 4", "12 kg 34 Anna 56 Berta 77 Clara 90 David", "name it", "paris"]
    assert leaks_of(spark, items, docs, bound) == {(k, k, False) for k in range(len(items))}


@BOUNDS
def test_conflicting_slots_cost_their_windows_only(spark, bound):
    body = "the long road to the old town goes over 3 hills and under 4 bridges before it comes to a small green lake where"
    items = [f"{body} boats cost 3 coins for each of us", "Anna has 3 apples and 4 pears so how many fruits has she got in all today"]
    docs = [f"{body} boats cost 5 coins for each of us", "Anna has 5 apples and 5 pears so how many fruits has she got in all today", f"{body.replace('3', '8')} boats cost 9 coins for each of us"]
    assert leaks_of(spark, items, docs, bound) == {(0, 0, False), (1, 1, True), (2, 0, True)}


def test_windows_left_out_hold_the_conflict():
    def match(at, slots, here):
        return decontaminate.Match(100 + at, at, 8, 30, 30, True, slots, here)

    long = [match(k, ["03"], ["03"]) for k in range(20)]
    assert decontaminate.judge([*long, match(20, ["03", "15"], ["04", "15"])]) == (20, False, 30)
    assert decontaminate.judge([match(k, ["03"], ["05"]) for k in range(4)] + [match(4, ["03"], ["06"]), match(5, [], [])]) == (5, True, 30)
    assert decontaminate.judge([match(k, [f"0{k}"], ["09"]) for k in range(3)]) is None


@BOUNDS
def test_first_words_may_be_names(spark, bound):
    items = ["Maria walks to the market and buys bread", "How many days does it take to paint", "Yesterday we saw Peter. Maria went home with him"]
    docs = [
        f"He asked: {items[0]}, then", f"| {items[1]} |", items[1].lower(), "so it says how many weeks does it take to paint", "He said that Helena walks to the market and buys bread, then",
        "Helena walks to the market and buys bread", "yesterday we saw Paul, Helena went home with him",
    ]
    assert leaks_of(spark, items, docs, bound) == {(0, 0, False), (1, 1, False), (2, 1, False), (3, 1, True), (4, 0, True), (5, 0, True), (6, 2, True)}


def test_reparameterised_copies_are_found(spark):
    """Each benchmark item with numbers, names and units in it, and a document with others in their place."""
    items = [r["text"].split()[:40] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(6)

    def asked(words, names, numbers, unit):
        out = list(words)
        for k, extra in ((3, names[0]), (9, numbers[0]), (10, unit), (17, names[1]), (24, numbers[1]), (30, names[0])):
            out.insert(min(k, len(out)), extra)
        return " ".join(out)

    want = {k: asked(w, ["Anna", "Peter"], ["12", "7.5"], "kg") for k, w in enumerate(items)}
    got = {k: "Well then, " + asked(w, rng.sample(["Tobias", "Malika", "Jorge", "Noor"], 2), rng.sample(["3", "48", "1,250", "0.5"], 2), rng.choice(["km", "lbs", "ml"])) + " as they say" for k, w in enumerate(items)}
    found = leaks_of(spark, [want[k] for k in sorted(want)], [got[k] for k in sorted(got)], decontaminate.BROADCAST_WINDOWS)
    assert sum((k, k, True) in found for k in want) >= 0.9 * len(want)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    assert not leaks_of(spark, [want[k] for k in sorted(want)], [t for t in texts if not any(" ".join(w[:20]) in " ".join((t or "").split()) for w in items)], decontaminate.BROADCAST_WINDOWS)


@BOUNDS
def test_columns_with_the_names_of_keys(spark, bound):
    names = ["_id", "_hash", "_key", "hash", "text_hash", "row", "kept", "bad", "id"]
    rows = [(i, t, *[f"{n}{k}" for n in names]) for k, (i, t, _) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string")
    clean = decontaminate.without_leaks(docs, items, bound)
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == sorted((r for r in rows if not dict((i, f) for i, _, f in CASES)[r[0]]), key=str)
    alone = jaccard.one_of_each(docs.union(docs))
    assert alone.columns == docs.columns and sorted(r["_key"] for r in alone.where("text <> ''").collect()) == sorted(r[4] for r in rows if r[1])


# ---------------------------------------------------------------- html


def test_html_gradients():
    rng = np.random.default_rng(1)
    pages, gold = htmltext.composed(["some words of text here", "menu"], rng, 3)
    model = htmltext.Labeller()

    def loss():
        p, mask = model.scores(pages)
        y = np.zeros_like(p)
        for k, g in enumerate(gold):
            y[: len(g), k] = g
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    slopes = model.slopes(pages, gold)
    for name in model.NAMES:
        at = np.unravel_index(np.abs(slopes[name]).argmax(), slopes[name].shape)
        was = model.of[name][at]
        model.of[name][at] = was + 1e-5
        high = loss()
        model.of[name][at] = was - 1e-5
        low = loss()
        model.of[name][at] = was
        assert slopes[name][at] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-7)


@pytest.fixture(scope="module")
def labeller(spark):
    return htmltext.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_html_articles(spark, labeller):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner))
        want[r["page_id"]] = "\n".join(x for x in parts if x)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.extract(pages, labeller).collect()}
    assert sum(got[k] == (t, len(t)) for k, t in want.items()) >= 0.99 * len(want)


@pytest.mark.parametrize("container", ["<div>", '<div class="bodycopy rte">', '<div id="c12" class="txt-wrap">', None])
def test_articles_in_unfamiliar_elements(spark, labeller, container):
    import re

    kept = in_all = wrong = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(100).collect():
        blocks = htmltext.blocks_of(r["html"])
        gold = htmltext.marked(blocks) > 0
        if container:
            page = r["html"].replace("<article>", container).replace("</article>", "</div>")
        else:  # no names and no telling elements at all
            page = re.sub(r"<(/?)(article|main|section|nav|aside|header|footer)\b", r"<\1div", re.sub(r"\s(class|id|role)=(\"[^\"]*\"|\S+?(?=[\s>]))", "", r["html"]))
        p = labeller.scores([htmltext.described(htmltext.blocks_of(page, htmltext.path_place))])[0][:, 0] >= 0.5
        assert len(p) == len(gold)
        kept, in_all, wrong = kept + (p & gold).sum(), in_all + gold.sum(), wrong + (p & ~gold).sum()
    assert kept >= 0.9 * in_all and wrong <= 0.1 * in_all


def test_html_references_and_links():
    text = lambda page: [(b[1], b[2]) for b in htmltext.blocks_of(page)]
    assert text("<p>a &am<b>p;</b> &l<i>t; x</i></p>") == [("a &amp; &lt; x", 0)]
    assert text("<p>a &amp; b &lt; c&nbsp;d &#x41;</p>") == [("a & b < c d A", 0)]
    assert text("<p><a href=x><b><i><u><em><strong>deep</strong></em></u></i></b></a> rest</p>") == [("deep rest", 4)]


def test_html_parser_is_linear():
    import time

    deep = "".join(f'<div class="{"".join(chr(97 + k // 26**j % 26) for j in range(3))}">x' for k in range(6000))
    pages = ["<b>x" * 20_000, "<div>x" * 10_000, "<i>" + "<b>" * 10_000 + "</i></b>" * 10_000, deep, "<head>" * 20_000 + "x", "<script/>" * 20_000]
    start = time.process_time()
    assert [len(htmltext.blocks_of(p, htmltext.path_place)) for p in pages] == [1, 10_000, 0, 6000, 1, 0]
    assert time.process_time() - start < 20


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site name</h2><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></nav></header><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<article><h1>Title &amp; more</h1><p>First  paragraph
of the text, long enough to read.</p><p>a &lt; b &eacute;</p><div class="ad">Buy now at once</div><p>Last one of them all, with more words.</p></article>
<aside class="sidebar"><p>Related reading of the week</p></aside><form class="search"><label>Search here</label><input type=text></form>
<div id="comments"><div class="comment"><p>Nice post, thanks a lot for it.</p></div></div><footer><p>&copy; Site</p></footer></body></html>"""


def test_html_parts(spark, labeller):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (None, None, PAGE, "x"), (4, "u", "<p>" * 2000 + "a" + "</p>" * 10, "x"), (5, "u", "<div", "x"), (6, "u", "a < b", "x"), (7, "u", "<script>never closed", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages, labeller).collect()}
    assert got[1] == got[None] == "Title & more\nFirst paragraph of the text, long enough to read.\na < b é\nLast one of them all, with more words."
    assert got[2] == got[3] == got[5] == got[7] == ""
    assert htmltext.extract(pages.limit(0), labeller).count() == 0
    htmltext.fit(pages.limit(0))


def test_html_words_after_the_first():
    opening = " ".join(f"word{k}" for k in range(40))
    blocks = [[(("html", "body", "div"), f"{opening} {end}", 0)] for end in ("prose goes on here", "subscribe now buy here")]
    prose, advert = (htmltext.Labeller().inputs([htmltext.described(b)])[0] for b in blocks)
    assert not np.allclose(prose[..., htmltext.PATH_SIZE : -htmltext.NUMBERS], advert[..., htmltext.PATH_SIZE : -htmltext.NUMBERS])
    words = "two two one " * 60_000
    assert htmltext.word_counts(words.strip()) == {k: 60_000 * n for w, n in (("two", 2), ("one", 1)) for k in htmltext.word_counts(w)}


def test_html_embedded_elements():
    def texts(page):
        return [t for _, t, _ in htmltext.blocks_of(page)]

    assert texts("<article><p>Area <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn><mspace/></mrow></math> holds.</p><p>Next</p></article>") == ["Area x=2 holds.", "Next"]
    assert texts("<p>See <object data=a.pdf>the file</object></p><noscript><p>No script</p></noscript><svg><path d='M0'/><text>Label</text></svg>") == ["See the file", "No script", "Label"]
    for tag in ("math", "svg", "object", "canvas", "iframe", "noscript"):
        assert texts(f"<p>One</p><{tag}><p>Two</p><p>Three</p>") == ["One", "Two", "Three"]
        assert texts(f"<p>One <{tag}/>two</p>") == ["One two"]
    assert texts("<p>One</p><script>a</script><style>b</style><template>c</template><p>Two</p>") == ["One", "Two"]


# ---------------------------------------------------------------- pipeline


def test_stages_on_a_fixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    base = [r["text"] for r in docs.where("lang = 'en' and length(text) between 500 and 1500").limit(6).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(100 + k, t, "en", "s", len(t)) for k, t in enumerate(base)]
    rows += [(200, base[0], "en", "s", 1), (201, base[1] + " end", "en", "s", 1), (202, "123 456", None, "s", 7), (203, None, None, "s", None), (204, base[2][:200] + "\n" + item + "\n" + base[3][:300], "en", "s", 1)]
    rows += [(205, base[4][:400][::-1] + " mail a.b@c.example.com the and of", "en", "s", 1)]
    rng.shuffle(rows)
    own = spark.createDataFrame(rows, docs.schema)
    steps = dict(corpus_pipeline.STAGES)
    out = steps["near_copies"](spark, own, SF)
    dropped = {200, 201}
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows} - dropped
    out = steps["benchmark"](spark, out, SF)
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows} - dropped - {204}
    masked = {r["doc_id"]: r for r in steps["personal_data"](spark, out, SF).collect()}
    assert "[EMAIL]" in masked[205]["text"] and masked[205]["n_chars"] == len(masked[205]["text"]) and masked[100]["text"] == base[0]
    assert out.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, own.limit(0), SF).count() == 0, name


def test_pipeline_equals_its_parts(spark):
    """Each stage's decisions follow from plain versions of the operators on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    kept = {r["doc_id"] for r in langid.identify(docs, model).where("lang_pred <> 'und' and score >= 0.3").collect()}
    first = docs.where(F.col("doc_id").isin(*kept))
    classes = jaccard.jaccard_classes(first).where("doc_id = component_id").select("doc_id")
    bad = decontaminate.find_leaks(first, spark.read.parquet(f"{SF}/benchmark.parquet"), 0).select("doc_id")
    want = {r["doc_id"]: pii.masked(r["text"]) for r in first.join(classes, "doc_id").join(bad, "doc_id", "left_anti").collect()}
    got = {r["doc_id"]: (r["text"], len(r["ids"]), r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == want and all(v[1] == v[2] for v in got.values())


def test_repeated_text_is_judged_in_bounded_memory():
    """What is held follows the item, not the document, and the verdicts are those of the whole document at once."""
    match = lambda place, at: decontaminate.Match(place, at, 8, 30, 30, True, [], [])
    one = decontaminate.Judge(29)
    most = 0
    for place in range(20_000):
        for at in range(place % 2, 30, 2):
            one.add(match(place, at))
        most = max(most, sum(map(len, one.by_offset.values())))
    assert most < 4000 and one.verdict() == (30, False, 30)
