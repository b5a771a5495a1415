"""URL filters by mined association rules.

Fixed (host, path) rules decide first, the longest that fits.  Every other url is judged by rules that
Spark's FP-growth mines from labelled urls: each labelled url is a set of tokens (host suffixes, path
segments, extension, query keys) with its label as one more item; rules ``tokens => label`` above a
support and a confidence are kept, pruned of those that a shorter rule with the same label and no less
confidence covers, and found again by an inverted index from the rarest token of each rule.

FP-growth enumerates subsets, so it gets only tokens that can be in a longer rule: frequent ones (a rule has no more
support than its tokens) that do not decide alone (with a token of confidence 1 every longer rule is pruned).  Tokens of exactly the same
urls go in as one: two of them in one rule add nothing, so such a rule is pruned, and the rules that hold one of them hold for each of them.  So a url of very many
tokens of its own, however often it comes, is one token to FP-growth, and all rules of the whole sets are found.  Rules of one token come from counts of all
tokens of all urls, and the counts of the longer ones are taken again over all labelled urls, so support and confidence are exact for
every rule.  Where a url still has more than WIDE such tokens, whose subsets would be too many, sets are grown level by level instead, without those that are
held by as many urls as a part of them; they give the same rules.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets
the default verdict; an empty table gives no rows; without labelled urls every verdict is the
default; equal urls get equal verdicts; of a host with more than LABELS labels (more than DNS allows) the shortest LABELS suffixes
and the whole are tokens; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

# The rules that decide first, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
MIN_COUNT = 2
LABELS = 127
#: Up to so many tokens of a url FP-growth enumerates their subsets; beyond, sets are grown level by level.
WIDE = 14
BROADCAST_TOKENS = 100_000
CHUNK = 10_000


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows the path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, "^[^?#]*", 0)
    tail = F.substring(after, F.length(path) + 1, F.length(after))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path, tail


def rule_fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = F.coalesce(*[F.when(rule_fits(host, path, r), F.lit(r[1] + r[2])) for r in longest], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(rule_fits(host, path, r), F.lit(r[0])) for r in longest], F.lit(None).cast("string"))
    return name, verdict


def url_tokens(host: Column, path: Column, tail: Column) -> Column:
    """The set of tokens of a url, for mining and matching."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    starts = F.array_distinct(F.concat(F.array(F.lit(1)), F.sequence(F.greatest(F.size(labels) - LABELS + 1, F.lit(1)), F.size(labels))))
    suffixes = F.transform(
        F.when(F.size(labels) > 0, starts).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    words = F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("word:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("path:"), x))
    extension = F.transform(F.regexp_extract_all(path, F.lit(r"\.([A-Za-z]+)$"), 1), lambda x: F.concat(F.lit("ext:"), x))
    keys = F.transform(F.regexp_extract_all(tail, F.lit("[?&]([A-Za-z_]+)="), 1), lambda x: F.concat(F.lit("query:"), x))
    return F.array_distinct(F.concat(suffixes, words, segments, extension, keys))


RULE = "antecedent array<string>, verdict string, confidence double, support double, anchor string"


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, combined: int | None = None) -> DataFrame:
    """antecedent, verdict, confidence, support and anchor (the rarest token) of the rules kept; labelled: tokens, verdict.

    Labelled urls with equal tokens and label are one transaction each.  combined: the most tokens of a url that may combine, if there is to be a bound.
    """
    spark = labelled.sparkSession
    # equal transactions are one row with their number, so that hot urls cost no more than others
    sets = labelled.select(F.array_sort(F.array_distinct("tokens")).alias("tokens"), "verdict").groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("times"))
    rows = written(sets.withColumn("row", F.monotonically_increasing_id()), "url-labels")
    total = rows.agg(F.sum("times")).first()[0]
    if not total:
        return spark.createDataFrame([], RULE)
    least = max(MIN_COUNT, math.ceil(min_support * total - 1e-9))
    each = rows.select("verdict", "times", F.explode("tokens").alias("token")).groupBy("token", "verdict").agg(F.sum("times").alias("n"))
    whole = each.groupBy("token").agg(F.sum("n").alias("of"), F.max("n").alias("most"))
    single = written(each.join(whole, "token").where(F.col("of") >= least), "url-tokens")
    ones = single.where(F.col("n") >= least).select(F.array("token").alias("antecedent"), "verdict", "n", "of")
    mixed = single.where("most < of").select("token", "of", (F.col("most") / F.col("of")).alias("sure")).distinct()
    kept = rows.select("row", "verdict", "times", F.explode("tokens").alias("token")).join(F.broadcast(mixed) if mixed.count() <= BROADCAST_TOKENS else mixed, "token")
    best = F.sort_array(F.collect_list(F.struct("sure", "of", "token")), asc=False)
    kept = written(kept.groupBy("row", "verdict", "times").agg(best.alias("best")).select("verdict", "times", F.col("best.token").alias("tokens")), "url-items")
    label = F.array(F.concat(F.lit("label="), "verdict"))
    alone = written(same_urls(kept), "url-classes")
    some = kept.withColumn("row", F.monotonically_increasing_id())
    some = some.select("row", "verdict", "times", F.explode(F.slice("tokens", 1, combined) if combined else F.col("tokens")).alias("token")).join(alone, "token").groupBy("row", "verdict", "times").agg(F.collect_set("first").alias("tokens"))
    some = written(some, "url-some")
    of, most = some.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max(F.size("tokens")), F.lit(0))).first()
    if not of:
        longer = spark.createDataFrame([], "antecedent array<string>")
    elif most > WIDE:
        longer = level_by_level(some, least)
    else:
        chunks = some.select("times", F.concat("tokens", label).alias("items")).select("times", "items", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / CHUNK))).alias("chunk"))
        alike = F.sequence(F.lit(1), F.least(F.lit(CHUNK).cast("long"), F.col("times") - F.col("chunk") * CHUNK))
        items = chunks.repartition(partitions(spark)).select("items", F.explode(alike)).select("items")
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / of), minConfidence=0.0).fit(items)
        longer = model.freqItemsets.select(F.array_sort(F.filter("items", lambda x: ~F.startswith(x, F.lit("label=")))).alias("antecedent"), F.size("items").alias("n"))
        longer = longer.where((F.size("antecedent") > 1) & (F.size("antecedent") < F.col("n"))).select("antecedent").distinct()
    longer = each_for_each(longer, alone)
    sets = kept.select(F.array_sort("tokens").alias("tokens"), "verdict", "times").groupBy("tokens", "verdict").agg(F.sum("times").alias("times"))
    rules = ones.unionByName(counted(sets, with_anchor(longer, single)))
    rules = rules.where((F.col("n") >= least) & (F.col("n") / F.col("of") >= min_confidence))
    rules = written(rules.select(F.concat_ws("\n", "antecedent").alias("_key"), "antecedent", "verdict", (F.col("n") / F.col("of")).alias("confidence"), (F.col("n") / F.lit(total)).alias("support")), "url-rules")
    # a rule goes if leaving one token out gives a rule with the same verdict and no less confidence
    shorter = rules.select(F.col("_key").alias("_short"), F.col("verdict"), F.col("confidence").alias("_least"))
    parts = rules.select("_key", "verdict", "confidence", F.explode(F.transform("antecedent", lambda x: F.concat_ws("\n", F.array_remove("antecedent", x)))).alias("_short"))
    covered = parts.join(shorter, ["_short", "verdict"]).where("_least >= confidence").select("_key", "verdict").distinct()
    left = rules.join(covered, ["_key", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "support")
    return written(left.join(with_anchor(left.select("antecedent").distinct(), single), "antecedent").select("antecedent", "verdict", "confidence", "support", "anchor"), "url-index")


def same_urls(sets: DataFrame) -> DataFrame:
    """token and first, the least of the tokens that are in exactly the same sets."""
    each = sets.select(F.xxhash64("tokens", "verdict").alias("a"), F.xxhash64("verdict", "tokens", F.lit(1)).alias("b"), F.explode("tokens").alias("token"))
    of = each.groupBy("token").agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).alias("urls"))
    return of.select("token", "urls").join(of.groupBy("urls").agg(F.min("token").alias("first")), "urls").select("token", "first")


def level_by_level(rows: DataFrame, least: int) -> DataFrame:
    """antecedent: the sets of two tokens and more that at least `least` urls hold, and fewer than hold any of their parts (else the set's rules are pruned).

    rows: row, times, tokens.  A set grows by a later token of each url that holds it, and stays if all its parts of the level before are there
    and are held by more urls; so tokens that imply each other, of which very long urls consist, do not multiply.
    """
    each = written(rows.select("row", "times", F.explode("tokens").alias("token")), "url-each")
    held = each.select("row", "times", F.array("token").alias("set"))
    known = written(held.groupBy("set").agg(F.sum("times").alias("n")).where(F.col("n") >= least), "url-sets")
    held, all_sets = held.join(known.select("set"), "set", "left_semi"), []
    while True:
        grown = held.join(each.select("row", "token"), "row").where(F.col("token") > F.element_at("set", -1)).select("row", "times", F.concat("set", F.array("token")).alias("set"))
        counts = grown.groupBy("set").agg(F.sum("times").alias("n")).where(F.col("n") >= least)
        parts = counts.select("set", "n", F.explode(F.transform("set", lambda x: F.array_remove("set", x))).alias("part"))
        before = known.select(F.col("set").alias("part"), F.col("n").alias("of"))
        whole = parts.join(before, "part").groupBy("set").agg(F.min("n").alias("n"), F.min("of").alias("fewest"), F.count(F.lit(1)).alias("parts"))
        known = written(whole.where((F.col("parts") == F.size("set")) & (F.col("n") < F.col("fewest"))).select("set", "n"), "url-sets")
        if known.isEmpty():
            break
        all_sets.append(known.select(F.col("set").alias("antecedent")))
        held = written(grown.join(known.select("set"), "set", "left_semi"), "url-held")
    return functools.reduce(DataFrame.unionByName, all_sets, rows.sparkSession.createDataFrame([], "antecedent array<string>"))


def each_for_each(antecedents: DataFrame, alone: DataFrame) -> DataFrame:
    """The antecedents of first tokens with each token of the same urls in each place."""
    classes = alone.groupBy(F.col("first").alias("_first")).agg(F.collect_set("token").alias("_members"))  # all of one url
    rows = written(antecedents.withColumn("_done", F.array().cast("array<string>")), "url-antecedents")
    for k in range(rows.agg(F.coalesce(F.max(F.size("antecedent")), F.lit(0))).first()[0]):
        here = F.get("antecedent", F.lit(k))
        rows = rows.join(classes, here == F.col("_first"), "left").withColumn("_m", F.explode_outer("_members"))
        rows = rows.select("antecedent", F.when(F.col("_m").isNull(), F.col("_done")).otherwise(F.concat("_done", F.array("_m"))).alias("_done"))
    return rows.select(F.array_sort("_done").alias("antecedent")).distinct()


def with_anchor(antecedents: DataFrame, single: DataFrame) -> DataFrame:
    """antecedent and anchor, its rarest token."""
    counts = single.select("token", "of").distinct()
    each = antecedents.select("antecedent", F.explode("antecedent").alias("token")).join(counts, "token")
    return each.groupBy("antecedent").agg(F.min_by("token", F.struct("of", "token")).alias("anchor"))


def counted(sets: DataFrame, antecedents: DataFrame) -> DataFrame:
    """antecedent, verdict, n (labelled urls that hold it with the verdict) and of (that hold it): exact, over all of them."""
    hits = sets.select("tokens", "verdict", "times", F.explode("tokens").alias("anchor")).join(antecedents, "anchor")
    fits = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("antecedent", "verdict").agg(F.sum("times").alias("n"))
    whole = fits.groupBy("antecedent").agg(F.sum("n").alias("of"))
    return fits.join(whole, "antecedent").select("antecedent", "verdict", "n", "of")


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url and verdict of the best rule that fits; urls: url, tokens (each url once)."""
    index = rules.select(F.col("anchor").alias("_token"), "antecedent", "verdict", "confidence", "support")
    hits = urls.select("url", "tokens", F.explode("tokens").alias("_token")).join(index, "_token")
    fits = hits.where((F.size("antecedent") == 1) | (F.size(F.array_except("antecedent", "tokens")) == 0))
    best = F.struct("confidence", "support", F.negative(F.size("antecedent")).alias("short"), F.concat_ws("\n", "antecedent").alias("name"))
    return fits.groupBy("url").agg(F.max_by("verdict", best).alias("_mined"))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    labelled: url, verdict to mine from; by default the urls that a fixed rule decides.
    """
    host, path, tail = url_parts(F.col("url"))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    base = base.withColumns({"host": host, "path": path, "_tail": tail}).withColumns({"rule": name, "_fixed": verdict})
    tokens = url_tokens(F.col("host"), F.col("path"), F.col("_tail"))
    if labelled is None:
        known = base.where("rule is not null").select(tokens.alias("tokens"), F.col("_fixed").alias("verdict"))
    else:
        parts = labelled.select(*[x.alias(n) for x, n in zip(url_parts(F.col("url")), ("host", "path", "_tail"), strict=True)], "verdict")
        known = parts.select(tokens.alias("tokens"), "verdict").where("verdict is not null")
    mined = mined_rules(known)
    rest = base.where("rule is null and host <> ''").select("url", tokens.alias("tokens")).dropDuplicates(["url"])
    found = written(mined_verdicts(rest, mined), "url-verdicts")
    return base.join(found, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("_fixed", "_mined", F.lit(default)).alias("verdict"))
