"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target in words: its share of all words by weight, at most `most` times what the source has; what is cut off there is
shared out anew by weight among the sources below their bound, until none is above.  The whole times that a target holds its source are
complete epochs, which take every document as often.  The rest of the target is a fractional epoch, a weighted sample without
replacement: each document draws an exponential key divided by its quality weight (of two documents that of twice the weight comes
first twice as often), documents stand in the order of their keys within the source, and sizes are summed along that order up to the rest,
the budget.  The document in which the budget ends gives its first words only, so a source's words meet its target but for rounding.

Spark sorts by ranges of (source, key), whatever share of the rows one source has.  The sizes of the ranges are summed first: ranges before
the one in which a source's budget ends are taken, ranges after it are not, and only the rows of that one range, one for each source, are
summed row by row.  Sources are a table too: numbered by ranges, and bounded in rounds of one small aggregate each.

Defined cases: a null text has no words and a size of 0, an empty one likewise; nothing is taken of them; a null source is a source of its own,
behind all others; a null id draws by its text; repeated rows draw equal keys and stand side by side, each with its own words; ties go by id,
hash of the text and place of the row; a quality weight that is null counts as 1, one that is not positive and finite puts its document behind all others of its source;
sources without words have target 0; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import numbered
from .common import discard, partitions, text_or_empty, written

WEIGHTS = (1, 2, 3)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Quality weights of documents by label: poor, good.
BY_QUALITY = {0: 0.5, 1: 2.0}


def exponential(doc_id: Column, text_hash: Column, seed: int) -> Column:
    """An exponential draw (of mean 1) by seed, id and, without an id, text: 52 bits of a hash as a number above 0 and at most 1."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text_hash.cast("string"))), 256)
    return -F.log((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / F.lit(float(1 << 52)))


def label_weights(labels: DataFrame) -> DataFrame:
    """labelled (an id) and weight: between those of BY_QUALITY, by the mean of the id's labels."""
    weight = F.lit(BY_QUALITY[0]) + F.avg("quality") * F.lit(BY_QUALITY[1] - BY_QUALITY[0])
    rows = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled"))
    return written(rows.agg(weight.alias("weight")), "weights")


def records(docs: DataFrame, weights: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """doc_id, source, size, text_hash and key of each document.  weights: labelled and weight, a row for each id that has a quality weight."""
    text = text_or_empty()
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), F.xxhash64(text).alias("text_hash"))
    if weights is not None:
        narrow = narrow.join(weights, F.col("doc_id") == F.col("labelled"), "left")
    weight = F.coalesce(F.col("weight"), F.lit(1.0)).cast("double") if weights is not None else F.lit(1.0)
    sound = (weight > 0) & (weight < F.lit(float("inf")))
    key = F.when(sound, exponential(F.col("doc_id"), F.col("text_hash"), seed) / weight).otherwise(F.lit(float("inf")))
    return narrow.select("doc_id", "source", "size", "text_hash", key.alias("key"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target of each source.  rows: source, size."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    placed = numbered(sizes, "unnamed", "source")
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    bounded = placed.select("source", "source_size", turn.alias("weight"), (F.col("source_size") * most).alias("bound"))
    level, full = 0.0, -1
    whole = bounded.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:  # each round puts at least one more source at its bound
        held = F.col("weight") * F.lit(level) > F.col("bound") if full >= 0 else F.lit(False)
        n, taken, open_weight = bounded.agg(F.count(F.when(held, 1)), F.coalesce(F.sum(F.when(held, F.col("bound"))), F.lit(0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0))).first()
        if n == full or not open_weight:
            break
        full, level = n, (whole - taken) / open_weight
    return bounded.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("bound").cast("double")).alias("target"))


def mixed(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), copies (whole ones) and part (first words of one copy more)."""
    rows = written(records(docs, quality, seed).withColumn("row", F.monotonically_increasing_id()), "sizes")
    goal = written(targets(rows, weights, most), "targets")
    order = [F.col("source").isNull(), "source", "key", "doc_id", "text_hash", "row"]
    ranged = written(rows.repartitionByRange(4 * partitions(docs.sparkSession), *order).withColumn("range", F.spark_partition_id()), "by-key")
    discard(rows)

    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    parts = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")  # a row for each range that has the source
    parts = parts.withColumn("before", before).withColumnRenamed("source", "part_source")
    rest = budget - F.col("epochs") * F.col("source_size")
    plan = goal.withColumn("epochs", epochs).withColumn("rest", rest)
    plan = plan.join(parts, same(F.col("source"), F.col("part_source")))
    taken = F.when(F.col("before") + F.col("range_size") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0)  # null: the budget ends in this range
    plan = written(plan.select(F.col("source").alias("plan_source"), F.col("range").alias("plan_range"), "source_size", "target", "epochs", "rest", "before", taken.alias("whole")), "budgets")

    dealt = ranged.join(plan, same(F.col("source"), F.col("plan_source")) & (F.col("range") == F.col("plan_range")))
    size = F.col("size")
    clear = dealt.where(F.col("whole").isNotNull()).withColumn("part", size * F.col("whole"))
    along = Window.partitionBy("source").orderBy("key", "doc_id", "text_hash", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = dealt.where(F.col("whole").isNull())
    reached = F.col("rest") - F.col("before") - (F.sum("size").over(along) - size)  # what is left of the budget at this row
    last = last.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(size, reached)))
    both = clear.unionByName(last)
    full = F.when(F.col("part") == size, F.when(size > 0, 1).otherwise(0)).otherwise(0)
    return both.select(
        "doc_id", "source", "size", "source_size", "target",
        (size * F.col("epochs") + F.col("part")).alias("taken"),
        (F.col("epochs") + full).alias("copies"),
        F.when(full == 1, 0).otherwise(F.col("part")).cast("long").alias("part"),
    )


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its word of that number; nothing for 0."""
    kept = F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), words)
    return F.when(words > 0, F.array_join(kept, "")).otherwise(F.lit(""))


def mixture(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 1) -> DataFrame:
    """doc_id, source and text of the mix itself: a row for each whole copy, and one for the words that are taken besides.

    docs: ids tell its rows apart.
    """
    of = mixed(docs, quality, weights, most, seed).where(F.col("taken") > 0).select(F.col("doc_id").alias("taken_id"), "copies", "part")
    both = docs.select("doc_id", "source", "text").join(of, same(F.col("doc_id"), F.col("taken_id")))
    times = F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    text = F.when(F.col("copy") <= F.col("copies"), F.col("text")).otherwise(first_words(F.col("text"), F.col("part").cast("int")))
    return rows.select("doc_id", "source", text.alias("text"))
