"""Fill-in-middle transformation by splits at zero-width boundaries.

A unit grammar says what a text may be cut between: alternatives of one character class each, as they stand (`[^A-Za-z]`: one
code point), repeated (`[A-Za-z]+`: a run) or as a run with its end (`[^\\n]*\\n`).  Classes must not overlap and together hold all code points.
`boundary` translates a grammar to a regex of zero width that looks at the two neighbours of a place only: after a
class, unless the class that follows goes on with the same unit.  Spark's `split` with that regex gives the units and loses no
character; the empty text, which split answers with one empty piece, has no units.

Two cuts by hash of the id part the units of a text into prefix, middle and suffix, which are put out as they
are (plain), prefix first (psm) or suffix first (spm), each behind its marker.  Markers start and end with characters that
stand nowhere else in them, and texts that hold one stay plain, so the pieces between the markers of an output are its parts.

All is expressions of one row: no shuffle, no Python, and no group whatever the ids, sources or texts are.

Defined cases: a null text counts as empty; an empty text has no unit and is plain; a null id is drawn as if its
decimal were empty; repeated rows and rows of equal ids are drawn alike, each for itself; very long texts are cut whole; an empty
table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

GRAMMARS = {
    "word": r"[A-Za-z]+|[^A-Za-z]",
    "character": r"[\s\S]",
    "line": r"[^\n]*\n|[^\n]+",
    "space": r"[ \t\n\r\f\x0B]+|[^ \t\n\r\f\x0B]+",
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CLASS = r"\[\^?(?:\\.|[^\]\\])+\]"


@lru_cache
def boundary(grammar: str) -> str:
    """The zero-width regex of the places between two units of a grammar."""
    follows: dict[str, set[str]] = {}  # the classes that go on with the unit of a class
    for part in re.findall(rf"(?:{CLASS}|[^|\[])+", grammar):
        if run := re.fullmatch(rf"({CLASS})(\+?)", part):
            follows.setdefault(run[1], set()).update({run[1]} if run[2] else ())
        elif ended := re.fullmatch(rf"({CLASS})\*({CLASS}|\\.)", part):
            end = ended[2] if ended[2][0] == "[" else f"[{ended[2]}]"
            follows.setdefault(ended[1], set()).update({ended[1], end})
            follows.setdefault(end, set())
        else:
            raise ValueError(f"not a unit of character classes: {part}")
    classes = list(follows)
    for point in range(0x110000):
        if not 0xD800 <= point < 0xE000 and sum(bool(re.match(c, chr(point))) for c in classes) != 1:
            raise ValueError(f"the classes of {grammar} hold U+{point:04X} not once")
    return "|".join(f"(?<={c})" + "".join(f"(?!{n})" for n in sorted(follows[c])) + r"(?=[\s\S])" for c in classes)


def units(text: Column, grammar: str = GRAMMARS["word"]) -> Column:
    """The units of a text that is not null; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers that a seed and an id decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def joined(pieces: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(pieces, start, length), "")


def fill_in_middle(docs: DataFrame, grammar: str = GRAMMARS["word"], seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null if plain) and output of each document.

    Of 100 documents about plain_from are transformed, and spm_below of 100 of these with the suffix first.
    """
    text = text_or_empty()
    drawn = docs.select("doc_id", text.alias("text")).withColumn("pieces", units(F.col("text"), grammar))
    h = draws(F.col("doc_id"), seed)
    held = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(marker))
    n = F.size("pieces").cast("long")
    cuts = [(h[k] % (n + 1)).cast("int") for k in (0, 1)]
    form = F.when((F.col("text") == "") | held | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    placed = drawn.select("doc_id", "text", "pieces", n.alias("n"), form.alias("form"), F.least(*cuts).alias("low"), F.greatest(*cuts).alias("high"))
    moved = F.col("form") != "plain"
    low, high = F.col("low"), F.col("high")
    parted = placed.select(
        "doc_id", "text", "n", "form",
        F.when(moved, joined(F.col("pieces"), F.lit(1), low)).alias("prefix"),
        F.when(moved, joined(F.col("pieces"), low + 1, high - low)).alias("middle"),
        F.when(moved, joined(F.col("pieces"), high + 1, F.col("n").cast("int") - high)).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return parted.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output, from nothing but the output and its form."""
    parts = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    first, second, middle = (F.element_at(parts, k) for k in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digests(docs: DataFrame, grammar: str = GRAMMARS["word"], seed: int = 1) -> DataFrame:
    done = fill_in_middle(docs, grammar, seed)
    return done.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
