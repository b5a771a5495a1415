"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, scheme
separators and identifier cues.  Around each anchor a local parser expands and validates one kind of span.
A parser reads on from where the last span of its kind ended, so the work is linear in the text.

Base kinds, leftmost and non-overlapping within a kind: ``email``, ``ip``, ``card``, ``phone``.  Added
kinds: ``account`` (IBANs whose check digits hold), ``secret`` (a quoted value of 16 characters or more
assigned to a cue such as ``token``) and ``url`` (a scheme, ``://`` and what follows up to white space
or a quote).

Defined cases: a null or empty text has no spans; repeated rows give repeated rows; a null id is
kept; an empty table gives no rows; offsets are code points, ends exclusive; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("account", "secret", "url")
KINDS = BASE_KINDS + ADDED_KINDS
# Words that announce a secret, and the IBAN length by country.
SECRET_CUES = ["token", "secret", "api_key", "apikey", "password", "passwd"]
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "PL": 28, "PT": 25, "SE": 24}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"[\"']?[ \t]*[:=][ \t]*([\"'])([^\"'\s]{16,})\1")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
URL_REST = re.compile(r"[^\s\"'<>]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")


@functools.cache
def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("secret", len(form)))
    for country in IBAN_LENGTHS:
        for d in "0123456789":
            found.add_word(country + d, ("iban", 3))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(map(int, reversed(digits))):
        total += d if at % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    if len(text) != IBAN_LENGTHS.get(text[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def email_around(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = DOMAIN.match(text, at + 1) if start < at else None
    return (start, end.end()) if end else None


def ips_in(text: str, start: int) -> tuple[int, list[tuple[int, int]]]:
    """The end of the dotted digits from start on, and the valid groups of four among them."""
    chain = DOTTED.match(text, start)
    runs = [m.span() for m in DIGITS.finditer(text, start, chain.end())]
    spans = []
    for k in range(0, len(runs) - 3, 4):
        parts = [text[a:b].lstrip("0") for a, b in runs[k : k + 4]]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            spans.append((runs[k][0], runs[k + 3][1]))
    return chain.end(), spans


def scheme_before(text: str, at: int, floor: int) -> int:
    """Where the scheme that ends at a place begins; the place itself if there is none."""
    start = at
    while start > floor and text[start - 1] in SCHEME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    return start


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """(place of the kind in KINDS, start, end), in that order."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    floor = dict.fromkeys(KINDS, 0)
    for last, (what, length) in anchors().iter(text):
        at = last - length + 1
        if what == "digit":
            if at >= floor["ip"]:
                floor["ip"], spans = ips_in(text, at)
                found += [(1, a, b) for a, b in spans]
            if at >= floor["card"]:
                m = CARD.match(text, at)
                floor["card"] = m.end() if m else at + 1
                if m and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    found.append((2, at, m.end()))
        elif what == "at":
            if span := email_around(text, at, floor["email"]):
                floor["email"] = span[1]
                found.append((0, *span))
        elif what == "plus":
            if m := PHONE.match(text, at):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((3, at, m.end()))
        elif what == "iban":
            m = IBAN.match(text, at) if at >= floor["account"] and not (at and text[at - 1].isalnum()) else None
            if m:
                end = at
                for k, c in enumerate(m[0]):
                    end = at + k + 1
                    if c != " " and iban_holds(m[0][: k + 1].replace(" ", "")):
                        if end >= len(text) or not text[end].isalnum():
                            found.append((4, at, end))
                            floor["account"] = end
                        break
        elif what == "secret":
            m = SECRET.match(text, last + 1) if at >= floor["secret"] else None
            if m:
                found.append((5, *m.span(2)))
                floor["secret"] = m.end()
        elif at >= floor["url"]:
            start, rest = scheme_before(text, at, floor["url"]), URL_REST.match(text, last + 1)
            if start < at and rest:
                found.append((6, start, rest.end()))
                floor["url"] = rest.end()
    found.sort()
    return found


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans_of(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, SPANS)], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end), by kind, then start."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_find, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of each base kind, the checksum of the base spans and all spans as text."""

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *map(number, BASE_KINDS),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def masked(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not text:
        return text
    out, end = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in spans_of(text)):
        if start >= end:
            out += [text[end:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array([masked(t.as_py()) for t in batch.column(at)], pa.string()))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs; text has its personal data replaced by the kind in brackets."""
    return docs.mapInArrow(_mask, docs.schema)
