"""Names: PanSN, paths, locations, labels.  Column functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = r"^(.*):([0-9]+)-[0-9]+$"


def pansn_sample(name: Column) -> Column:
    """Text before the first ``#``."""
    return F.substring_index(name, "#", 1)


def pansn_contig(name: Column) -> Column:
    """What follows the second ``#``, or the only one; the name itself without any."""
    parts = F.split(name, "#")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 3, F.size(parts)), "#")).when(F.size(parts) == 2, parts[1]).otherwise(name)


def number(text: Column) -> Column:
    """Text as a double: empty counts as 0, 0x with digits as hexadecimal, other text that is no number as null."""
    hexadecimal = F.trim(text).rlike("^0[xX][0-9a-fA-F]{1,15}$")
    return F.when(F.trim(text) == "", F.lit(0.0)).when(hexadecimal, F.conv(F.substring(F.trim(text), 3, 15), 16, 10).cast("double")).otherwise(text.try_cast("double"))


def pansn_haplotype(name: Column) -> Column:
    """The part between the first two ``#`` as a number; null if absent or no number, 0 if empty."""
    parts = F.split(name, "#")
    return F.when(F.size(parts) > 1, number(F.get(parts, F.lit(1)))).cast("long")


def origin_name(name: Column) -> Column:
    """A path name without its ``:start-end``."""
    return F.when(name.rlike(ORIGIN), F.regexp_extract(name, ORIGIN, 1)).otherwise(name)


def origin_start(name: Column) -> Column:
    return F.when(name.rlike(ORIGIN), F.regexp_extract(name, ORIGIN, 2).cast("long")).otherwise(F.lit(0).cast("long"))


def node_id(segment: Column, strand: Column) -> Column:
    return F.concat(segment, strand)


def edge_key(a: Column, b: Column) -> Column:
    """The same for both directions."""
    return F.concat(F.least(a, b), F.lit("--"), F.greatest(a, b))


def grouped(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def region_label(name: Column, start: Column, end: Column) -> Column:
    """As the region states its ends, grouped by thousands."""
    return F.concat(name, F.lit(":"), grouped(start), F.lit("-"), grouped(end))


def locstring(name: Column, start: Column, end: Column) -> Column:
    """1-based, both ends included."""
    return F.concat(name, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"))


def one_decimal(n: Column, unit: int) -> Column:
    """n / unit with one decimal and no trailing zero.

    The binary quotient is rounded; of the exact ties, those at a quarter would go down to even and are put up.
    """
    rounded = F.regexp_replace(F.regexp_replace(F.format_number(n / F.lit(float(unit)), 1), ",", ""), r"\.0$", "")
    return F.when(n % unit == unit // 4, F.concat(F.floor(n / unit).cast("string"), F.lit(".3"))).otherwise(rounded)


def format_bp(bp: Column) -> Column:
    n = bp.cast("long")
    return (
        F.when(n >= 1_000_000, F.concat(one_decimal(n, 1_000_000), F.lit(" Mb")))
        .when(n >= 1000, F.concat(one_decimal(n, 1000), F.lit(" kb")))
        .otherwise(F.concat(n.cast("string"), F.lit(" bp")))
    )


def hue_of(name: Column) -> Column:
    """A hue from 0 to 359 by a rolling hash of which only the shift wraps to 32 bits."""
    points = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def units(c: Column) -> Column:
        """The 16-bit units of a code point."""
        over = c - 0x10000
        return F.when(c < 0x10000, F.array(c)).otherwise(F.array(F.shiftright(over, 10) + 0xD800, over % 1024 + 0xDC00))

    codes = F.flatten(F.transform(points, units))

    def step(h: Column, c: Column) -> Column:
        low = F.pmod(h, F.lit(1 << 32))
        shifted = F.pmod(F.shiftleft(low, 5), F.lit(1 << 32))
        signed = F.when(shifted >= (1 << 31), shifted - (1 << 32)).otherwise(shifted)
        return c + (signed - h)

    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), step) % 360)


def hsl_to_rgb(hue: Column, saturation: Column, lightness: Column) -> Column:
    """Struct of r, g, b from 0 to 255."""
    c = (F.lit(1.0) - F.abs(lightness * 2 - 1)) * saturation

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hue / 30.0, F.lit(12.0))
        a = c / 2
        return F.floor((lightness - a * F.greatest(F.lit(-1.0), F.least(k - 3.0, F.lit(9.0) - k, F.lit(1.0)))) * 255 + 0.5).cast("long")

    return F.struct(channel(0).alias("r"), channel(8).alias("g"), channel(4).alias("b"))


def pack_abgr(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Unsigned 32 bits in a long."""
    parts = [x.cast("long") for x in (r, g, b, a)]
    return parts[0] + parts[1] * (1 << 8) + parts[2] * (1 << 16) + parts[3] * (1 << 24)


def unpack_abgr(packed: Column) -> Column:
    return F.struct(*[F.pmod(F.floor(packed / (1 << (8 * k))), F.lit(256)).cast("long").alias(n) for k, n in enumerate("rgba")])


def brighten(packed: Column, factor: float) -> Column:
    """Colour channels times factor, clamped; alpha kept."""
    c = unpack_abgr(packed)

    def up(x: Column) -> Column:
        return F.least(F.lit(255), F.floor(x * F.lit(factor) + 0.5).cast("long"))

    return pack_abgr(up(c["r"]), up(c["g"]), up(c["b"]), c["a"])


def format_span_bp(bp: Column) -> Column:
    """A limit in the unit that reads: Mb with one decimal from a million on, else whole kb."""
    n = bp.cast("long")
    return F.when(n >= 1_000_000, F.concat(one_decimal(n, 1_000_000), F.lit(" Mb"))).otherwise(F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit(" kb")))


def sm_samples(tag: Column) -> Column:
    """Samples that the text of an SM tag names; null when it names none."""
    names = F.filter(F.transform(F.split(tag, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(names) > 0, names)
