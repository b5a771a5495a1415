"""Colours, legends and label candidates: pure functions of node and path tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import format_bp, grouped, hsl_to_rgb, hue_of, origin_name, origin_start, pack_abgr
from ..storage import numbered

MAX_PATH_COLORS = 16
SATURATION, LIGHTNESS = 0.7, 0.5
# Colour schemes, the stops of their gradients, flat colours, and the hues of ramps.
SCHEMES = ("auto", "uniform", "random", "rainbow", "depth", "node-length", "stable-rank", "reference-position", "grey")
DEPTH_STOPS = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))
RANK_STOPS = ((237, 137, 44), (158, 42, 122))
LENGTH_STOPS = ((220, 50, 50), (50, 120, 220))
PLAIN, GREY, OFF_RAMP = (52, 152, 219), (160, 160, 160), (60, 65, 72)
RAMP_HUE = 300.0
RAINBOW_SATURATION = 0.75


def color_range(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.coalesce(F.max("sr"), F.lit(0)).alias("max_rank"), F.count(F.lit(1)).alias("nodes"))


def node_colors(nodes: DataFrame, scheme: str, spans: DataFrame | None = None, region: tuple[int, int] | None = None) -> DataFrame:
    """node_id and share: the place of a node on the scheme's ramp from 0 to 1; for ``random`` its hue in degrees.

    A ramp of depth or length without extent puts every node at 0.5.  Ranks run from 1; rank 0 and no rank are not on their ramp.  Nodes off the
    reference, or without a place on it, are not on the ramp of positions, which is the region's, if one is given, else as wide as the midpoints.
    """
    if scheme == "random":
        return nodes.select("node_id", hue_of(F.col("node_id")).cast("double").alias("share"))
    if scheme in ("depth", "node-length"):
        value = {"depth": F.col("depth"), "node-length": F.col("length")}[scheme].cast("double")
        rows = nodes.select("node_id", value.alias("v"))
        ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"))  # one row
        share = F.when(F.col("high") > F.col("low"), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.5))
        return rows.join(F.broadcast(ends)).select("node_id", share.alias("share"))
    if scheme == "stable-rank":
        most = nodes.agg(F.coalesce(F.max("sr"), F.lit(0)).alias("most"))  # one row
        share = F.when(F.col("sr") > 0, F.when(F.col("most") > 1, (F.col("sr") - 1) / (F.col("most") - 1)).otherwise(F.lit(0.0)))
        return nodes.join(F.broadcast(most)).select("node_id", share.alias("share"))
    if scheme == "reference-position" and spans is not None:
        ends = ramp_domain(spans, region)
        at = spans.select("node_id", ((F.col("start") + F.col("end")) / 2).alias("v"))
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))))
        found = nodes.join(at, "node_id", "left").join(F.broadcast(ends))
        return found.select("node_id", F.when(F.coalesce(F.col("sr"), F.lit(0)) == 0, share).alias("share"))
    return nodes.select("node_id", F.lit(0.0).alias("share"))


def ramp_domain(spans: DataFrame, region: tuple[int, int] | None = None) -> DataFrame:
    """low and high of the ramp of positions, also its legend: the region, else the extent of the midpoints, at least 1 wide."""
    if region and region[1] > region[0]:
        return spans.sparkSession.range(1).select(F.lit(float(region[0])).alias("low"), F.lit(float(region[1])).alias("high"))
    mid = (F.col("start") + F.col("end")) / 2
    ends = spans.agg(F.min(mid).alias("low"), F.max(mid).alias("high"))
    return ends.select(F.coalesce("low", F.lit(0.0)).alias("low"), F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.coalesce("low", F.lit(0.0)) + 1).alias("high"))


def packed(rgb: Column | tuple[int, int, int]) -> Column:
    r, g, b = (F.lit(x) for x in rgb) if isinstance(rgb, tuple) else (rgb["r"], rgb["g"], rgb["b"])
    return pack_abgr(r, g, b, F.lit(255))


def gradient(share: Column, stops: tuple[tuple[int, int, int], ...]) -> Column:
    """The packed colour at a share of evenly spaced stops; shares beyond 0 and 1 are clamped."""
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * (len(stops) - 1)
    step = F.least(F.lit(len(stops) - 2), F.floor(at)).cast("int")

    def channel(k: int) -> Column:
        values = F.array(*[F.lit(float(s[k])) for s in stops])
        low, high = F.get(values, step), F.get(values, step + 1)
        return F.floor(low + (high - low) * (at - step) + 0.5).cast("long")

    return pack_abgr(channel(0), channel(1), channel(2), F.lit(255))


def resolved_scheme(scheme: str, anchored: bool) -> str:
    """``auto`` is the ramp of positions on a graph with coordinates, else one colour; unknown names are one colour as well."""
    if scheme == "auto":
        return "reference-position" if anchored else "uniform"
    return scheme if scheme in SCHEMES else "uniform"


def painted(nodes: DataFrame, scheme: str, spans: DataFrame | None = None, region: tuple[int, int] | None = None) -> DataFrame:
    """node_id and color (packed) of every node by a resolved scheme; rainbow goes by record order."""
    if scheme == "rainbow":
        number = numbered(nodes.select("node_id", "rec_no"), "rec_no", name="place")
        count = nodes.agg(F.count(F.lit(1)).alias("n"))
        hue = F.when(F.col("n") > 1, F.col("place") / F.col("n") * 360).otherwise(F.lit(0.0))
        return number.join(F.broadcast(count)).select("node_id", packed(hsl_to_rgb(hue, F.lit(RAINBOW_SATURATION), F.lit(LIGHTNESS))).alias("color"))
    if scheme in ("uniform", "grey") or (scheme == "reference-position" and spans is None):
        return nodes.select("node_id", packed(PLAIN if scheme == "uniform" else GREY).alias("color"))
    share = F.col("share")
    shares = node_colors(nodes, scheme, spans, region).join(nodes.select("node_id", "sr"), "node_id")
    if scheme == "random":
        color = packed(hsl_to_rgb(share, F.lit(SATURATION), F.lit(LIGHTNESS)))
    elif scheme == "stable-rank":
        color = F.when(F.col("sr").isNull(), packed(GREY)).when(F.col("sr") == 0, packed(PLAIN)).otherwise(gradient(share, RANK_STOPS))
    elif scheme == "reference-position":
        placed = spans.select("node_id", F.lit(True).alias("_placed"))
        shares = shares.join(placed, "node_id", "left")
        ramp = packed(hsl_to_rgb(share * RAMP_HUE, F.lit(SATURATION), F.lit(LIGHTNESS)))
        color = F.when(F.col("_placed").isNull(), packed(GREY)).when(F.coalesce(F.col("sr"), F.lit(0)) > 0, packed(OFF_RAMP)).otherwise(ramp)
    else:
        color = gradient(share, DEPTH_STOPS if scheme == "depth" else LENGTH_STOPS)
    return shares.select("node_id", color.alias("color"))


def node_rgb(colors: DataFrame) -> DataFrame:
    return colors.select("node_id", hsl_to_rgb(F.col("share"), F.lit(SATURATION), F.lit(LIGHTNESS)).alias("rgb"))


def path_legend(records: DataFrame) -> DataFrame:
    """phase, rec_no, name, label, hue of every path: hues spread evenly, labels the least that tells all paths apart.

    Tried in turn: sample, sample with offset, sample and haplotype, the same with offset, the whole name, the same with offset.
    """
    parts = F.split(origin_name(F.col("full_name")), "#")
    at = F.concat(F.lit(" @"), grouped(origin_start(F.col("full_name"))))
    tiers = [parts[0], F.array_join(F.slice(parts, 1, 2), "#"), F.array_join(parts, "#")]
    labels = F.array(*[x for t in tiers for x in (t, F.concat(t, at))])
    named = records.select("phase", "rec_no", F.col("full_name").alias("name"), labels.alias("labels"))
    counts = named.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col("labels")[k]).alias(f"d{k}") for k in range(6)])
    chosen = counts.select("n", F.coalesce(*[F.when(F.col(f"d{k}") == F.col("n"), F.lit(k)) for k in range(6)], F.lit(5)).alias("tier"))
    return numbered(named, "phase", "rec_no").join(F.broadcast(chosen)).select("phase", "rec_no", "name", F.get("labels", F.col("tier")).alias("label"), (F.col("number") * 360 / F.col("n")).alias("hue"))  # one row


def legible(records: DataFrame) -> bool:
    return 0 < records.limit(MAX_PATH_COLORS + 1).count() <= MAX_PATH_COLORS


def path_key(records: DataFrame) -> DataFrame:
    """The legend of paths that can be told apart by colour; no rows for more than MAX_PATH_COLORS, whose ribbons and key would say nothing."""
    legend = path_legend(records)
    return legend if legible(records) else legend.where(F.lit(False))


def deletion_labels(deletions: DataFrame) -> DataFrame:
    """Label candidates of deletions, the largest first."""
    return deletions.select("edge_no", format_bp(F.col("bp")).alias("label"), "bp").orderBy(F.desc("bp"), "edge_no")
