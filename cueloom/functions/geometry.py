"""Boxes and regions as column expressions; a rect is struct(x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bbox(poly: Column) -> Column:
    """The rect around a polygon of [x, y] points; null if it has none."""
    xs, ys = F.transform(poly, lambda p: F.get(p, 0)), F.transform(poly, lambda p: F.get(p, 1))
    return F.when(F.size(poly) > 0, F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def box_order(poly: Column) -> Column:
    """struct(y, x): the least coordinates, 0 where there is no point."""
    rect = bbox(poly)
    return F.struct(F.coalesce(rect["y1"], F.lit(0.0)).alias("y"), F.coalesce(rect["x1"], F.lit(0.0)).alias("x"))


def area(rect: Column) -> Column:
    wide, high = F.greatest(rect["x2"] - rect["x1"], F.lit(0.0)), F.greatest(rect["y2"] - rect["y1"], F.lit(0.0))
    return F.coalesce(wide * high, F.lit(0.0))


def covered(small: Column, big: Column) -> Column:
    """Share of the small rect that the big one covers; 0 for null or empty ones."""
    wide = F.least(small["x2"], big["x2"]) - F.greatest(small["x1"], big["x1"])
    high = F.least(small["y2"], big["y2"]) - F.greatest(small["y1"], big["y1"])
    share = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0)) / area(small)
    return F.when((area(small) > 0) & big.isNotNull(), share).otherwise(0.0)


def same_line(a: Column, b: Column) -> Column:
    """Vertical overlap of over half of the lower rect."""
    shared = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    lower = F.least(a["y2"] - a["y1"], b["y2"] - b["y1"])
    return F.coalesce((lower > 0) & (shared > 0.5 * lower), F.lit(False))


def overlap_x(a: Column, b: Column) -> Column:
    return F.coalesce(F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0)), F.lit(0.0))


def clamp_region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, least: int = 24) -> Column:
    """struct(x, y, w, h) inside the frame, its sides at least ``least`` where the frame allows it."""
    wide, high = F.greatest(F.lit(least), F.least(w, width)), F.greatest(F.lit(least), F.least(h, height))
    left = F.greatest(F.lit(0), F.least(x, width - wide))
    top = F.greatest(F.lit(0), F.least(y, height - high))
    return F.struct(left.cast("int").alias("x"), top.cast("int").alias("y"), wide.cast("int").alias("w"), high.cast("int").alias("h"))


def default_region(width: Column, height: Column) -> Column:
    """80 % by 20 % of the frame, centred, at 74 % of its height."""
    share = lambda c, s: F.rint(c * s).cast("int")
    return F.struct(share(width, 0.1).alias("x"), share(height, 0.74).alias("y"), share(width, 0.8).alias("w"), share(height, 0.2).alias("h"))


def scale_region(region: Column, from_width: Column, from_height: Column, width: Column, height: Column) -> Column:
    """A region (struct of x, y, w, h) of one frame size in another, clamped; null for a frame without size.

    Without a region or a size to scale from it is 90 % by 28 % of the frame, at 5 % and 70 % (fixed values).
    """
    known = region.isNotNull() & (from_width > 0) & (from_height > 0)
    wide, high = width.cast("double"), height.cast("double")
    part = lambda name, side, old, share: F.when(known, F.rint(region[name] * side / old)).otherwise(F.rint(side * share)).cast("int")
    x, y = part("x", wide, from_width, 0.05), part("y", high, from_height, 0.70)
    w, h = part("w", wide, from_width, 0.90), part("h", high, from_height, 0.28)
    return F.when((width > 0) & (height > 0), clamp_region(x, y, w, h, width, height))


def parse_region(text: Column) -> Column:
    """struct(x, y, w, h) of ``a,b,c,d`` or a JSON list, null unless w and h are over 0."""
    parts = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda p: p.try_cast("double").cast("int"))
    good = (F.size(parts) == 4) & (F.get(parts, 2) > 0) & (F.get(parts, 3) > 0)
    return F.when(good, F.struct(*[F.get(parts, i).alias(n) for i, n in enumerate("xywh")]))
