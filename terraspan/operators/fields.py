"""Quantised scalar fields, colour ramps, and field colours over the globe."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import span_east
from ..functions.numbers import clamp01, round_up


def field(spark: SparkSession, width: int, height: int, low: float, high: float, at: Callable[[Column, Column], Column], bounds: tuple = (-180.0, 180.0, -90.0, 90.0)) -> DataFrame:
    """``(y, x, v)``: ``at(longitude, latitude)`` in radians at cell centres, as 0 to 255 between low and high."""
    west, east, south, north = bounds
    deg = math.pi / 180
    eastward = span_east(F.lit(float(west)), F.lit(float(east))) * deg
    cells = spark.range(width * height).select(F.expr(f"id div {width}").cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    lon = west * deg + (F.col("x") + 0.5) / width * eastward
    lat = north * deg - (F.col("y") + 0.5) / height * ((north - south) * deg)
    t = (at(lon, lat) - low) / ((high - low) or 1)
    return cells.select("y", "x", round_up(clamp01(t) * 255).cast("int").alias("v"))


def palette(stops: DataFrame) -> DataFrame:
    """``(palette_id, n, r, g, b, a)``, 256 entries from stops ``(palette_id, at, r, g, b, alpha)``; before the first and after the last stop that one holds."""
    w = Window.partitionBy("palette_id").orderBy("at", "r", "g", "b")
    cols = ("at", "r", "g", "b", "alpha")
    known = stops.withColumn("alpha", F.coalesce("alpha", F.lit(1.0)))
    pairs = known.select("palette_id", *cols, *(F.coalesce(F.lead(c).over(w), F.col(c)).alias("n_" + c) for c in cols), F.row_number().over(w).alias("_k"), F.count(F.lit(1)).over(Window.partitionBy("palette_id")).alias("_n"))
    pairs = pairs.filter((F.col("_k") < F.col("_n")) | (F.col("_n") == 1))
    # a segment serves the entries from its stop up to the next one; the first also those before, the last those after
    first = F.when(F.col("_k") == 1, 0).otherwise(F.ceil(F.col("at") * 255 - 1e-9))
    last = F.when((F.col("_k") >= F.col("_n") - 1), 255).otherwise(F.ceil(F.col("n_at") * 255 - 1e-9) - 1)
    each = pairs.withColumn("_a", F.greatest(first, F.lit(0)).cast("int")).withColumn("_b", F.least(last, F.lit(255)).cast("int")).filter("_a <= _b")
    each = each.withColumn("n", F.explode(F.sequence("_a", "_b")))
    span = F.col("n_at") - F.col("at")
    t = F.when(span > 0, clamp01((F.col("n") / 255.0 - F.col("at")) / span)).otherwise(0.0)
    mix = lambda c: F.col(c) + (F.col("n_" + c) - F.col(c)) * t
    return each.select("palette_id", "n", *(round_up(mix(c)).cast("int").alias(c) for c in "rgb"), round_up(mix("alpha") * 255).cast("int").alias("a"))


def domain(lon: Column, lat: Column, bounds: tuple) -> tuple[Column, Column, Column]:
    """``(inside, u, v)`` of a position in a field's bounds; u wraps eastwards from the west edge."""
    west, east, south, north = (float(b) for b in bounds)
    u = F.pmod(lon - west, F.lit(360.0)) / span_east(F.lit(west), F.lit(east))
    v = (north - lat) / (north - south)
    return (u <= 1) & (v >= 0) & (v <= 1), u, v


def colours(points: DataFrame, a: DataFrame, b: DataFrame, ramp: DataFrame, size: tuple[int, int], bounds: tuple, mix: float, opacity: float) -> DataFrame:
    """Adds ``value, r, g, b, strength`` to points ``(point_id, lon, lat)``: the cell's mixed value, then its colour.

    Data is mixed before it is coloured; outside the bounds all are null. Fields and the ramp are
    joined on cell and value; the ramp has 256 rows at most and is broadcast.
    """
    width, height = size
    inside, u, v = domain(F.col("lon"), F.col("lat"), bounds)
    x, y = F.least(F.floor(u * width), F.lit(width - 1)).cast("int"), F.least(F.floor(v * height), F.lit(height - 1)).cast("int")
    at = points.withColumn("x", F.when(inside, x)).withColumn("y", F.when(inside, y))
    both = at.join(a.select("y", "x", F.col("v").alias("_a")), ["y", "x"], "left").join(b.select("y", "x", F.col("v").alias("_b")), ["y", "x"], "left")
    both = both.withColumn("value", round_up(F.col("_a") + (F.col("_b") - F.col("_a")) * mix).cast("int"))
    tint = F.broadcast(ramp.select(F.col("n").alias("value"), "r", "g", "b", (F.col("a") / 255.0 * opacity).alias("strength")))
    return both.join(tint, "value", "left").select("point_id", "value", "r", "g", "b", "strength")


def ground(height: Column) -> Column:
    """``struct(kind, t)``: how far along the sea ramp (to 6000 m deep) or land ramp (to 3500 m high)."""
    sea = height < 0
    return F.struct(F.when(sea, "sea").otherwise("land").alias("kind"), clamp01(F.when(sea, -height / 6000.0).otherwise(height / 3500.0)).alias("t"))


# Fixed values of the lit ground: the highlight's place and radius on the disc, the stop between its colours, colours as red, green, blue.
FOCUS, INNER, STOP = (-0.25, 0.35), 0.05, 0.55
SKY, HORIZON, GROUND = (0.431, 0.690, 1.000), (0.118, 0.361, 0.745), (0.020, 0.071, 0.204)
LAND, LAND_HIGH = (0.322, 0.345, 0.365), (0.860, 0.880, 0.900)
SEA_LIGHT, LAND_LIGHT = (1.30, 0.45), (1.30, 0.92, 0.30)


def gradient(x: Column, y: Column) -> Column:
    """How far a place of the unit disc lies from the highlight's edge (0) towards the limb (1), along the ray from the focus."""
    dx, dy = x - FOCUS[0], y - FOCUS[1]
    far = F.sqrt(dx * dx + dy * dy)
    along = F.when(far > 0, (FOCUS[0] * dx + FOCUS[1] * dy) / far).otherwise(FOCUS[0])
    limb = F.sqrt(F.greatest(F.lit(0.0), along * along + (1 - FOCUS[0] ** 2 - FOCUS[1] ** 2))) - along
    return clamp01((far - INNER) / F.greatest(F.lit(1e-4), limb - INNER))


def _ramp(t: Column, stops: tuple) -> Column:
    """Three stops at 0, STOP and 1, linear between."""
    a, b, c = stops
    return F.when(t < STOP, a + (b - a) * (t / STOP)).otherwise(b + (c - b) * ((t - STOP) / (1 - STOP)))


def ground_colour(height: Column, x: Column, y: Column) -> Column:
    """``struct(r, g, b)`` from 0 to 1 and above: the sea takes the gradient's colour, darker with depth; land its brightness only."""
    t, where = gradient(x, y), ground(height)
    dim = SEA_LIGHT[0] + (SEA_LIGHT[1] - SEA_LIGHT[0]) * where["t"]
    sea = [_ramp(t, stops) * dim for stops in zip(SKY, HORIZON, GROUND)]
    land = [(low + (high - low) * where["t"]) * _ramp(t, LAND_LIGHT) for low, high in zip(LAND, LAND_HIGH)]
    return F.struct(*(F.when(where["kind"] == "sea", s).otherwise(v).alias(n) for s, v, n in zip(sea, land, "rgb")))


def tinted(under: Column, tint: Column, strength: Column) -> Column:
    return under + (tint - under) * strength
