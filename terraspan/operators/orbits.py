"""Circular orbits from elements ``(orbit_id, altitude_km, inclination, node, period, phase)``, angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import clamp, round_up


def radius() -> Column:
    return 1 + F.col("altitude_km") / geo.EARTH_RADIUS_KM


def position(degrees: Column) -> geo.Vec:
    """The point at an angle from the ascending node."""
    node, inc, a, r = geo.rad(F.col("node")), geo.rad(F.col("inclination")), geo.rad(degrees), radius()
    u = (F.sin(node), F.lit(0.0), F.cos(node))
    v = (F.cos(inc) * F.cos(node), F.sin(inc), -F.cos(inc) * F.sin(node))
    return tuple(r * (p * F.cos(a) + q * F.sin(a)) for p, q in zip(u, v))


def angle_at(seconds: Column) -> Column:
    return F.coalesce(F.col("phase"), F.lit(0.0)) + 360 * seconds / F.col("period")


def ring(orbits: DataFrame, segments: int = 240) -> DataFrame:
    """``(orbit_id, i, x, y, z)``: the path, ``segments`` + 1 points."""
    each = orbits.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(segments))))
    return each.select("orbit_id", "i", *(c.alias(n) for n, c in zip("xyz", position(F.col("i") / segments * 360))))


def ground_track(orbits: DataFrame, segments: int = 240) -> DataFrame:
    """``(orbit_id, i, lon, lat)`` below the path."""
    path = ring(orbits, segments)
    v = tuple(F.col(c) for c in "xyz")
    lon, lat = F.atan2(v[0], v[2]), F.asin(clamp(v[1] / geo.length(v), -1.0, 1.0))
    return path.select("orbit_id", "i", F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))


def trail(orbits: DataFrame, seconds: float) -> DataFrame:
    """``(orbit_id, i, from, to, alpha)``: segments behind a satellite that has a ``trail`` in degrees."""
    steps = clamp(round_up(F.col("trail") / 3), F.lit(3), F.lit(16)).cast("int")
    each = orbits.filter("trail > 0").withColumn("_steps", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_steps") - 1)))
    now = angle_at(F.lit(float(seconds)))
    return each.select("orbit_id", "i", (now - F.col("trail") * (F.col("i") + 1) / F.col("_steps")).alias("from"), (now - F.col("trail") * F.col("i") / F.col("_steps")).alias("to"), (1 - F.col("i") / F.col("_steps")).alias("alpha"))
