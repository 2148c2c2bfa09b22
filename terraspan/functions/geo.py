"""Sphere and screen geometry on columns. x points to 90 E, y to the north pole, z to longitude 0.

A vector is a tuple of three columns; angles are degrees unless a name says otherwise.

Rules that use angle functions take them as ``trig``. PLAIN ones are Spark's: fast, but the last bit of asin, acos and
atan2 is often wrong. NEAR ones (commons-math, a library that Spark brings) are the nearest doubles but for one in
a thousand, as those of the C library and SQL are, at two microseconds a call. ``settled`` takes them only where a sixth
decimal hangs on the last bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import clamp, clamp01

Vec = tuple[Column, Column, Column]
EARTH_RADIUS_KM = 6371
#: Band of depth over which labels fade, least length of a direction.
FADE_BAND, TINY = 0.12, 1e-9
#: A result in degrees is unsure this near to a half of a millionth (in millionths), and beyond this latitude, where small errors of a vector are large ones of its angles.
HALF_BAND, POLE = 1e-4, 89.97
NEAR_CLASS = "org.apache.commons.math3.util.FastMath"


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


class Trig(NamedTuple):
    """Angle functions on columns."""

    sin: Callable[[Column], Column]
    cos: Callable[[Column], Column]
    asin: Callable[[Column], Column]
    acos: Callable[[Column], Column]
    atan2: Callable[[Column, Column], Column]


def _near(name: str) -> Callable[..., Column]:
    def call(*args: Column) -> Column:
        given = F.lit(True)
        for a in args:
            given = given & a.isNotNull()
        return F.when(given, F.java_method(F.lit(NEAR_CLASS), F.lit(name), *args).cast("double"))

    return call


PLAIN = Trig(F.sin, F.cos, F.asin, F.acos, F.atan2)
NEAR = Trig(*(_near(name) for name in Trig._fields))


def settled(points: DataFrame, keep: list[str], rule: Callable[[Trig], tuple[Column, Column, Column]]) -> DataFrame:
    """The columns ``keep`` with ``lon, lat`` of the unit vector that ``rule`` gives: by plain functions, and by near ones where a sixth decimal hangs on the last bits."""
    lon, lat = to_lonlat(*rule(PLAIN))
    plain = points.select("*", lon.alias("_lon"), lat.alias("_lat"))
    half = lambda c: F.abs(F.pmod(F.col(c) * 1e6, F.lit(1.0)) - 0.5) < HALF_BAND
    unsure = (F.abs("_lat") > POLE) | half("_lon") | half("_lat")
    lon, lat = to_lonlat(*rule(NEAR), NEAR)
    return plain.select(*keep, F.when(unsure, lon).otherwise(F.col("_lon")).alias("lon"), F.when(unsure, lat).otherwise(F.col("_lat")).alias("lat"))


def rad(degrees: Column) -> Column:
    return degrees * (math.pi / 180)


def to_unit(lon: Column, lat: Column, trig: Trig = PLAIN) -> Vec:
    a, b = rad(lon), rad(lat)
    return trig.cos(b) * trig.sin(a), trig.sin(b), trig.cos(b) * trig.cos(a)


def to_lonlat(x: Column, y: Column, z: Column, trig: Trig = PLAIN) -> tuple[Column, Column]:
    return trig.atan2(x, z) * 180 / math.pi, trig.asin(clamp(y, -1.0, 1.0)) * 180 / math.pi


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(v: Vec) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Vec) -> Vec:
    n = length(v)
    return v[0] / n, v[1] / n, v[2] / n


def angle(a: Vec, b: Vec, trig: Trig = PLAIN) -> Column:
    """The angle between unit vectors, in radians."""
    return trig.acos(clamp(dot(a, b), -1.0, 1.0))


class Camera(NamedTuple):
    """Screen centre and radius in pixels, and the viewed point's angles in radians."""

    cx: float
    cy: float
    radius: float
    cos_lon: float
    sin_lon: float
    cos_lat: float
    sin_lat: float


def camera(cx: float, cy: float, radius: float, longitude: float, latitude: float) -> Camera:
    return Camera(cx, cy, radius, math.cos(longitude), math.sin(longitude), math.cos(latitude), math.sin(latitude))


def globe_camera(width: float, height: float, zoom: float, longitude: float, latitude: float) -> Camera:
    """The globe in the middle of a viewport, its radius 0.72 of half the shorter side at zoom 1."""
    return camera(width / 2, height / 2, min(width, height) / 2 * 0.72 * zoom, longitude, latitude)


def rotate(cam: Camera, v: Vec) -> Vec:
    """Into the camera's frame: x right, y up, z towards the viewer."""
    x, y, z = v
    turned = x * cam.sin_lon + z * cam.cos_lon
    return x * cam.cos_lon - z * cam.sin_lon, y * cam.cos_lat - turned * cam.sin_lat, y * cam.sin_lat + turned * cam.cos_lat


def occluded(v: Vec) -> Column:
    """Whether a point in the camera's frame is behind the unit globe."""
    return (v[2] < 0) & (v[0] * v[0] + v[1] * v[1] < 1)


def facing(v: Vec) -> Column:
    """Whether a point on the globe is on the near hemisphere."""
    return v[2] > 0


def project(cam: Camera, v: Vec) -> Column:
    """``struct(x, y, visible, depth, offset)`` of a point in space."""
    r = rotate(cam, v)
    return F.struct(
        (cam.cx + r[0] * cam.radius).alias("x"), (cam.cy - r[1] * cam.radius).alias("y"), (~occluded(r)).alias("visible"), r[2].alias("depth"), F.sqrt(r[0] * r[0] + r[1] * r[1]).alias("offset"),
    )


def unproject(cam: Camera, sx: Column, sy: Column) -> Column:
    """``struct(longitude, latitude)`` under a screen point, null beside the globe."""
    nx, ny = (sx - cam.cx) / cam.radius, (cam.cy - sy) / cam.radius
    r2 = nx * nx + ny * ny
    nz = F.sqrt(F.greatest(F.lit(0.0), 1 - r2))
    z1 = nz * cam.cos_lat - ny * cam.sin_lat
    lon, lat = to_lonlat(nx * cam.cos_lon + z1 * cam.sin_lon, ny * cam.cos_lat + nz * cam.sin_lat, z1 * cam.cos_lon - nx * cam.sin_lon)
    return F.when(r2 <= 1, F.struct(lon.alias("longitude"), lat.alias("latitude")))


def limb_crossing(a: Vec, b: Vec) -> tuple[Column, Column]:
    """Where the segment between points of either hemisphere meets the limb, on the unit circle."""
    t = a[2] / (a[2] - b[2])
    x, y = a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t
    n = F.sqrt(x * x + y * y)
    s = F.when(n > TINY, 1 / n).otherwise(0.0)
    return x * s, y * s


def occlusion_crossing(a: Vec, b: Vec, steps: int = 16) -> Column:
    """``struct(x, y, z)``: the last point before visibility changes from a to b, found by halving."""
    at = lambda t: tuple(p + (q - p) * t for p, q in zip(a, b))
    seen = ~occluded(a)

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        same = (~occluded(at(middle))) == seen
        return F.struct(F.when(same, middle).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    lo = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])
    return F.struct(*(c.alias(n) for n, c in zip("xyz", at(lo))))


def slerp(a: Vec, b: Vec, t: Column) -> Vec:
    """Along the great circle, linear between all but equal or opposite points, of unit length."""
    omega = angle(a, b)
    sine = F.sin(omega)
    wa = F.when(sine > TINY, F.sin((1 - t) * omega) / sine).otherwise(1 - t)
    wb = F.when(sine > TINY, F.sin(t * omega) / sine).otherwise(t)
    v = tuple(p * wa + q * wb for p, q in zip(a, b))
    n = length(v)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return v[0] / n, v[1] / n, v[2] / n


def span_east(west: Column, east: Column) -> Column:
    """Degrees from west to east across the antimeridian if need be; equal bounds are the whole globe."""
    span = F.pmod(F.pmod(east - west, F.lit(360.0)) + 360.0, F.lit(360.0))
    return F.when(span == 0, F.lit(360.0)).otherwise(span)


def lonlat_to_uv(lon: Column, lat: Column) -> tuple[Column, Column]:
    return (lon + 180) / 360, (90 - lat) / 180


def unit_to_uv(v: Vec, trig: Trig = PLAIN) -> tuple[Column, Column]:
    return (trig.atan2(v[0], v[2]) + math.pi) / (2 * math.pi), (math.pi / 2 - trig.asin(clamp(v[1], -1.0, 1.0))) / math.pi


def displaced(v: Vec, metres: Column, exaggeration: float) -> Vec:
    s = 1 + metres * exaggeration / (EARTH_RADIUS_KM * 1000)
    return v[0] * s, v[1] * s, v[2] * s


def limb_fade(offset: Column, depth: Column) -> Column:
    return F.when((offset >= 1) | (depth >= FADE_BAND), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), depth / FADE_BAND))


def morphed(a: Vec, b: Vec, t: Column) -> Vec:
    """Between two directions: linear, brought back to the sphere; opposite points hold the start."""
    s = clamp01(t)
    v = tuple(p + (q - p) * s for p, q in zip(a, b))
    n = length(v)
    flat = n < TINY
    return tuple(F.when(flat, p).otherwise(x / n) for p, x in zip(a, v))
