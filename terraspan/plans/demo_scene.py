"""A worked scene of every layer, sampled at a time: weather, borders, routes, orbits, labels, models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.numbers import micro, smoothstep
from ..operators import curves, fields, morphs, orbits, scene, tracks

# Fixed values of the scene.
CITIES = [("London", -0.13, 51.51), ("New York", -74.01, 40.71), ("Tokyo", 139.69, 35.69), ("Sydney", 151.21, -33.87), ("Cape Town", 18.42, -33.93), ("Santiago", -70.67, -33.46), ("Nairobi", 36.82, -1.29), ("Singapore", 103.82, 1.35)]
PLACES = {name: (lon, lat) for name, lon, lat in CITIES}
ROUTES = [("London", "New York"), ("Tokyo", "Sydney"), ("Cape Town", "Santiago"), ("London", "Singapore", "Sydney")]
RANGES = (15.0, 30.0, 45.0)
AREA = [(-20.0, 20.0), (40.0, 20.0), (40.0, -10.0), (-20.0, -10.0)]
ORBITS = [(0, 420.0, 51.6, 10.0, 5580.0, None, 40.0), (1, 700.0, 98.2, 120.0, 5900.0, 120.0, 36.0), (2, 20_200.0, 55.0, 250.0, 43_080.0, 200.0, 24.0)]
TIME_SCALE = 400
FORECAST, FRAMES, FRAME_S, RANGE, SIZE = (-22.0, 34.0, 30.0, 64.0), 8, 2.0, (-15.0, 35.0), (256, 128)
TEMPERATURE = [(0.0, 40, 60, 160, 0.9), (0.25, 70, 160, 220, 0.7), (0.45, 120, 210, 190, 0.4), (0.55, 220, 220, 140, 0.4), (0.75, 235, 150, 70, 0.7), (1.0, 200, 50, 45, 0.9)]
# Borders before and after as boxes (west, east, south, north): a polygon's outline, then its holes.
NORTH = ([[(-36, -12, -19, -4), (-30, -19, -15, -8)]], [[(-36, -12, -26, -4)], [(-9, -3, -14, -8)]])
SOUTH = ([[(-36, -12, -31, -19)]], [[(-36, -12, -31, -26)]])
PHASE = [(0.0, 0.0), (6.0, 1.0)]


#: The weather: a mean, a slope from south to north, and travelling waves, each ``(degrees, waves eastward, waves northward, turns a loop, phase)``
#: over the area. Whole turns make the last frame lead back into the first.
MEAN, SLOPE = 14.0, -16.0
WAVES = [(6.0, 0.75, 0.5, 1, 0.0), (3.5, 1.5, -1.0, 1, 0.35), (2.0, 2.25, 1.5, 2, 0.6), (1.25, -3.5, 2.0, 1, 0.15), (0.75, 5.0, 4.5, 3, 0.8)]


def forecast(spark: SparkSession, frame: int) -> DataFrame:
    """``(y, x, v)`` of one of the loop's frames."""
    west, east, south, north = (math.radians(d) for d in FORECAST)

    def degrees(lon, lat):
        u, v = (lon - west) / (east - west), (lat - south) / (north - south)
        return sum((F.sin((u * k + v * m - frame / FRAMES * turns + phase) * (2 * math.pi)) * a for a, k, m, turns, phase in WAVES), MEAN + (v - 0.5) * SLOPE)

    return fields.field(spark, *SIZE, *RANGE, degrees, FORECAST)


def forecast_at(spark: SparkSession, seconds: float) -> DataFrame:
    """``(a, b, mix)``: the frames around a moment."""
    frames = spark.createDataFrame([(0, k * FRAME_S, k) for k in range(FRAMES)], "series_id int, at double, value int")
    ask = spark.createDataFrame([(0, 0, float(seconds))], "series_id int, query_id int, time double")
    return tracks.sample(frames, ask, loop=True, duration=FRAMES * FRAME_S).select("a", "b", "mix")


def boxes(spark: SparkSession, polygons: list) -> DataFrame:
    rows = [(0, p, r, i, float(lon), float(lat)) for p, rings in enumerate(polygons) for r, (w, e, s, n) in enumerate(rings) for i, (lon, lat) in enumerate([(w, n), (e, n), (e, s), (w, s), (w, n)])]
    return spark.createDataFrame(rows, "morph_id int, polygon int, ring int, idx int, lon double, lat double")


def phase_at(seconds: float) -> float:
    """The borders' share of the way, there and back in 12 seconds."""
    t = seconds % 12.0
    u = min(1.0, max(0.0, t / 6 if t < 6 else 1 - (t - 6) / 6))
    return u * u * (3 - 2 * u) if t < 6 else 1 - (1 - u) * (1 - u) * (3 - 2 * (1 - u))


def regions(spark: SparkSession, seconds: float, count: int = 256) -> DataFrame:
    parts = [morphs.at(morphs.morph(boxes(spark, b), boxes(spark, a), count), phase_at(seconds)).withColumn("name", F.lit(n)) for n, (b, a) in (("north", NORTH), ("south", SOUTH))]
    return parts[0].unionByName(parts[1])


def routes(spark: SparkSession) -> DataFrame:
    """``(kind, line_id, leg, i, lon, lat)``: great-circle routes, range rings, and a box of great circles."""
    way = spark.createDataFrame([(k, i, *PLACES[c]) for k, r in enumerate(ROUTES) for i, c in enumerate(r)], "line_id int, idx int, lon double, lat double")
    rings = spark.createDataFrame([(k, *PLACES["Nairobi"], r) for k, r in enumerate(RANGES)], "line_id int, lon double, lat double, radius double")
    area = spark.createDataFrame([(0, i, *p) for i, p in enumerate(AREA)], "line_id int, idx int, lon double, lat double")
    kind = lambda df, n: df.select(F.lit(n).alias("kind"), "line_id", *(("leg",) if "leg" in df.columns else (F.lit(0).cast("long").alias("leg"),)), "i", "lon", "lat")
    return kind(curves.geodesic(way), "route").unionByName(kind(curves.small_circles(rings), "range")).unionByName(kind(curves.geodesic(area, closed=True), "area"))


def orbit_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ORBITS, "orbit_id int, altitude_km double, inclination double, node double, period double, phase double, trail double")


def labels(spark: SparkSession, seconds: float, cam: geo.Camera) -> DataFrame:
    """The labels that are drawn, in order: satellites first, then the relay, then cities. Widths are 6.5 pixels a character."""
    t = F.lit(seconds * TIME_SCALE)
    at = orbits.position(orbits.angle_at(t))
    names = F.element_at(F.array(F.lit("ISS-like"), F.lit("Sun-sync"), F.concat(F.lit("Nav-1  "), text.whole_latitude(F.degrees(F.asin(at[1] / orbits.radius()))))), F.col("orbit_id") + 1)
    moving = orbit_table(spark).select(F.col("orbit_id").alias("priority"), names.alias("text"), *(c.alias(n) for n, c in zip("xyz", at)), F.lit(12.0).alias("size"), F.lit(10.0).alias("gap"))
    rows = [(3, "Polar relay  1500 km", 12.0, 78.0, 1500.0, 10.0)] + [(4 + k, n, lon, lat, 0.0, 7.0) for k, (n, lon, lat) in enumerate(CITIES)]
    fixed = spark.createDataFrame(rows, "priority int, text string, lon double, lat double, km double, gap double")
    v = geo.to_unit(F.col("lon"), F.col("lat"))
    fixed = fixed.select("priority", "text", *((c * (1 + F.col("km") / geo.EARTH_RADIUS_KM)).alias(n) for n, c in zip("xyz", v)), F.lit(12.0).alias("size"), "gap")
    placed = moving.unionByName(fixed).withColumn("s", geo.project(cam, tuple(F.col(c) for c in "xyz")))
    ready = placed.select(
        F.lit("demo").alias("scene"), "priority", "text", F.col("s.visible").alias("visible"), geo.limb_fade(F.col("s.offset"), F.col("s.depth")).alias("alpha"), F.lit(None).cast("boolean").alias("declutter"),
        F.col("s.x").alias("x"), F.col("s.y").alias("y"), (F.length("text") * 6.5).alias("width"), "size", F.lit(None).cast("string").alias("placement"), "gap", F.lit(None).cast("double").alias("dx"), F.lit(None).cast("double").alias("dy"),
    )
    return scene.declutter(scene.label_boxes(ready))


def at(spark: SparkSession, seconds: float, cam: geo.Camera) -> DataFrame:
    """The whole scene as layers ``(layer, name, item, n)``: what there is to draw, and how much of it."""
    frames = forecast_at(spark, seconds)
    near = geo.facing(geo.rotate(cam, tuple(F.col(c) for c in "xyz")))
    path = orbits.ring(orbit_table(spark)).withColumn("seen", ~geo.occluded(geo.rotate(cam, tuple(F.col(c) for c in "xyz"))))
    return scene.layered({
        "overlay": frames.select(F.concat(F.col("a").cast("string"), F.lit(">"), F.col("b").cast("string")).alias("item"), micro(F.col("mix")).alias("n")),
        "regions": regions(spark, seconds, 64).filter(near).groupBy(F.concat("name", F.lit("-"), "pos", F.lit("-"), "ring").alias("item")).agg(F.count(F.lit(1)).alias("n")),
        "graticule": curves.graticule(spark).groupBy(F.col("kind").alias("item")).agg(F.count(F.lit(1)).alias("n")),
        "shapes": routes(spark).groupBy(F.concat("kind", F.lit("-"), "line_id").alias("item")).agg(F.count(F.lit(1)).alias("n")),
        "orbits": path.groupBy(F.col("orbit_id").cast("string").alias("item")).agg(F.count(F.when(F.col("seen"), 1)).alias("n")),
        "labels": labels(spark, seconds, cam).select(F.col("text").alias("item"), F.col("priority").cast("long").alias("n")),
    })


def q_scene(spark, sf_dir):
    return at(spark, 4.5, geo.globe_camera(1400, 900, 1.0, 0.3, 0.35))


def q_forecast(spark, sf_dir):
    """All frames of the loop."""
    out = None
    for k in range(FRAMES):
        one = forecast(spark, k).withColumn("frame", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def q_forecast_ramp(spark, sf_dir):
    stops = [(0, a, float(r), float(g), float(b), alpha) for a, r, g, b, alpha in TEMPERATURE]
    return fields.palette(spark.createDataFrame(stops, "palette_id int, at double, r double, g double, b double, alpha double"))


def q_phase(spark, sf_dir):
    """The borders' track, looped, at quarter seconds of two rounds."""
    frames = spark.createDataFrame([(0, a, v) for a, v in PHASE], "series_id int, at double, value double")
    ask = spark.range(97).select(F.lit(0).alias("series_id"), F.col("id").alias("query_id"), (F.col("id") / 4.0).alias("time"))
    out = tracks.interpolated(tracks.sample(frames, ask, loop=True, duration=12.0, ease=smoothstep))
    return out.select("query_id", micro(F.col("value")).alias("value"))


def playback(spark: SparkSession, spine: DataFrame) -> DataFrame:
    """What every layer that moves shows at the times ``(query_id, time)`` in seconds: ``query_id, a, b, mix, phase, orbit_id, angle``.

    The frames around the time and their mix, the borders' share of the way, and each orbit's angle at the scene's faster time.
    """
    ask = spine.select(F.lit(0).alias("series_id"), "query_id", F.col("time").cast("double").alias("time"))
    frames = spark.createDataFrame([(0, k * FRAME_S, k) for k in range(FRAMES)], "series_id int, at double, value int")
    weather = tracks.sample(frames, ask, loop=True, duration=FRAMES * FRAME_S).select("query_id", "time", "a", "b", "mix")
    steps = spark.createDataFrame([(0, a, v) for a, v in PHASE], "series_id int, at double, value double")
    borders = tracks.interpolated(tracks.sample(steps, ask, loop=True, duration=12.0, ease=smoothstep)).select("query_id", F.col("value").alias("share"))
    each = F.array(*(F.struct(F.lit(o[0]).alias("orbit_id"), F.lit(o[4]).alias("period"), F.lit(o[5]).cast("double").alias("phase")) for o in ORBITS))
    turned = weather.join(borders, "query_id").withColumn("o", F.explode(each)).select("query_id", "time", "a", "b", "mix", "share", "o.*")
    return turned.select("query_id", "a", "b", "mix", F.col("share").alias("phase"), "orbit_id", orbits.angle_at(F.col("time") * TIME_SCALE).alias("angle"))


def q_playback(spark, sf_dir):
    """The scene's minute in quarter seconds."""
    out = playback(spark, spark.range(240).select(F.col("id").alias("query_id"), (F.col("id") / 4.0).alias("time")))
    return out.select("query_id", "a", "b", micro(F.col("mix")).alias("mix"), micro(F.col("phase")).alias("phase"), "orbit_id", micro(F.cos(F.radians("angle"))).alias("c"), micro(F.sin(F.radians("angle"))).alias("s"))


QUERIES = {"demo_playback": q_playback, "demo_scene": q_scene, "demo_forecast": q_forecast, "demo_forecast_ramp": q_forecast_ramp, "demo_phase": q_phase}
STOPS = ", ".join(f"({k}, {a}::DOUBLE, {r}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE, {alpha}::DOUBLE)" for k, (a, r, g, b, alpha) in enumerate(TEMPERATURE))
SQL = {
    "demo_forecast": f"""WITH c AS (SELECT f, y, x, -22.0::DOUBLE * (pi() / 180) + (x + 0.5::DOUBLE) / 256 * (56.0::DOUBLE * (pi() / 180)) AS lo, 64.0::DOUBLE * (pi() / 180) - (y + 0.5::DOUBLE) / 128 * (34.0::DOUBLE * (pi() / 180)) AS la FROM range({FRAMES}) a(f), range(128) b(y), range(256) d(x)),
k AS (SELECT *, (lo - radians(-22.0::DOUBLE)) / (radians(34.0::DOUBLE) - radians(-22.0::DOUBLE)) AS u, (la - radians(30.0::DOUBLE)) / (radians(64.0::DOUBLE) - radians(30.0::DOUBLE)) AS v FROM c),
d AS (SELECT *, {MEAN}::DOUBLE + (v - 0.5::DOUBLE) * {SLOPE}::DOUBLE + {" + ".join(f"sin((u * {k}::DOUBLE + v * {m}::DOUBLE - f / {FRAMES}.0::DOUBLE * {turns} + {phase}::DOUBLE) * (2 * pi())) * {a}::DOUBLE" for a, k, m, turns, phase in WAVES)} AS t FROM k)
SELECT f::INTEGER AS frame, y::INTEGER AS y, x::INTEGER AS x, CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (t - -15.0::DOUBLE) / 50.0::DOUBLE)) * 255 + 0.5) AS INTEGER) AS v FROM d""",
    "demo_forecast_ramp": f"""WITH s AS (SELECT *, lead(a) OVER (ORDER BY k) AS a2, lead(r) OVER (ORDER BY k) AS r2, lead(g) OVER (ORDER BY k) AS g2, lead(b) OVER (ORDER BY k) AS b2, lead(al) OVER (ORDER BY k) AS al2 FROM (VALUES {STOPS}) v(k, a, r, g, b, al)),
p AS (SELECT s.*, n, (n / 255.0::DOUBLE - a) / (a2 - a) AS t FROM s JOIN range(256) q(n) ON a2 IS NOT NULL AND n / 255.0::DOUBLE >= a AND (n / 255.0::DOUBLE < a2 OR k = 4))
SELECT 0 AS palette_id, n::INTEGER AS n, {', '.join(f'CAST(floor({c} + ({c}2 - {c}) * t + 0.5) AS INTEGER) AS {c}' for c in 'rgb')}, CAST(floor((al + (al2 - al) * t) * 255 + 0.5) AS INTEGER) AS a FROM p""",
    "demo_playback": f"""WITH q AS (SELECT n AS query_id, n / 4.0::DOUBLE AS t FROM range(240) r(n)), u AS (SELECT *, fmod(t, {FRAMES * FRAME_S}::DOUBLE) / {FRAME_S}::DOUBLE AS f, fmod(t, 12.0::DOUBLE) AS w FROM q),
e AS (SELECT *, CASE WHEN w < 6 THEN w / 6 ELSE (w - 6) / 6 END AS h FROM u),
o AS (SELECT * FROM (VALUES {", ".join(f"({o[0]}, {o[4]}::DOUBLE, {o[5] or 0.0}::DOUBLE)" for o in ORBITS)}) v(orbit_id, period, phase)),
j AS (SELECT e.*, o.orbit_id, o.phase + 360 * (t * {TIME_SCALE}) / o.period AS angle, CASE WHEN w < 6 THEN h * h * (3 - 2 * h) ELSE 1 - h * h * (3 - 2 * h) END AS share FROM e, o)
SELECT query_id, CAST(floor(f) AS INTEGER) AS a, CAST(floor(f) + 1 AS INTEGER) % {FRAMES} AS b, CAST(floor((f - floor(f)) * 1e6 + 0.5) AS BIGINT) AS mix, CAST(floor(share * 1e6 + 0.5) AS BIGINT) AS phase, orbit_id::INTEGER AS orbit_id,
  CAST(floor(cos(radians(angle)) * 1e6 + 0.5) AS BIGINT) AS c, CAST(floor(sin(radians(angle)) * 1e6 + 0.5) AS BIGINT) AS s FROM j""",
    "demo_phase": """WITH t AS (SELECT n AS query_id, fmod(n / 4.0::DOUBLE, 12.0::DOUBLE) AS t FROM range(97) q(n)), u AS (SELECT *, CASE WHEN t < 6 THEN t / 6 ELSE (t - 6) / 6 END AS u FROM t), e AS (SELECT *, u * u * (3 - 2 * u) AS e FROM u)
SELECT query_id, CAST(floor(CASE WHEN t < 6 THEN e ELSE 1 - e END * 1e6 + 0.5) AS BIGINT) AS value FROM e""",
}
