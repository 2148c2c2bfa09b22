"""Queries on places (customers on a golden-angle sphere), orbits (suppliers), tracks (events) and fields."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, tables, text
from ..functions.numbers import clamp, micro, smoothstep
from ..operators import curves, fields, orbits, scene, tracks
from .raster_queries import read

CAM = geo.globe_camera(800, 600, 1.25, 0.4, 0.35)
#: The camera in SQL; literals are doubles there.
C = {n: f"{getattr(CAM, n)!r}::DOUBLE" for n in CAM._fields}


def sql_micro(e: str) -> str:
    return f"CAST(floor(({e}) * 1e6 + 0.5) AS BIGINT)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers spread over the sphere: golden-angle longitude, latitude by equal areas."""
    c = read(spark, sf_dir, "customer")
    n = c.agg(F.count(F.lit(1)).alias("_n"))
    k = F.col("c_custkey").cast("double")
    lat = geo.NEAR.asin(2 * (k + 0.5) / F.col("_n") - 1) * 180 / math.pi
    return c.join(F.broadcast(n)).select(F.col("c_custkey").alias("id"), (F.pmod(k * 137.50776405, F.lit(360.0)) - 180).alias("lon"), lat.alias("lat"))


PLACES = """places AS (
  SELECT c_custkey AS id, fmod(c_custkey::DOUBLE * 137.50776405::DOUBLE, 360.0::DOUBLE) - 180 AS lon, asin(2 * (c_custkey::DOUBLE + 0.5::DOUBLE) / (SELECT count(*) FROM customer) - 1) * 180 / pi() AS lat FROM customer
)"""
UNITS = f"""{PLACES}, units AS (
  SELECT *, cos(lat * (pi() / 180)) * sin(lon * (pi() / 180)) AS x, sin(lat * (pi() / 180)) AS y, cos(lat * (pi() / 180)) * cos(lon * (pi() / 180)) AS z FROM places
)"""
TURNED = f"""{UNITS}, turned AS (
  SELECT id, lon, lat, x AS ox, y AS oy, z AS oz, x * {C['cos_lon']} - z * {C['sin_lon']} AS x, y * {C['cos_lat']} - (x * {C['sin_lon']} + z * {C['cos_lon']}) * {C['sin_lat']} AS y,
         y * {C['sin_lat']} + (x * {C['sin_lon']} + z * {C['cos_lon']}) * {C['cos_lat']} AS z FROM units
)"""


def unit(df: DataFrame) -> DataFrame:
    return df.select("*", *(c.alias(n) for n, c in zip("xyz", geo.to_unit(F.col("lon"), F.col("lat")))))


def xyz() -> tuple:
    return F.col("x"), F.col("y"), F.col("z")


def q_places(spark, sf_dir):
    p = places(spark, sf_dir)
    p = p.select("*", *(c.alias(n) for n, c in zip("xyz", geo.to_unit(F.col("lon"), F.col("lat"), geo.NEAR))))
    lon, lat = geo.to_lonlat(*xyz(), geo.NEAR)
    u, v = geo.lonlat_to_uv(F.col("lon"), F.col("lat"))
    u2, v2 = geo.unit_to_uv(xyz(), geo.NEAR)
    return p.select("id", *(micro(F.col(c)).alias(c) for c in "xyz"), micro(lon).alias("lon"), micro(lat).alias("lat"), micro(u).alias("u"), micro(v).alias("v"), micro(u2).alias("u2"), micro(v2).alias("v2"))


def q_project(spark, sf_dir):
    p = unit(places(spark, sf_dir)).withColumn("h", 1 + (F.col("id") % 7) / 10.0)
    p = p.withColumn("s", geo.project(CAM, tuple(F.col(c) * F.col("h") for c in "xyz")))
    fade = geo.limb_fade(F.col("s.offset"), F.col("s.depth"))
    return p.select("id", micro(F.col("s.x")).alias("sx"), micro(F.col("s.y")).alias("sy"), micro(F.col("s.depth")).alias("depth"), F.col("s.visible").alias("visible"), micro(fade).alias("fade"))


def q_hemisphere(spark, sf_dir):
    """Places on the near side, and those that a space point 1.2 radii out at the place would still show."""
    r = geo.rotate(CAM, xyz())
    out = geo.rotate(CAM, tuple(F.col(c) * 1.2 for c in "xyz"))
    p = unit(places(spark, sf_dir)).select(geo.facing(r).alias("near"), (~geo.occluded(out)).alias("seen"))
    return p.groupBy("near", "seen").agg(F.count(F.lit(1)).alias("n"))


def q_unproject(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 53) % 800).cast("double").alias("px"), ((F.col("c_custkey") * 31) % 600).cast("double").alias("py"))
    g = c.withColumn("g", geo.unproject(CAM, F.col("px"), F.col("py")))
    return g.select("id", micro(F.col("g.longitude")).alias("lon"), micro(F.col("g.latitude")).alias("lat"))


def q_displace(spark, sf_dir):
    p = unit(places(spark, sf_dir))
    v = geo.displaced(xyz(), F.col("id") * 3.5 - 1000, 30.0)
    return p.select("id", *(micro(c).alias(n) for n, c in zip("xyz", v)))


def waypoints(spark, sf_dir) -> DataFrame:
    """Routes through the places of 50 neighbouring customers, 4 waypoints each; some stop twice at one place."""
    p = places(spark, sf_dir).withColumn("idx", F.col("id") % 4).withColumn("line_id", F.expr("id div 4"))
    return p.select("line_id", "idx", F.when(F.col("line_id") % 11 == 3, F.col("line_id") % 90).otherwise(F.col("lon")).cast("double").alias("lon"), F.when(F.col("line_id") % 11 == 3, F.lit(12.5)).otherwise(F.col("lat")).alias("lat"))


WAYPOINTS = f"""{PLACES}, way AS (
  SELECT id // 4 AS line_id, id % 4 AS idx, CASE WHEN (id // 4) % 11 = 3 THEN ((id // 4) % 90)::DOUBLE ELSE lon END AS lon, CASE WHEN (id // 4) % 11 = 3 THEN 12.5::DOUBLE ELSE lat END AS lat FROM places
), u AS (SELECT *, cos(lat * (pi() / 180)) * sin(lon * (pi() / 180)) AS x, sin(lat * (pi() / 180)) AS y, cos(lat * (pi() / 180)) * cos(lon * (pi() / 180)) AS z, row_number() OVER (PARTITION BY line_id ORDER BY idx) - 1 AS leg, count(*) OVER (PARTITION BY line_id) AS n FROM way
)"""


def geodesic_sql(closed: bool) -> str:
    nxt = lambda c: f"coalesce(lead({c}) OVER w, first_value({c}) OVER (PARTITION BY line_id ORDER BY idx))" if closed else f"lead({c}) OVER w"
    return f"""WITH {WAYPOINTS}, legs AS (SELECT line_id, leg, n, x, y, z, {nxt('x')} AS x2, {nxt('y')} AS y2, {nxt('z')} AS z2 FROM u WINDOW w AS (PARTITION BY line_id ORDER BY idx)),
o AS (SELECT *, acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, x * x2 + y * y2 + z * z2))) AS om FROM legs WHERE n = 1 OR x2 IS NOT NULL),
s AS (SELECT *, sin(om) AS si, CASE WHEN n = 1 THEN 0 WHEN sin(om) < 1e-9 THEN 1 ELSE greatest(1, ceil(om / (pi() / 180) / 1.0::DOUBLE)) END::BIGINT AS steps FROM o),
p AS (SELECT *, unnest(range(CASE WHEN leg = 0 THEN 0 ELSE 1 END, steps + 1)) AS i FROM s),
w AS (SELECT *, CASE WHEN n = 1 THEN 1 WHEN si < 1e-9 THEN 1 - i ELSE sin((1 - i::DOUBLE / steps) * om) / si END AS wa, CASE WHEN n = 1 THEN 0 WHEN si < 1e-9 THEN i ELSE sin(i::DOUBLE / steps * om) / si END AS wb FROM p)
SELECT line_id, leg, i::INTEGER AS i, {sql_micro("atan2(x * wa + coalesce(x2, 0) * wb, z * wa + coalesce(z2, 0) * wb) * 180 / pi()")} AS lon,
       {sql_micro("asin(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, y * wa + coalesce(y2, 0) * wb))) * 180 / pi()")} AS lat FROM w"""


def quantised(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in columns), *(micro(F.col(c)).alias(c) for c in columns))


def q_geodesic(spark, sf_dir):
    return quantised(curves.geodesic(waypoints(spark, sf_dir)), "lon", "lat").withColumn("leg", F.col("leg").cast("long"))


def q_geodesic_ring(spark, sf_dir):
    return quantised(curves.geodesic(waypoints(spark, sf_dir), closed=True), "lon", "lat").withColumn("leg", F.col("leg").cast("long"))


def q_small_circles(spark, sf_dir):
    p = places(spark, sf_dir).select(F.col("id").alias("line_id"), "lon", "lat", (F.col("id") % 50 + 1).cast("double").alias("radius"))
    return quantised(curves.small_circles(p, 36), "lon", "lat")


def q_sql_small_circles(spark, sf_dir):
    """The rings of ``geo_small_circles`` by SQL alone."""
    tables.register(spark)
    p = places(spark, sf_dir)
    text = """SELECT line_id, i, CAST(floor(lon * 1e6D + 0.5D) AS BIGINT) AS lon, CAST(floor(lat * 1e6D + 0.5D) AS BIGINT) AS lat
FROM (SELECT line_id, inline(points) FROM (SELECT id AS line_id, small_circle(lon, lat, CAST(id % 50 + 1 AS DOUBLE), 36) AS points FROM {p}))"""
    return spark.sql(text, p=p)


def q_sql_geodesic(spark, sf_dir):
    """The lines of ``geo_geodesic`` by SQL alone: legs by ``lead``, a lone waypoint as it is."""
    tables.register(spark)
    text = """WITH legs AS (SELECT line_id, row_number() OVER w - 1 AS leg, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, count(*) OVER (PARTITION BY line_id) AS n FROM {p} WINDOW w AS (PARTITION BY line_id ORDER BY idx))
SELECT line_id, CAST(leg AS BIGINT) AS leg, i, CAST(floor(lon * 1e6D + 0.5D) AS BIGINT) AS lon, CAST(floor(lat * 1e6D + 0.5D) AS BIGINT) AS lat
FROM (SELECT line_id, leg, lone, inline(points) FROM (SELECT line_id, leg, n = 1 AS lone, great_circle(lon, lat, coalesce(lon2, lon), coalesce(lat2, lat), 1.0D) AS points FROM legs WHERE lon2 IS NOT NULL OR n = 1))
WHERE CASE WHEN lone THEN i = 0 ELSE i > 0 OR leg = 0 END"""
    return spark.sql(text, p=waypoints(spark, sf_dir))


def q_graticule(spark, sf_dir):
    return curves.graticule(spark, 30)


def orbit_table(spark, sf_dir) -> DataFrame:
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(
        k.alias("orbit_id"), (400 + k * 37).cast("double").alias("altitude_km"), ((k * 13) % 100).cast("double").alias("inclination"), ((k * 29) % 360).cast("double").alias("node"),
        (5400 + k * 11).cast("double").alias("period"), F.when(k % 5 > 0, (F.col("s_nationkey") * 7).cast("double")).alias("phase"), ((k * 3) % 61).cast("double").alias("trail"),
    )


ORBITS = """orb AS (SELECT s_suppkey AS orbit_id, 1 + (400 + s_suppkey * 37)::DOUBLE / 6371 AS r, ((s_suppkey * 13) % 100)::DOUBLE * (pi() / 180) AS inc, ((s_suppkey * 29) % 360)::DOUBLE * (pi() / 180) AS node,
  (5400 + s_suppkey * 11)::DOUBLE AS period, CASE WHEN s_suppkey % 5 > 0 THEN (s_nationkey * 7)::DOUBLE ELSE 0 END AS phase, ((s_suppkey * 3) % 61)::DOUBLE AS trail FROM supplier)"""
ORBIT_XYZ = "r * (sin(node) * cos(a) + cos(inc) * cos(node) * sin(a)) AS x, r * (0 * cos(a) + sin(inc) * sin(a)) AS y, r * (cos(node) * cos(a) + -cos(inc) * sin(node) * sin(a)) AS z"


def q_orbit_positions(spark, sf_dir):
    times = orbit_table(spark, sf_dir).withColumn("t", F.explode(F.array(*(F.lit(float(t)) for t in (0, 400, 9000)))))
    return times.select("orbit_id", F.col("t").cast("long").alias("t"), *(micro(c).alias(n) for n, c in zip("xyz", orbits.position(orbits.angle_at(F.col("t"))))))


def q_orbit_rings(spark, sf_dir):
    return quantised(orbits.ring(orbit_table(spark, sf_dir), 24), "x", "y", "z")


def q_ground_tracks(spark, sf_dir):
    return quantised(orbits.ground_track(orbit_table(spark, sf_dir), 23), "lon", "lat")


def q_trails(spark, sf_dir):
    return quantised(orbits.trail(orbit_table(spark, sf_dir), 1234.0), "from", "to", "alpha")


def frames(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1_704_067_200
    return e.select("event_id", "event_type", F.col("user_id").alias("series_id"), at.alias("at"), "value")


def track(spark, sf_dir, **options) -> DataFrame:
    e = frames(spark, sf_dir)
    asked = e.filter("event_type = 'view'").select("series_id", F.col("event_id").alias("query_id"), F.col("at").alias("time"))
    out = tracks.interpolated(tracks.sample(e.filter("event_type = 'purchase'").select("series_id", "at", "value"), asked, **options))
    return out.select("series_id", "query_id", micro(F.col("a")).alias("a"), micro(F.col("b")).alias("b"), micro(F.col("mix")).alias("mix"), micro(F.col("value")).alias("value"))


def q_track_hold(spark, sf_dir):
    return track(spark, sf_dir, ease=smoothstep)


def q_track_loop(spark, sf_dir):
    return track(spark, sf_dir, loop=True, duration=1_500_000.0)


EVENTS = """e AS (SELECT event_id, event_type, user_id AS series_id, epoch_us(ts) / 1e6::DOUBLE - 1704067200 AS at_, value FROM events),
f AS (SELECT * FROM e WHERE event_type = 'purchase'), q AS (SELECT series_id, event_id AS query_id, at_ AS t0 FROM e WHERE event_type = 'view'),
s AS (SELECT series_id, min(at_) AS st, max(at_) AS en, count(*) AS n, min_by(value, at_) AS fv, max_by(value, at_) AS lv FROM f GROUP BY 1)"""


def track_sql(loop: bool) -> str:
    length = "greatest(en - st, 1500000.0::DOUBLE)"
    t = f"CASE WHEN n > 1 THEN st + fmod(fmod(t0 - st, {length}) + {length}, {length}) ELSE t0 END" if loop else "t0"
    return f"""WITH {EVENTS}, j AS (SELECT q.*, st, en, n, fv, lv, {t} AS t, {length} AS len FROM q LEFT JOIN s USING (series_id)),
b AS (SELECT j.*, p.at_ AS pa, p.value AS pv FROM j ASOF LEFT JOIN f p ON p.series_id = j.series_id AND j.t >= p.at_),
c AS (SELECT b.*, x.at_ AS qa, x.value AS qv FROM b ASOF LEFT JOIN f x ON x.series_id = b.series_id AND b.t < x.at_),
d AS (SELECT *, {'n > 1 AND t >= en' if loop else 'false'} AS closing FROM c),
r AS (SELECT series_id, query_id, CASE WHEN n = 1 {'' if loop else 'OR t <= st'} THEN fv WHEN closing OR t >= en THEN lv ELSE pv END AS a,
  CASE WHEN n = 1 {'' if loop else 'OR t <= st'} OR closing THEN fv WHEN t >= en THEN lv ELSE qv END AS b,
  CASE WHEN n IS NULL THEN NULL WHEN n = 1 {'' if loop else 'OR t <= st'} THEN 0 WHEN closing THEN CASE WHEN st + len - en > 0 THEN (t - en) / (st + len - en) ELSE 0 END WHEN t >= en THEN 0 ELSE (t - pa) / (qa - pa) END AS u FROM d),
m AS (SELECT *, {'u' if loop else 'u * u * (3 - 2 * u)'} AS mix FROM r)
SELECT series_id, query_id, {sql_micro('a')} AS a, {sql_micro('b')} AS b, {sql_micro('mix')} AS mix, {sql_micro('a + (b - a) * mix')} AS value FROM m"""


BOUNDS = (160.0, -150.0, -40.0, 35.0)


def demo_field(spark, shift: float, bounds=BOUNDS) -> DataFrame:
    return fields.field(spark, 40, 20, -1.0, 1.2, lambda lon, lat: F.sin(lon * 3 + shift) * F.cos(lat * 2), bounds)


def field_sql(shift: float, name: str) -> str:
    return f"""{name} AS (SELECT y::INTEGER AS y, x::INTEGER AS x, CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (sin((160.0::DOUBLE * (pi() / 180) + (x + 0.5::DOUBLE) / 40 * (50.0::DOUBLE * (pi() / 180))) * 3 + {shift}::DOUBLE)
  * cos((35.0::DOUBLE * (pi() / 180) - (y + 0.5::DOUBLE) / 20 * (75.0::DOUBLE * (pi() / 180))) * 2) - -1.0::DOUBLE) / 2.2::DOUBLE)) * 255 + 0.5) AS INTEGER) AS v FROM range(20) a(y), range(40) b(x))"""


def q_field(spark, sf_dir):
    return demo_field(spark, 0.25)


def stops(spark, sf_dir) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        (k % 12 + F.floor(k / 60) * 12).alias("palette_id"), (((k * 37) % 101) / 100.0).alias("at"), (k * 91 % 256).cast("double").alias("r"), (k * 57 % 256).cast("double").alias("g"), (k * 23 % 256).cast("double").alias("b"),
        F.when(k % 4 > 0, (k % 10) / 10.0).alias("alpha"),
    )


def q_palette(spark, sf_dir):
    return fields.palette(stops(spark, sf_dir))


PALETTE = """stops AS (SELECT p_partkey % 12 + (p_partkey // 60) * 12 AS palette_id, ((p_partkey * 37) % 101) / 100.0::DOUBLE AS at_, (p_partkey * 91 % 256)::DOUBLE AS r, (p_partkey * 57 % 256)::DOUBLE AS g, (p_partkey * 23 % 256)::DOUBLE AS b,
  CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 10) / 10.0::DOUBLE ELSE 1 END AS al FROM part),
k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY palette_id) AS c, lead(at_) OVER w AS at2, lead(r) OVER w AS r2, lead(g) OVER w AS g2, lead(b) OVER w AS b2, lead(al) OVER w AS al2 FROM stops WINDOW w AS (PARTITION BY palette_id ORDER BY at_, r, g, b)),
n AS (SELECT i, i / 255.0::DOUBLE AS at_ FROM range(256) t(i)),
pick AS (SELECT k.*, n.i, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (n.at_ - k.at_) / (at2 - k.at_))) AS t FROM k JOIN n ON (k < c OR c = 1) AND (k = 1 OR k.at_ <= n.at_) QUALIFY row_number() OVER (PARTITION BY palette_id, i ORDER BY k DESC) = 1),
ramp AS (SELECT palette_id, i::INTEGER AS n, CAST(floor(r + (coalesce(r2, r) - r) * t + 0.5) AS INTEGER) AS r, CAST(floor(g + (coalesce(g2, g) - g) * t + 0.5) AS INTEGER) AS g, CAST(floor(b + (coalesce(b2, b) - b) * t + 0.5) AS INTEGER) AS b, CAST(floor((al + (coalesce(al2, al) - al) * t) * 255 + 0.5) AS INTEGER) AS a FROM pick)"""


def q_overlay(spark, sf_dir):
    ramp = fields.palette(stops(spark, sf_dir)).filter("palette_id = 5")
    out = fields.colours(places(spark, sf_dir).withColumnRenamed("id", "point_id"), demo_field(spark, 0.0), demo_field(spark, 1.0), ramp, (40, 20), BOUNDS, 0.25, 0.8)
    out = out.withColumn("tinted", micro(fields.tinted(F.lit(40.0), F.col("r"), F.col("strength"))))
    return out.withColumn("strength", micro(F.col("strength")))


OVERLAY = f"""WITH {PLACES}, {field_sql(0.0, 'fa')}, {field_sql(1.0, 'fb')}, {PALETTE}, d AS (
  SELECT id AS point_id, fmod(fmod(lon - 160.0::DOUBLE, 360.0::DOUBLE) + 360.0::DOUBLE, 360.0::DOUBLE) / 50.0::DOUBLE AS u, (35.0::DOUBLE - lat) / 75.0::DOUBLE AS v FROM places),
c AS (SELECT point_id, CASE WHEN u <= 1 AND v BETWEEN 0 AND 1 THEN least(39, floor(u * 40))::INTEGER END AS x, CASE WHEN u <= 1 AND v BETWEEN 0 AND 1 THEN least(19, floor(v * 20))::INTEGER END AS y FROM d),
m AS (SELECT point_id, CAST(floor(fa.v + (fb.v - fa.v) * 0.25::DOUBLE + 0.5) AS INTEGER) AS value FROM c LEFT JOIN fa USING (y, x) LEFT JOIN fb USING (y, x))
SELECT point_id, value, r, g, b, {sql_micro('a / 255.0::DOUBLE * 0.8::DOUBLE')} AS strength, {sql_micro('40.0::DOUBLE + (r - 40.0::DOUBLE) * (a / 255.0::DOUBLE * 0.8::DOUBLE)')} AS tinted
FROM m LEFT JOIN (SELECT * FROM ramp WHERE palette_id = 5) p ON p.n = m.value"""


def q_ground(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("g", fields.ground(F.col("id") * 11.0 - 8000))
    return p.select("id", F.col("g.kind").alias("kind"), micro(F.col("g.t")).alias("t"))


def q_ground_colour(spark, sf_dir):
    k = F.col("id")
    p = places(spark, sf_dir).withColumn("g", fields.ground_colour(k * 11.0 - 8000, ((k * 37) % 200 - 100) / 142.0, ((k * 53) % 200 - 100) / 142.0))
    return p.select("id", *(micro(F.col(f"g.{c}")).alias(c) for c in "rgb"))


def ground_colour_sql() -> str:
    """The lit ground of places on the disc."""
    fx, fy = fields.FOCUS
    ramp = lambda a, b, c: f"CASE WHEN t < {fields.STOP}::DOUBLE THEN {a}::DOUBLE + ({b}::DOUBLE - {a}::DOUBLE) * (t / {fields.STOP}::DOUBLE) ELSE {b}::DOUBLE + ({c}::DOUBLE - {b}::DOUBLE) * ((t - {fields.STOP}::DOUBLE) / (1 - {fields.STOP}::DOUBLE)) END"
    sea = [f"({ramp(*stops)}) * ({fields.SEA_LIGHT[0]}::DOUBLE + {fields.SEA_LIGHT[1] - fields.SEA_LIGHT[0]}::DOUBLE * w)" for stops in zip(fields.SKY, fields.HORIZON, fields.GROUND)]
    land = [f"({low}::DOUBLE + {high - low}::DOUBLE * w) * ({ramp(*fields.LAND_LIGHT)})" for low, high in zip(fields.LAND, fields.LAND_HIGH)]
    return f"""WITH p AS (SELECT c_custkey AS id, c_custkey * 11.0::DOUBLE - 8000 AS h, ((c_custkey * 37) % 200 - 100) / 142.0::DOUBLE - {fx}::DOUBLE AS dx, ((c_custkey * 53) % 200 - 100) / 142.0::DOUBLE - {fy}::DOUBLE AS dy FROM customer),
f AS (SELECT *, sqrt(dx * dx + dy * dy) AS far FROM p), a AS (SELECT *, CASE WHEN far > 0 THEN ({fx}::DOUBLE * dx + {fy}::DOUBLE * dy) / far ELSE {fx}::DOUBLE END AS along FROM f),
l AS (SELECT *, sqrt(greatest(0.0::DOUBLE, along * along + {1 - fx**2 - fy**2}::DOUBLE)) - along AS limb FROM a),
g AS (SELECT id, h, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (far - {fields.INNER}::DOUBLE) / greatest(1e-4::DOUBLE, limb - {fields.INNER}::DOUBLE))) AS t,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN h < 0 THEN -h / 6000.0::DOUBLE ELSE h / 3500.0::DOUBLE END)) AS w FROM l)
SELECT id, {", ".join(M(f"CASE WHEN h < 0 THEN {s} ELSE {v} END") + f" AS {n}" for s, v, n in zip(sea, land, "rgb"))} FROM g"""


def q_tracking(spark, sf_dir):
    """Anchors that follow a user's purchases, asked at the user's views."""
    e, v = frames(spark, sf_dir), F.col("value")
    feed = e.filter("event_type = 'purchase'").select(F.col("series_id").alias("anchor_id"), "at", ((v * 3) % 360.0 - 180).alias("lon"), (v % 160.0 - 80).alias("lat"), v.alias("altitude_km"))
    asked = e.filter("event_type = 'view'").select(F.col("series_id").alias("anchor_id"), F.col("event_id").alias("query_id"), F.col("at").alias("time"))
    return quantised(scene.tracking(feed, asked), "x", "y", "z").drop("time")


TRACKING = """WITH e AS (SELECT event_id, event_type, user_id AS s, epoch_us(ts) / 1e6::DOUBLE - 1704067200 AS t, value FROM events),
j AS (SELECT q.s AS anchor_id, q.event_id AS query_id, coalesce(arg_max(f.value, f.t) FILTER (f.t <= q.t), arg_min(f.value, f.t)) AS value
  FROM e q LEFT JOIN e f ON f.s = q.s AND f.event_type = 'purchase' WHERE q.event_type = 'view' GROUP BY ALL),
p AS (SELECT anchor_id, query_id, (fmod(value * 3, 360.0::DOUBLE) - 180) * (pi() / 180) AS lon, (fmod(value, 160.0::DOUBLE) - 80) * (pi() / 180) AS lat, 1 + value / 6371.0::DOUBLE AS r FROM j)"""


def ring_points(spark, sf_dir) -> DataFrame:
    """A ring per nation: its customers in turn around a centre, at uneven distances; odd nations run backwards; some points repeat."""
    c = read(spark, sf_dir, "customer")
    w, whole = Window.partitionBy("c_nationkey").orderBy("c_custkey"), Window.partitionBy("c_nationkey")
    k = c.select("c_nationkey", F.col("c_custkey").alias("id"), (F.row_number().over(w) - 1).alias("idx"), F.count(F.lit(1)).over(whole).alias("n"))
    turn = F.when(F.col("c_nationkey") % 2 == 0, 1.0).otherwise(-1.0) * (F.expr("idx div 2") * 2.0) / F.col("n") * (2 * math.pi)
    r = 4 + (F.expr("idx div 2") * 7 % 5)
    return k.select(F.col("c_nationkey").alias("ring_id"), "idx", (F.col("c_nationkey") * 12 - 150 + r * F.sin(turn)).alias("lon"), (F.col("c_nationkey") * 2 - 25 + r * F.cos(turn)).alias("lat"))


RINGS = """k AS (SELECT c_nationkey AS nk, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
t AS (SELECT *, CASE WHEN nk % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * ((idx // 2) * 2.0::DOUBLE) / n * (2 * pi()) AS turn, 4 + ((idx // 2) * 7 % 5) AS r FROM k),
rp AS (SELECT nk AS ring_id, idx, nk * 12 - 150 + r * sin(turn) AS lon, nk * 2 - 25 + r * cos(turn) AS lat FROM t)"""
CLEAN = f"""{RINGS}, rr AS (SELECT ring_id, idx, round(lon, 2) AS lon, round(lat, 2) AS lat FROM rp),
dd AS (SELECT *, coalesce(lag(lon) OVER w = lon AND lag(lat) OVER w = lat, false) AS same FROM rr WINDOW w AS (PARTITION BY ring_id ORDER BY idx)),
kept AS (SELECT ring_id, lon, lat, row_number() OVER (PARTITION BY ring_id ORDER BY idx) - 1 AS idx FROM dd WHERE NOT same QUALIFY count(*) OVER (PARTITION BY ring_id) >= 3)"""


def clean(spark, sf_dir) -> DataFrame:
    return curves.clean_rings(ring_points(spark, sf_dir).withColumn("polygon_id", F.expr("ring_id div 2")))


def q_clean_rings(spark, sf_dir):
    return quantised(clean(spark, sf_dir), "lon", "lat").withColumn("idx", F.col("idx").cast("long"))


def q_ring_counts(spark, sf_dir):
    return curves.ring_counts(clean(spark, sf_dir))


def q_ring_measures(spark, sf_dir):
    rings = unit(clean(spark, sf_dir)).select("ring_id", "idx", *"xyz")
    m = curves.ring_measures(rings)
    return m.select("ring_id", "n", *(micro(F.col(c)).alias(c) for c in ("cx", "cy", "cz", "perimeter")), (F.col("turn") < 0).alias("backwards"))


def q_orient_rings(spark, sf_dir):
    rings = unit(clean(spark, sf_dir)).select("ring_id", "idx", *"xyz")
    return quantised(curves.orient_rings(rings), "x", "y", "z").withColumn("idx", F.col("idx").cast("long"))


MEASURES = f"""{CLEAN}, uu AS (SELECT ring_id, idx, cos(lat * (pi() / 180)) * sin(lon * (pi() / 180)) AS x, sin(lat * (pi() / 180)) AS y, cos(lat * (pi() / 180)) * cos(lon * (pi() / 180)) AS z FROM kept),
pp AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, coalesce(lead(z) OVER w, first_value(z) OVER w) AS nz FROM uu WINDOW w AS (PARTITION BY ring_id ORDER BY idx)),
mm AS (SELECT ring_id, count(*) AS n, sum(x) AS mx, sum(y) AS my, sum(z) AS mz, sum(y * nz - z * ny) AS ax, sum(z * nx - x * nz) AS ay, sum(x * ny - y * nx) AS az, sum(acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, x * nx + y * ny + z * nz)))) AS perimeter FROM pp GROUP BY 1)"""


def q_clip_rings(spark, sf_dir):
    """Nations' rings, filled: how many loops and points each leaves, and its area on the screen."""
    rings = unit(clean(spark, sf_dir)).select("ring_id", "idx", *"xyz")
    loops = curves.clip_rings(rings, CAM)
    w = Window.partitionBy("ring_id", "loop").orderBy("seq")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in ("sx", "sy"))
    edges = loops.withColumn("_a", (F.col("sx") * ny - nx * F.col("sy")) / 2)
    return edges.groupBy("ring_id").agg(F.countDistinct("loop").alias("loops"), F.count(F.lit(1)).alias("points"), F.round(F.abs(F.sum("_a")), 3).alias("area"))


def q_clip(spark, sf_dir, space=False):
    """Each nation's customers joined up in turn, clipped by the view."""
    p = unit(places(spark, sf_dir)).select(F.expr("id div 30").alias("line_id"), (F.col("id") % 30).alias("idx"), *((F.col(c) * (1.15 if space else 1.0)).alias(c) for c in "xyz"))
    return quantised(curves.clip_lines(p, CAM, space), "sx", "sy")


def q_clip_space(spark, sf_dir):
    return q_clip(spark, sf_dir, True)


def clip_sql(space: bool) -> str:
    h = "1.15::DOUBLE" if space else "1"
    seen = "NOT (z < 0 AND x * x + y * y < 1)" if space else "z > 0"
    own = f"SELECT line_id, piece, idx * 2 AS seq, {sql_micro(f'{C["cx"]} + x * {C["radius"]}')} AS sx, {sql_micro(f'{C["cy"]} - y * {C["radius"]}')} AS sy FROM w WHERE seen"
    t, n = "(pz / (pz - z))", "sqrt((px + (x - px) * (pz / (pz - z))) * (px + (x - px) * (pz / (pz - z))) + (py + (y - py) * (pz / (pz - z))) * (py + (y - py) * (pz / (pz - z))))"
    cross = f" UNION ALL SELECT line_id, piece, idx * 2 - 1, {sql_micro(f'{C["cx"]} + (px + (x - px) * {t}) * (1 / {n}) * {C["radius"]}')}, {sql_micro(f'{C["cy"]} - (py + (y - py) * {t}) * (1 / {n}) * {C["radius"]}')} FROM w WHERE ps IS NOT NULL AND ps <> seen"
    if space:  # the share of the way to the crossing, by sixteen halvings: a step goes on as long as what is seen there is what was seen before
        there = lambda c: f"(p{c} + ({c} - p{c}) * (lo + pow(2.0::DOUBLE, -k)))"
        lo = f"list_reduce(list_transform(range(1, 17), lambda k: k::DOUBLE), lambda lo, k: CASE WHEN (NOT ({there('z')} < 0 AND {there('x')} * {there('x')} + {there('y')} * {there('y')} < 1)) = ps THEN lo + pow(2.0::DOUBLE, -k) ELSE lo END, 0.0::DOUBLE)"
        cross = f" UNION ALL SELECT line_id, piece, idx * 2 - 1, {sql_micro(f'{C["cx"]} + (px + (x - px) * t) * {C["radius"]}')}, {sql_micro(f'{C["cy"]} - (py + (y - py) * t) * {C["radius"]}')} FROM (SELECT *, {lo} AS t FROM w WHERE ps IS NOT NULL AND ps <> seen)"
    return f"""WITH {TURNED}, s AS (SELECT id // 30 AS line_id, id % 30 AS idx, x * {h} AS x, y * {h} AS y, z * {h} AS z FROM turned), v AS (SELECT *, {seen} AS seen FROM s),
l AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(z) OVER o AS pz, lag(seen) OVER o AS ps FROM v WINDOW o AS (PARTITION BY line_id ORDER BY idx)),
w AS (SELECT *, sum(CASE WHEN seen AND NOT coalesce(ps, false) THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY idx)::BIGINT AS piece FROM l)
{own}{cross}"""

def clip_rings_sql() -> str:
    """The loops' count, points and area: entries and exits along each ring, the nearest entry ahead of every exit, and the walk over them from the first chain on."""
    cross = lambda ax, bx, az, bz: f"({ax} + ({bx} - {ax}) * ({az} / ({az} - {bz})))"
    unit_ = lambda s: ", ".join(f"c{s}{a} / sqrt(c{s}x * c{s}x + c{s}y * c{s}y) AS {s}{a}" for a in "xy")
    return f"""WITH RECURSIVE {CLEAN}, uu AS (SELECT ring_id, idx, cos(lat * (pi() / 180)) * sin(lon * (pi() / 180)) AS x, sin(lat * (pi() / 180)) AS y, cos(lat * (pi() / 180)) * cos(lon * (pi() / 180)) AS z FROM kept),
v AS (SELECT ring_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ring_id) AS n, x * {C['cos_lon']} - z * {C['sin_lon']} AS x, y * {C['cos_lat']} - (x * {C['sin_lon']} + z * {C['cos_lon']}) * {C['sin_lat']} AS y, y * {C['sin_lat']} + (x * {C['sin_lon']} + z * {C['cos_lon']}) * {C['cos_lat']} AS z FROM uu WINDOW w AS (PARTITION BY ring_id ORDER BY idx)),
e AS (SELECT v.*, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, v.z > 0 AS near, v.z > 0 AND NOT p.z > 0 AS enters, v.z > 0 AND NOT q.z > 0 AS leaves FROM v JOIN v p ON p.ring_id = v.ring_id AND p.i = (v.i + v.n - 1) % v.n JOIN v q ON q.ring_id = v.ring_id AND q.i = (v.i + 1) % v.n WHERE v.n >= 3),
nears AS (SELECT *, count(*) FILTER (enters) OVER (PARTITION BY ring_id ORDER BY i) AS cum, count(*) FILTER (enters) OVER (PARTITION BY ring_id) AS chains, count(*) FILTER (near) OVER (PARTITION BY ring_id) AS shown FROM e),
pts AS (SELECT *, (cum + chains - 1) % greatest(1, chains) AS chain FROM nears WHERE near AND chains > 0),
s AS (SELECT ring_id, chain, i AS s, {cross('px', 'x', 'pz', 'z')} AS cex, {cross('py', 'y', 'pz', 'z')} AS cey FROM pts WHERE enters), l AS (SELECT ring_id, chain, {cross('x', 'qx', 'z', 'qz')} AS clx, {cross('y', 'qy', 'z', 'qz')} AS cly FROM pts WHERE leaves),
ch AS (SELECT ring_id, chain, s, {unit_('e')}, {unit_('l')}, (SELECT count(*) FROM pts WHERE pts.ring_id = s.ring_id AND pts.chain = s.chain) AS m FROM s JOIN l USING (ring_id, chain)),
an AS (SELECT *, atan2(ey, ex) AS enter_, atan2(ly, lx) AS leave_ FROM ch),
hop AS (SELECT a.ring_id, a.chain, b.chain AS ahead, CASE WHEN b.enter_ >= a.leave_ THEN b.enter_ - a.leave_ ELSE b.enter_ - a.leave_ + 2 * pi() END AS turn FROM an a JOIN an b ON b.ring_id = a.ring_id QUALIFY row_number() OVER (PARTITION BY a.ring_id, a.chain ORDER BY turn, b.chain) = 1),
walk AS (SELECT ring_id, chain AS begun, chain AS at_, 0 AS d FROM hop UNION ALL SELECT w.ring_id, w.begun, h.ahead, w.d + 1 FROM walk w JOIN hop h ON h.ring_id = w.ring_id AND h.chain = w.at_ WHERE w.d + 1 < (SELECT count(*) FROM hop o WHERE o.ring_id = w.ring_id)),
lab AS (SELECT ring_id, at_ AS chain, begun, d FROM walk QUALIFY row_number() OVER (PARTITION BY ring_id, at_ ORDER BY begun, d) = 1),
sized AS (SELECT an.*, begun, d, turn, greatest(2, ceil(turn / (2 * pi()) * 180))::BIGINT AS steps FROM an JOIN lab USING (ring_id, chain) JOIN hop USING (ring_id, chain)),
placed AS (SELECT *, coalesce(sum(m + 2 + steps) OVER (PARTITION BY ring_id, begun ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
loops AS (
  SELECT ring_id, begun, before AS seq, ex AS x, ey AS y FROM placed UNION ALL SELECT ring_id, begun, before + m + 1, lx, ly FROM placed
  UNION ALL SELECT p.ring_id, begun, before + 1 + (pts.i - p.s + pts.n) % pts.n, pts.x, pts.y FROM placed p JOIN pts ON pts.ring_id = p.ring_id AND pts.chain = p.chain
  UNION ALL SELECT ring_id, begun, before + m + 1 + j, cos(leave_ + turn * j / steps), sin(leave_ + turn * j / steps) FROM (SELECT *, unnest(range(1, steps + 1)) AS j FROM placed)
  UNION ALL SELECT ring_id, 0, i, x, y FROM nears WHERE shown = n
), xy AS (SELECT ring_id, begun, seq, {C['cx']} + x * {C['radius']} AS sx, {C['cy']} - y * {C['radius']} AS sy FROM loops),
edges AS (SELECT *, coalesce(lead(sx) OVER w, first_value(sx) OVER w) AS nx, coalesce(lead(sy) OVER w, first_value(sy) OVER w) AS ny FROM xy WINDOW w AS (PARTITION BY ring_id, begun ORDER BY seq))
SELECT ring_id, count(DISTINCT begun) AS loops, count(*) AS points, round(abs(sum((sx * ny - nx * sy) / 2)), 3) AS area FROM edges GROUP BY ring_id"""


def q_readings(spark, sf_dir):
    p = places(spark, sf_dir)
    return p.select(
        "id", text.compass(F.col("lat") + 0.001, "N", "S").alias("latitude"), text.compass(F.col("lon") + 0.001, "E", "W").alias("longitude"), text.whole_latitude(F.col("lat") + 0.001).alias("whole"),
        text.count(F.col("id") * 7919).alias("count"), text.spacing(F.col("id") % 12).alias("spacing"), micro(text.tenth(F.col("lon"))).alias("tenth"), text.megabytes(F.col("id") * 2_345).alias("size"),
        text.rgb(F.col("id") % 256, F.lit(3), F.lit(7)).alias("rgb"), text.font(F.lit(None).cast("int"), F.when(F.col("id") % 2 == 0, F.lit(14)), F.lit("serif")).alias("font"),
    )


QUERIES = {
    "geo_places": q_places, "geo_project": q_project, "geo_hemisphere": q_hemisphere, "geo_unproject": q_unproject, "geo_displace": q_displace, "geo_geodesic": q_geodesic, "geo_geodesic_ring": q_geodesic_ring,
    "geo_small_circles": q_small_circles, "sql_small_circles": q_sql_small_circles, "sql_geodesic": q_sql_geodesic, "geo_graticule": q_graticule, "orbit_positions": q_orbit_positions, "orbit_rings": q_orbit_rings, "orbit_ground_tracks": q_ground_tracks, "orbit_trails": q_trails,
    "track_hold": q_track_hold, "track_loop": q_track_loop, "field_quantise": q_field, "field_palette": q_palette, "field_overlay": q_overlay, "field_ground": q_ground, "field_ground_colour": q_ground_colour, "anchor_tracking": q_tracking, "ring_clean": q_clean_rings,
    "ring_counts": q_ring_counts, "ring_measures": q_ring_measures, "ring_orient": q_orient_rings, "clip_globe": q_clip, "clip_space": q_clip_space, "clip_rings": q_clip_rings, "text_readings": q_readings,
}

M = sql_micro
SQL = {
    "geo_places": f"""WITH {UNITS} SELECT id, {M('x')} AS x, {M('y')} AS y, {M('z')} AS z, {M('atan2(x, z) * 180 / pi()')} AS lon, {M('asin(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, y))) * 180 / pi()')} AS lat,
  {M('(lon + 180) / 360')} AS u, {M('(90 - lat) / 180')} AS v, {M('(atan2(x, z) + pi()) / (2 * pi())')} AS u2, {M('(pi() / 2 - asin(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, y)))) / pi()')} AS v2 FROM units""",
    "geo_project": f"""WITH {TURNED}, s AS (SELECT id, x * (1 + (id % 7) / 10.0::DOUBLE) AS x, y * (1 + (id % 7) / 10.0::DOUBLE) AS y, z * (1 + (id % 7) / 10.0::DOUBLE) AS z FROM turned)
SELECT id, {M(f'{C["cx"]} + x * {C["radius"]}')} AS sx, {M(f'{C["cy"]} - y * {C["radius"]}')} AS sy, {M('z')} AS depth, NOT (z < 0 AND x * x + y * y < 1) AS visible,
  {M('CASE WHEN sqrt(x * x + y * y) >= 1 OR z >= 0.12 THEN 1 ELSE greatest(0.0::DOUBLE, z / 0.12::DOUBLE) END')} AS fade FROM s""",
    "geo_hemisphere": f"WITH {TURNED} SELECT z > 0 AS near, NOT (z < 0 AND x * 1.2::DOUBLE * (x * 1.2::DOUBLE) + y * 1.2::DOUBLE * (y * 1.2::DOUBLE) < 1) AS seen, count(*) AS n FROM turned GROUP BY ALL",
    "geo_unproject": f"""WITH p AS (SELECT c_custkey AS id, (((c_custkey * 53) % 800)::DOUBLE - {C['cx']}) / {C['radius']} AS nx, ({C['cy']} - ((c_custkey * 31) % 600)::DOUBLE) / {C['radius']} AS ny FROM customer),
n AS (SELECT *, nx * nx + ny * ny AS r2, sqrt(greatest(0.0::DOUBLE, 1 - (nx * nx + ny * ny))) AS nz FROM p), w AS (SELECT *, ny * {C['cos_lat']} + nz * {C['sin_lat']} AS wy, nz * {C['cos_lat']} - ny * {C['sin_lat']} AS z1 FROM n)
SELECT id, CASE WHEN r2 <= 1 THEN {M(f'atan2(nx * {C["cos_lon"]} + z1 * {C["sin_lon"]}, z1 * {C["cos_lon"]} - nx * {C["sin_lon"]}) * 180 / pi()')} END AS lon, CASE WHEN r2 <= 1 THEN {M('asin(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, wy))) * 180 / pi()')} END AS lat FROM w""",
    "geo_displace": f"WITH {UNITS} SELECT id, {', '.join(f'{M(f"{c} * (1 + (id * 3.5::DOUBLE - 1000) * 30.0::DOUBLE / 6371000)")} AS {c}' for c in 'xyz')} FROM units",
    "geo_geodesic": geodesic_sql(False),
    "geo_geodesic_ring": geodesic_sql(True),
    "sql_geodesic": geodesic_sql(False),
    "geo_small_circles": f"""WITH {UNITS}, c AS (SELECT id AS line_id, x, y, z, (id % 50 + 1)::DOUBLE * (pi() / 180) AS r, CASE WHEN abs(y) < 0.9 THEN 0.0 ELSE 1.0 END::DOUBLE AS ax, CASE WHEN abs(y) < 0.9 THEN 1.0 ELSE 0.0 END::DOUBLE AS ay FROM units),
u0 AS (SELECT *, y * 0 - z * ay AS p, z * ax - x * 0 AS q, x * ay - y * ax AS s FROM c), u1 AS (SELECT *, p / sqrt(p * p + q * q + s * s) AS ux, q / sqrt(p * p + q * q + s * s) AS uy, s / sqrt(p * p + q * q + s * s) AS uz FROM u0),
v AS (SELECT *, y * uz - z * uy AS vx, z * ux - x * uz AS vy, x * uy - y * ux AS vz FROM u1), e AS (SELECT *, i, cos(i / 36.0::DOUBLE * (2 * pi())) * sin(r) AS ca, sin(i / 36.0::DOUBLE * (2 * pi())) * sin(r) AS sa FROM v, range(37) t(i)),
o AS (SELECT line_id, i, x * cos(r) + ux * ca + vx * sa AS a, y * cos(r) + uy * ca + vy * sa AS b, z * cos(r) + uz * ca + vz * sa AS c FROM e)
SELECT line_id, i::INTEGER AS i, {M('atan2(a, c) * 180 / pi()')} AS lon, {M('asin(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, b))) * 180 / pi()')} AS lat FROM o""",
    "geo_graticule": """SELECT 'meridian' AS kind, (l * 30 - 180)::INTEGER AS line, i::INTEGER AS i, (l * 30 - 180)::INTEGER AS lon, (i * 2 - 90)::INTEGER AS lat FROM range(12) a(l), range(91) b(i)
UNION ALL SELECT 'parallel', (l * 30 - 60)::INTEGER, i::INTEGER, (i * 2 - 180)::INTEGER, (l * 30 - 60)::INTEGER FROM range(5) a(l), range(181) b(i)""",
    "orbit_positions": f"WITH {ORBITS}, a AS (SELECT *, (phase + 360 * t / period) * (pi() / 180) AS a FROM orb, (VALUES (0.0::DOUBLE), (400.0::DOUBLE), (9000.0::DOUBLE)) v(t)), p AS (SELECT orbit_id, t, {ORBIT_XYZ} FROM a) SELECT orbit_id, t::BIGINT AS t, {M('x')} AS x, {M('y')} AS y, {M('z')} AS z FROM p",
    "orbit_rings": f"WITH {ORBITS}, a AS (SELECT *, i / 24.0::DOUBLE * 360 * (pi() / 180) AS a FROM orb, range(25) v(i)), p AS (SELECT orbit_id, i, {ORBIT_XYZ} FROM a) SELECT orbit_id, i::INTEGER AS i, {M('x')} AS x, {M('y')} AS y, {M('z')} AS z FROM p",
    "orbit_ground_tracks": f"WITH {ORBITS}, a AS (SELECT *, i / 23.0::DOUBLE * 360 * (pi() / 180) AS a FROM orb, range(24) v(i)), p AS (SELECT orbit_id, i, {ORBIT_XYZ} FROM a) SELECT orbit_id, i::INTEGER AS i, {M('degrees(atan2(x, z))')} AS lon, {M('degrees(asin(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, y / sqrt(x * x + y * y + z * z)))))')} AS lat FROM p",
    "orbit_trails": f"""WITH {ORBITS}, s AS (SELECT orbit_id, trail, phase + 360 * 1234.0::DOUBLE / period AS now, least(16, greatest(3, floor(trail / 3 + 0.5)))::BIGINT AS steps FROM orb WHERE trail > 0), e AS (SELECT *, unnest(range(0, steps)) AS i FROM s)
SELECT orbit_id, i::INTEGER AS i, {M('now - trail * (i + 1) / steps')} AS "from", {M('now - trail * i / steps')} AS "to", {M('1 - i::DOUBLE / steps')} AS alpha FROM e""",
    "track_hold": track_sql(False),
    "track_loop": track_sql(True),
    "field_quantise": f"WITH {field_sql(0.25, 'f')} SELECT * FROM f",
    "field_palette": f"WITH {PALETTE} SELECT * FROM ramp",
    "field_overlay": OVERLAY,
    "field_ground_colour": ground_colour_sql(),
    "anchor_tracking": f"{TRACKING} SELECT anchor_id, query_id, {M('cos(lat) * sin(lon) * r')} AS x, {M('sin(lat) * r')} AS y, {M('cos(lat) * cos(lon) * r')} AS z FROM p",
    "field_ground": f"WITH h AS (SELECT c_custkey AS id, c_custkey * 11.0::DOUBLE - 8000 AS h FROM customer) SELECT id, CASE WHEN h < 0 THEN 'sea' ELSE 'land' END AS kind, {M('least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN h < 0 THEN -h / 6000.0::DOUBLE ELSE h / 3500.0::DOUBLE END))')} AS t FROM h",
    "ring_clean": f"WITH {CLEAN} SELECT ring_id // 2 AS polygon_id, ring_id, idx, {M('lon')} AS lon, {M('lat')} AS lat FROM kept",
    "ring_counts": f"WITH {CLEAN} SELECT count(DISTINCT ring_id // 2) AS polygons, count(DISTINCT ring_id) AS rings, count(*) AS points FROM kept",
    "ring_measures": f"WITH {MEASURES} SELECT ring_id, n, {', '.join(M(f'm{c} / sqrt(mx * mx + my * my + mz * mz)') + f' AS c{c}' for c in 'xyz')}, {M('perimeter')} AS perimeter, ax * mx + ay * my + az * mz < 0 AS backwards FROM mm",
    "ring_orient": f"WITH {MEASURES} SELECT u.ring_id, CASE WHEN ax * mx + ay * my + az * mz < 0 THEN n - 1 - idx ELSE idx END AS idx, {M('x')} AS x, {M('y')} AS y, {M('z')} AS z FROM uu u JOIN mm USING (ring_id)",
    "clip_globe": clip_sql(False),
    "clip_space": clip_sql(True),
    "clip_rings": clip_rings_sql(),
    "text_readings": f"""WITH {PLACES} SELECT id, printf('%.1f', abs(lat + 0.001::DOUBLE)) || '°' || CASE WHEN lat + 0.001::DOUBLE < 0 THEN 'S' ELSE 'N' END AS latitude, printf('%.1f', abs(lon + 0.001::DOUBLE)) || '°' || CASE WHEN lon + 0.001::DOUBLE < 0 THEN 'W' ELSE 'E' END AS longitude,
  printf('%.0f', abs(lat + 0.001::DOUBLE)) || '°' || CASE WHEN lat + 0.001::DOUBLE >= 0 THEN 'N' ELSE 'S' END AS whole, format('{{:,}}', id * 7919) AS count,
  CASE WHEN 40075 / (512 * pow(2, id % 12)) >= 10 THEN CAST(floor(40075 / (512 * pow(2, id % 12)) + 0.5) AS BIGINT)::VARCHAR ELSE printf('%.1f', 40075 / (512 * pow(2, id % 12))) END || ' km' AS spacing,
  {M('floor(lon * 10 + 0.5) / 10.0::DOUBLE')} AS tenth, CASE WHEN id * 2345 >= 1048576 THEN printf('%.2f', id * 2345 / 1048576.0::DOUBLE) || ' MB' ELSE printf('%.0f', id * 2345 / 1024.0::DOUBLE) || ' kB' END AS size,
  'rgb(' || id % 256 || ',3,7)' AS rgb, '500 ' || CASE WHEN id % 2 = 0 THEN 14 ELSE 12 END || 'px serif' AS font FROM places""",
}
SQL["sql_small_circles"] = SQL["geo_small_circles"]
