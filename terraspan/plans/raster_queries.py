"""Queries over a raster made of ``lineitem`` rows, and over a tile index made of ``part`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import micro
from ..operators import raster, scene, tiles

SOURCE, FINE, T = (96, 48), (64, 32), 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number heights in thousandths; some rows have no data."""
    li = read(spark, sf_dir, "lineitem")
    value = F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45), F.lit(-99_999)).otherwise(F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long") % 30_000)
    return raster.valid_samples(li.select(
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 96).alias("sx"), ((F.col("l_partkey") * 5 + F.col("l_suppkey") * 11) % 48).alias("sy"), value.alias("value"),
    ))


def finest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.box_average(samples(spark, sf_dir), SOURCE, FINE)


SAMPLES = """
samples AS (
  SELECT (l_orderkey * 7 + l_linenumber * 13) % 96 AS sx, (l_partkey * 5 + l_suppkey * 11) % 48 AS sy,
         CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) % 30000 AS value
  FROM lineitem WHERE NOT (l_linenumber = 7 AND l_quantity > 45)
), cells AS (
  SELECT y, x FROM range(32) a(y), range(64) b(x)
), mean AS (
  SELECT (sy * 32) // 48 AS y, (sx * 64) // 96 AS x, CAST(floor(sum(value) / CAST(count(*) AS DOUBLE) + 0.5) AS BIGINT) AS h, count(*) AS hits FROM samples GROUP BY 1, 2
), fine AS (
  SELECT c.y, c.x, coalesce(m.h, 0) AS h, coalesce(m.hits, 0) AS hits FROM cells c LEFT JOIN mean m ON m.y = c.y AND m.x = c.x
), coarse AS (
  SELECT y // 2 AS y, x // 2 AS x, CAST(floor(sum(h) / 4.0::DOUBLE + 0.5) AS BIGINT) AS h FROM fine GROUP BY 1, 2
), pyramid AS (SELECT 1 AS z, y, x, h FROM fine UNION ALL SELECT 0, y, x, h FROM coarse)
"""
PREDICTED = """
, sent AS (
  SELECT (2 * x + dx + 64) % 64 AS x, CASE WHEN yy < 0 THEN 0 WHEN yy > 31 THEN 31 ELSE yy END AS y, h * wx * wy AS part
  FROM (SELECT h, x, dx, wx, 2 * y + dy AS yy, wy FROM coarse,
        (VALUES (0, 3), (1, 3), (2, 1), (-1, 1)) a(dx, wx), (VALUES (0, 3), (1, 3), (2, 1), (-1, 1)) b(dy, wy))
), predicted AS (SELECT y, x, CAST(floor(sum(part) / 16.0::DOUBLE + 0.5) AS BIGINT) AS predicted FROM sent GROUP BY 1, 2)
"""
BORDERED = """
, stored AS (
  SELECT z, ty, tx, r, c, p.h
  FROM (SELECT z, ty, tx, r, c, least(greatest(ty * 8 + r - 1, 0), 16 * (1 + z) - 1) AS y, (tx * 8 + c - 1 + 32 * (1 + z)) % (32 * (1 + z)) AS x
        FROM (VALUES (0), (1)) l(z), range(8) a(tx), range(4) b(ty), range(10) e(r), range(10) f(c)
        WHERE tx < 4 * (1 + z) AND ty < 2 * (1 + z)) q
  JOIN pyramid p USING (z, y, x)
)
"""


def q_box_average(spark, sf_dir):
    return finest(spark, sf_dir)


def cells(spark, sf_dir) -> DataFrame:
    """Both levels with their predictions; level 0 is predicted as 0."""
    levels = raster.pyramid(finest(spark, sf_dir), 2)
    fine = levels.filter("z = 1")
    guess = raster.predict(levels.filter("z = 0"), *FINE)
    return fine.join(guess, ["y", "x"]).select("z", "y", "x", "h", "predicted").unionByName(levels.filter("z = 0").withColumn("predicted", F.lit(0).cast("long")))


def q_raster_pyramid(spark, sf_dir):
    """The flagship: scan, filter, average, reduce, predict, and the statistics of tiles."""
    return raster.tile_stats(cells(spark, sf_dir), T)


def q_peak(spark, sf_dir):
    return raster.peak(finest(spark, sf_dir))


def q_predict(spark, sf_dir):
    return raster.predict(raster.reduce_level(finest(spark, sf_dir)), *FINE)


def stored(spark, sf_dir) -> DataFrame:
    levels = raster.pyramid(finest(spark, sf_dir), 2)
    return raster.cut_tiles(levels.filter("z = 1"), *FINE, T).unionByName(raster.cut_tiles(levels.filter("z = 0"), FINE[0] // 2, FINE[1] // 2, T))


def q_cut_tiles(spark, sf_dir):
    return stored(spark, sf_dir)


def q_encode(spark, sf_dir):
    """Heights are tripled so that residuals overflow 16 bits; ``same`` tells whether decoding gives the (wrapped) heights back."""
    tripled = stored(spark, sf_dir).withColumn("h", F.col("h") * 3)
    coded = raster.encode(tripled)
    back = raster.decode(coded.withColumnRenamed("h", "was"))
    return back.select("z", "ty", "tx", "r", "c", "residual", (F.col("h") == raster.wrap16(F.col("was"))).alias("same"))


def points(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("point_id"), ((k * 37) % 1000 / 500.0 - 0.5).alias("u"), ((k * 91) % 997 / 997.0).alias("v"))


POINTS = "points AS (SELECT c_custkey AS point_id, (c_custkey * 37) % 1000 / 500.0::DOUBLE - 0.5::DOUBLE AS u, (c_custkey * 91) % 997 / 997.0::DOUBLE AS v FROM customer)"


def q_sample_heights(spark, sf_dir):
    """Some fine tiles aren't resident, and some tiles of neither level are."""
    resident = stored(spark, sf_dir).filter("not (z = 1 and (tx + ty) % 3 = 0) and not (z = 0 and tx = 2)")
    out = raster.sample_heights(points(spark, sf_dir), resident, 1, T, slopes=True)
    return out.select("point_id", micro(F.col("height")).alias("height"), F.col("answered").cast("int").alias("answered"), micro(F.col("east") * 1000).alias("east"), micro(F.col("north") * 1000).alias("north"))


SAMPLED = f"""
WITH {SAMPLES} {BORDERED}, {POINTS}, asked AS (
  SELECT point_id, u, v, z, least(4 * (1 + z) - 1, greatest(0, CAST(floor((u - floor(u)) * 4 * (1 + z)) AS BIGINT))) AS tx,
         least(2 * (1 + z) - 1, greatest(0, CAST(floor(v * 2 * (1 + z)) AS BIGINT))) AS ty
  FROM points, (VALUES (0), (1)) l(z)
), best AS (
  SELECT * FROM asked WHERE NOT (z = 1 AND (tx + ty) % 3 = 0) AND NOT (z = 0 AND tx = 2)
  QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY z DESC) = 1
), at AS (
  SELECT *, (u - floor(u)) * (32 * (1 + z)) - 0.5::DOUBLE - tx * 8 + 1 AS fx, v * (16 * (1 + z)) - 0.5::DOUBLE - ty * 8 + 1 AS fy FROM best
), taps AS (
  SELECT b.point_id, b.z, b.v, fx - floor(fx) AS sx, fy - floor(fy) AS sy,
         max(CASE WHEN s.r = floor(fy) AND s.c = floor(fx) THEN s.h END)::DOUBLE AS h0, max(CASE WHEN s.r = floor(fy) AND s.c = floor(fx) + 1 THEN s.h END)::DOUBLE AS h1,
         max(CASE WHEN s.r = floor(fy) + 1 AND s.c = floor(fx) THEN s.h END)::DOUBLE AS h2, max(CASE WHEN s.r = floor(fy) + 1 AND s.c = floor(fx) + 1 THEN s.h END)::DOUBLE AS h3
  FROM at b JOIN stored s ON s.z = b.z AND s.ty = b.ty AND s.tx = b.tx AND s.r BETWEEN floor(fy) AND floor(fy) + 1 AND s.c BETWEEN floor(fx) AND floor(fx) + 1
  GROUP BY ALL
), out AS (
  SELECT point_id, z, (h0 + (h1 - h0) * sx) + ((h2 + (h3 - h2) * sx) - (h0 + (h1 - h0) * sx)) * sy AS height,
         (h1 - h0 + (h3 - h2 - (h1 - h0)) * sy) * (32 * (1 + z)) / (2 * pi() * 6371000 * greatest(0.02::DOUBLE, cos((0.5::DOUBLE - v) * pi()))) AS east,
         -(h2 - h0 + (h3 - h1 - (h2 - h0)) * sx) * (16 * (1 + z)) / (pi() * 6371000) AS north
  FROM taps
)
SELECT p.point_id, CAST(floor(coalesce(height, 0) * 1e6 + 0.5) AS BIGINT) AS height, coalesce(o.z, -1)::INTEGER AS answered,
       CAST(floor(coalesce(east, 0) * 1000 * 1e6 + 0.5) AS BIGINT) AS east, CAST(floor(coalesce(north, 0) * 1000 * 1e6 + 0.5) AS BIGINT) AS north
FROM points p LEFT JOIN out o USING (point_id)
""".replace("), at AS (", "), spot AS (").replace("FROM at b", "FROM spot b")


def q_anchor_terrain(spark, sf_dir):
    """Models that stand on the displaced terrain, some where only coarse tiles or none are resident."""
    k = F.col("c_custkey")
    anchors = read(spark, sf_dir, "customer").select(k.alias("anchor_id"), ((k * 37) % 3600 / 10.0 - 180).alias("lon"), ((k * 91) % 1700 / 10.0 - 85).alias("lat"), ((k % 3) * 10.0).alias("altitude_km"))
    resident = stored(spark, sf_dir).filter("not (z = 1 and (tx + ty) % 3 = 0) and not (z = 0 and tx = 2)")
    out = scene.on_terrain(anchors, resident, 1, 30.0, T)
    return out.select("anchor_id", F.col("answered").cast("int").alias("answered"), *(micro(F.col(c)).alias(c) for c in "xyz"))


ANCHORS = "points AS (SELECT *, (lon + 180) / 360 AS u, (90 - lat) / 180 AS v FROM (SELECT c_custkey AS point_id, (c_custkey * 37) % 3600 / 10.0::DOUBLE - 180 AS lon, (c_custkey * 91) % 1700 / 10.0::DOUBLE - 85 AS lat, (c_custkey % 3) * 10.0::DOUBLE AS altitude FROM customer))"
ANCHORED = SAMPLED[: SAMPLED.index("SELECT p.point_id")].replace(POINTS, ANCHORS) + """, r AS (
  SELECT p.point_id, coalesce(o.z, -1) AS answered, lon * (pi() / 180) AS lon, lat * (pi() / 180) AS lat, 1 + altitude / 6371 + coalesce(height, 0) / 6371000 * 30 AS r FROM points p LEFT JOIN out o USING (point_id)
)
SELECT point_id AS anchor_id, answered::INTEGER AS answered, CAST(floor(cos(lat) * sin(lon) * r * 1e6 + 0.5) AS BIGINT) AS x, CAST(floor(sin(lat) * r * 1e6 + 0.5) AS BIGINT) AS y,
       CAST(floor(cos(lat) * cos(lon) * r * 1e6 + 0.5) AS BIGINT) AS z FROM r
"""


def q_tile_ids(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("z", F.col("point_id") % 4)
    z, u, v = F.col("z"), F.col("u"), F.col("v")
    tx, ty = raster.tile_of(z, u, v)
    fx, fy = raster.in_tile(z, u, v)
    out = p.select("point_id", "z", tx.cast("long").alias("tx"), ty.cast("long").alias("ty"), raster.tile_id(z, tx.cast("long"), ty.cast("long")).alias("id"), micro(fx).alias("fx"), micro(fy).alias("fy"))
    return out.withColumn("level", raster.level_of(F.col("id"), 4))


def tile_index(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    base = read(spark, sf_dir, "part").select(k.alias("id"), (k % 3).alias("z"), (F.col("p_size") * 3 + 40).cast("long").alias("length"), (F.floor(F.col("p_retailprice") * 10 + 0.5).cast("long") % 997).alias("error"))
    return raster.payload_offsets(base, order=("id",))


INDEX = """
base AS (SELECT p_partkey AS id, p_partkey % 3 AS z, (p_size * 3 + 40)::BIGINT AS length, CAST(floor(p_retailprice * 10 + 0.5) AS BIGINT) % 997 AS error FROM part
), tiles AS (
  SELECT *, (coalesce(sum(length) OVER (PARTITION BY z ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM base
)
"""
RUNS = f"""
WITH {INDEX}, want AS (
  SELECT *, "offset" + length AS t FROM tiles WHERE (id * 7) % 10 < 6 AND id % 11 <> 0 AND id % 13 <> 0
), marks AS (
  SELECT *, CASE WHEN "offset" = lag(t) OVER (PARTITION BY z ORDER BY "offset") THEN 0 ELSE 1 END AS b FROM want
), islands AS (SELECT *, sum(b) OVER (PARTITION BY z ORDER BY "offset") AS run FROM marks
), runs AS (
  SELECT z, min("offset") AS "from", max(t) AS "to", count(*) AS n, string_agg(id, ',' ORDER BY "offset") AS ids, max(error) AS error FROM islands GROUP BY z, run
)
"""


def runs(spark, sf_dir) -> DataFrame:
    index = tile_index(spark, sf_dir)
    wanted = tiles.missing(index.filter("(id * 7) % 10 < 6"), index.filter("id % 11 = 0"), index.filter("id % 13 = 0"))
    return tiles.coalesce_runs(wanted).withColumn("ids", F.array_join("ids", ","))


def q_runs(spark, sf_dir):
    return runs(spark, sf_dir)


def q_next_runs(spark, sf_dir):
    return tiles.next_runs(runs(spark, sf_dir), in_flight=2)


def q_offsets(spark, sf_dir):
    return tile_index(spark, sf_dir)


def cache(spark, sf_dir) -> DataFrame:
    return tile_index(spark, sf_dir).select("id", "z", ((F.col("id") * 7919) % 1009).alias("used")).filter("id <= 1900")


def q_evict(spark, sf_dir):
    return tiles.evicted(cache(spark, sf_dir))


def q_evict_fields(spark, sf_dir):
    return tiles.evicted(cache(spark, sf_dir).filter("id <= 50"), tiles.CACHE_FIELDS, "false")


def q_ladder(spark, sf_dir):
    """All ladders of statuses for two levels: key k encodes them and how far the first frame has got."""
    status = lambda d: F.element_at(F.array(*map(F.lit, ("absent", "opening", "ready", "missing"))), (d % 4 + 1).cast("int"))
    k = F.col("r_regionkey")
    n = read(spark, sf_dir, "region").select(F.explode(F.array(F.struct(F.lit(0).alias("z"), F.lit("ready").alias("status")), F.struct(F.lit(1).alias("z"), status(k).alias("status")), F.struct(F.lit(2).alias("z"), status(k + 2).alias("status")), F.struct(F.lit(3).alias("z"), F.lit("ready").alias("status")))).alias("s"), k.alias("k"))
    out = None
    for key in range(5):
        one = tiles.ladder(n.filter(F.col("k") == key).select("s.*"), key % 3).withColumn("k", F.lit(key))
        out = one if out is None else out.unionByName(one)
    return out


def q_asks(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.expr("event_id div 50")).alias("frame"), (F.col("user_id") % 20).alias("id"))
    return tiles.asked_once(e)


def q_transfers(spark, sf_dir):
    r = runs(spark, sf_dir)
    return tiles.transfer_totals(r.select((F.col("to") - F.col("from")).alias("bytes"), F.col("n").alias("tiles")))


QUERIES = {
    "raster_pyramid": q_raster_pyramid, "raster_box_average": q_box_average, "raster_peak": q_peak, "raster_predict": q_predict, "raster_cut_tiles": q_cut_tiles, "raster_codec": q_encode,
    "raster_sample_heights": q_sample_heights, "anchor_terrain": q_anchor_terrain, "tile_ids": q_tile_ids, "tile_offsets": q_offsets, "tile_runs": q_runs, "tile_next_runs": q_next_runs, "tile_evict": q_evict,
    "tile_evict_fields": q_evict_fields, "tile_ladder": q_ladder, "tile_asks": q_asks, "tile_transfers": q_transfers,
}

SQL = {
    "raster_box_average": f"WITH {SAMPLES} SELECT * FROM fine",
    "raster_pyramid": f"""WITH {SAMPLES} {PREDICTED}, joined AS (
  SELECT 1 AS z, f.y, f.x, f.h, p.predicted FROM fine f JOIN predicted p USING (y, x) UNION ALL SELECT 0, y, x, h, 0 FROM coarse)
SELECT z::INTEGER AS z, y // 8 AS ty, x // 8 AS tx, least(65535, max(abs(h - predicted))) AS error, min(h) AS low, max(h) AS high FROM joined GROUP BY ALL""",
    "raster_peak": f"WITH {SAMPLES} SELECT greatest(0, max(h)) AS peak FROM fine",
    "raster_predict": f"WITH {SAMPLES} {PREDICTED} SELECT * FROM predicted",
    "raster_cut_tiles": f"WITH {SAMPLES} {BORDERED} SELECT z::INTEGER AS z, ty, tx, r, c, h FROM stored",
    "raster_codec": f"""WITH {SAMPLES} {BORDERED}
SELECT a.z::INTEGER AS z, a.ty, a.tx, a.r, a.c, ((((a.h - coalesce(b.h, 0)) * 3 + 32768) % 65536 + 65536) % 65536 - 32768) AS residual, true AS same
FROM stored a LEFT JOIN stored b ON b.z = a.z AND b.ty = a.ty AND b.tx = a.tx AND ((a.c > 0 AND b.r = a.r AND b.c = a.c - 1) OR (a.c = 0 AND b.c = 0 AND b.r = a.r - 1))""",
    "raster_sample_heights": SAMPLED,
    "anchor_terrain": ANCHORED,
    "tile_ids": f"""WITH {POINTS}, l AS (SELECT *, point_id % 4 AS z, CAST(4 * pow(2, point_id % 4) AS BIGINT) AS across FROM points),
t AS (SELECT *, least(across - 1, greatest(0, CAST(floor((u - floor(u)) * across) AS BIGINT))) AS tx, least(across // 2 - 1, greatest(0, CAST(floor(v * (across // 2)) AS BIGINT))) AS ty FROM l)
SELECT point_id, z, tx, ty, CAST(8 * (pow(4, z) - 1) / 3 AS BIGINT) + ty * across + tx AS id, CAST(floor(((u - floor(u)) * (across * 128) - 0.5::DOUBLE - tx * 128 + 1) * 1e6 + 0.5) AS BIGINT) AS fx,
       CAST(floor((v * (across * 64) - 0.5::DOUBLE - ty * 128 + 1) * 1e6 + 0.5) AS BIGINT) AS fy, z::INTEGER AS level FROM t""",
    "tile_offsets": f"WITH {INDEX} SELECT * FROM tiles",
    "tile_runs": f"{RUNS} SELECT * FROM runs",
    "tile_next_runs": f'{RUNS} SELECT * FROM runs ORDER BY z, error DESC, "from" LIMIT 6',
    "tile_evict": f"""WITH {INDEX}, c AS (SELECT id, z, (id * 7919) % 1009 AS used FROM tiles WHERE id <= 1900)
SELECT id, z, used FROM c WHERE z <> 0 QUALIFY row_number() OVER (ORDER BY used, id) <= (SELECT count(*) FROM c) - 320""",
    "tile_evict_fields": f"""WITH {INDEX}, c AS (SELECT id, z, (id * 7919) % 1009 AS used FROM tiles WHERE id <= 50)
SELECT id, z, used FROM c QUALIFY row_number() OVER (ORDER BY used, id) <= (SELECT count(*) FROM c) - 32""",
    "tile_ladder": """WITH s AS (
  SELECT r_regionkey AS k, z, CASE z WHEN 1 THEN (['absent', 'opening', 'ready', 'missing'])[r_regionkey % 4 + 1] WHEN 2 THEN (['absent', 'opening', 'ready', 'missing'])[(r_regionkey + 2) % 4 + 1] ELSE 'ready' END AS status
  FROM region, range(4) t(z)),
e AS (SELECT *, z BETWEEN 1 AND 2 AND z <= k % 3 + coalesce(sum(CASE WHEN status = 'missing' AND z BETWEEN 1 AND 2 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earned FROM s)
SELECT z::INTEGER AS z, status, CASE WHEN NOT earned OR status = 'missing' THEN 'none' WHEN status = 'ready' THEN 'want' WHEN status = 'absent' THEN 'open' ELSE 'none' END AS action, k::INTEGER AS k FROM e""",
    "tile_asks": "SELECT DISTINCT event_id // 50 AS frame, user_id % 20 AS id FROM events",
    "tile_transfers": f'{RUNS} SELECT sum("to" - "from")::BIGINT AS bytes, sum(n)::BIGINT AS resident FROM runs',
}
