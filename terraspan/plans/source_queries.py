"""Queries that write files of each format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import micro
from ..operators import raster
from ..sources import shapes, terrain
from ..storage import filesystem, scratch
from ..streaming import arrivals
from . import raster_queries as rq
from .geo_queries import CLEAN, M, clean, quantised
from .scene_queries import FACE_ROWS, HUT, MAST, models


def terrain_files(spark, sf_dir) -> str:
    path = scratch(spark)
    stats = raster.tile_stats(rq.cells(spark, sf_dir), rq.T)
    terrain.write_levels(rq.stored(spark, sf_dir), stats, path, 2, 30_000, rq.T)
    return path


def q_terrain(spark, sf_dir):
    """Level files, written and read: statistics and a checksum of every tile."""
    tiles = terrain.read_levels(spark, terrain_files(spark, sf_dir), magic=terrain.MAGIC, run="5")
    cells = terrain.samples_of(tiles, rq.T + 2).groupBy("z", "ty", "tx").agg(F.sum(F.col("h") * (F.col("r") * 10 + F.col("c") + 1)).alias("checksum"))
    return tiles.select("z", "ty", "tx", "error", "low", "high").join(cells, ["z", "ty", "tx"])


def q_terrain_pruned(spark, sf_dir):
    """Only some tiles of level 1: the predicate is pushed into the reader."""
    tiles = terrain.read_levels(spark, terrain_files(spark, sf_dir)).filter("z = 1 and tx in (2, 5)")
    return tiles.select("z", "ty", "tx", "low", "high")


def q_geotiff(spark, sf_dir):
    """The mean of the samples of each place as a float raster, written as GeoTIFF, read back, and averaged to the finest level."""
    path = scratch(spark)
    mean = rq.samples(spark, sf_dir).groupBy("sx", "sy").agg((F.sum("value") / F.count(F.lit(1)) / 8.0).alias("value"))
    terrain.write_geotiff(mean, path, *rq.SOURCE, tile=16)
    return terrain.read_geotiff(spark, f"{path}/raster.tif").select("sx", "sy", F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("value"))


def q_grid(spark, sf_dir):
    """Each level of the pyramid as a single grid, written and read back; heights are tripled so that residuals overflow 16 bits."""
    path = scratch(spark)
    levels = raster.pyramid(rq.finest(spark, sf_dir), 2)
    terrain.write_grids(levels.select(F.concat(F.lit("level-"), "z").alias("name"), F.col("x").alias("sx"), F.col("y").alias("sy"), raster.wrap16(F.col("h") * 3).alias("value")), path)
    return terrain.read_grid(spark, path).groupBy("sx", "sy").agg(F.sum("value").cast("long").alias("value"), F.count(F.lit(1)).alias("grids"))


def q_geojson(spark, sf_dir):
    """Nations' rings as a feature collection (pairs of rings as polygons, every third pair as a multi-polygon), read back and cleaned."""
    path = scratch(spark)
    ring = clean(spark, sf_dir).groupBy("polygon_id", "ring_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"])).alias("r"))
    polygon = ring.groupBy("polygon_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring_id", "r"))), lambda p: p["r"]).alias("p"))
    multi = F.col("polygon_id") % 3 == 0
    text = F.when(multi, F.to_json(F.array("p"))).otherwise(F.to_json("p"))
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), F.when(multi, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), text, F.lit("}}"))
    features = polygon.agg(F.transform(F.array_sort(F.collect_list(F.struct("polygon_id", feature.alias("t")))), lambda s: s["t"]).alias("all"))
    features.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("all", ","), F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    points = shapes.read_geojson(spark, path)
    return quantised(points.select(F.col("polygon_id._f").cast("long").alias("polygon"), F.col("ring_id").cast("long").alias("ring"), F.col("idx").cast("long").alias("idx"), "lon", "lat"), "lon", "lat")


def q_outline_counts(spark, sf_dir):
    return shapes.write_outlines(clean(spark, sf_dir), scratch(spark))


def q_models(spark, sf_dir):
    path = scratch(spark)
    shapes.write_models(*models(spark), path)
    v, f, faults = shapes.read_models(spark, path)
    corners = f.join(v, (f["model"] == v["model"]) & (f["a"] == v["i"])).select(f["model"], "f", "a", "b", "c", "r", "g", F.col("bl").alias("blue"), *(micro(F.col(n)).alias(n) for n in "xyz"))
    return corners.join(faults, "model", "left_anti")


def q_late_tiles(spark, sf_dir):
    """Customers' heights on a surface whose level files arrive one by one; three batches, each refining what is under its tiles."""
    path, size = scratch(spark), 4
    levels = raster.pyramid(rq.finest(spark, sf_dir), 3)
    stored, stats = None, raster.tile_stats(levels.withColumn("predicted", F.lit(0).cast("long")), size)
    for z in range(3):
        cut = raster.cut_tiles(levels.filter(F.col("z") == z), rq.FINE[0] >> 2 - z, rq.FINE[1] >> 2 - z, size)
        stored = cut if stored is None else stored.unionByName(cut)
    terrain.write_levels(stored, stats, f"{path}/made", 3, 30_000, size)
    where, root = filesystem(path)
    where.create_dir(f"{root}/levels", recursive=True)
    points = rq.points(spark, sf_dir)
    for z in range(3):
        where.copy_file(f"{root}/made/level-{z}.bin", f"{root}/_level")
        where.move(f"{root}/_level", f"{root}/levels/level-{z}.bin")
        arrivals.start_surface(terrain.stream_levels(spark, f"{path}/levels", magic=terrain.MAGIC, run="16"), points, path, f"{path}/checkpoint", 2, size).awaitTermination()
    return arrivals.surface(points, path).select("point_id", micro(F.col("height")).alias("height"), F.col("answered").cast("int").alias("answered"))


QUERIES = {"stream_late_tiles": q_late_tiles, "source_terrain": q_terrain, "source_terrain_pruned": q_terrain_pruned, "source_geotiff": q_geotiff, "source_grid": q_grid, "source_geojson": q_geojson, "source_outline_counts": q_outline_counts, "source_models": q_models}
STATS = f"WITH {rq.SAMPLES} {rq.PREDICTED} {rq.BORDERED}, joined AS (SELECT 1 AS z, f.y, f.x, f.h, p.predicted FROM fine f JOIN predicted p USING (y, x) UNION ALL SELECT 0, y, x, h, 0 FROM coarse), st AS (SELECT z::INTEGER AS z, y // 8 AS ty, x // 8 AS tx, least(65535, max(abs(h - predicted)))::INTEGER AS error, min(h)::INTEGER AS low, max(h)::INTEGER AS high FROM joined GROUP BY ALL)"
SQL = {
    "stream_late_tiles": f"""WITH {rq.SAMPLES}, {rq.POINTS}, spot AS (SELECT point_id, (u - floor(u)) * 64 - 0.5::DOUBLE AS fx, v * 32 - 0.5::DOUBLE AS fy FROM points),
  four AS (SELECT point_id, fx - floor(fx) AS sx, fy - floor(fy) AS sy, max(CASE WHEN d = 0 THEN h END)::DOUBLE AS h0, max(CASE WHEN d = 1 THEN h END)::DOUBLE AS h1, max(CASE WHEN d = 2 THEN h END)::DOUBLE AS h2, max(CASE WHEN d = 3 THEN h END)::DOUBLE AS h3
    FROM spot, range(4) t(d) JOIN fine f ON f.x = (floor(fx)::BIGINT + d % 2 + 64) % 64 AND f.y = least(31, greatest(0, floor(fy)::BIGINT + d // 2)) GROUP BY ALL)
  SELECT point_id, {M('(h0 + (h1 - h0) * sx) + ((h2 + (h3 - h2) * sx) - (h0 + (h1 - h0) * sx)) * sy')} AS height, 2::INTEGER AS answered FROM four""",
    "source_terrain": f"{STATS} SELECT st.z, st.ty, st.tx, error, low, high, sum(s.h * (r * 10 + c + 1))::BIGINT AS checksum FROM st JOIN stored s ON s.z = st.z AND s.ty = st.ty AND s.tx = st.tx GROUP BY ALL",
    "source_terrain_pruned": f"{STATS} SELECT z, ty, tx, low, high FROM st WHERE z = 1 AND tx IN (2, 5)",
    "source_geotiff": f"WITH {rq.SAMPLES}, at_source AS (SELECT sx, sy, (sum(value) / CAST(count(*) AS DOUBLE) / 8.0::DOUBLE)::FLOAT AS v FROM samples GROUP BY 1, 2) SELECT x AS sx, y AS sy, CAST(floor(coalesce(v, 0)::DOUBLE * 1000 + 0.5) AS BIGINT) AS value FROM range(96) a(x), range(48) b(y) LEFT JOIN at_source m ON m.sx = x AND m.sy = y",
    "source_grid": f"WITH {rq.SAMPLES} SELECT x AS sx, y AS sy, sum((h * 3 + 32768) % 65536 - 32768)::BIGINT AS value, count(*) AS grids FROM pyramid GROUP BY 1, 2",
    "source_geojson": f"WITH {CLEAN} SELECT dense_rank() OVER (ORDER BY ring_id // 2) - 1 AS polygon, dense_rank() OVER (PARTITION BY ring_id // 2 ORDER BY ring_id) - 1 AS ring, idx, {M('lon')} AS lon, {M('lat')} AS lat FROM kept",
    "source_outline_counts": f"WITH {CLEAN} SELECT count(DISTINCT ring_id // 2) AS polygons, count(DISTINCT ring_id) AS rings, count(*) AS points FROM kept",
    "source_models": f"WITH v AS ({HUT} UNION ALL {MAST}), {FACE_ROWS} SELECT f.*, {M('round(x, 4)')} AS x, {M('round(y, 4)')} AS y, {M('round(z, 4)')} AS z FROM faces f JOIN v ON v.model = f.model AND v.i = f.a",
}
