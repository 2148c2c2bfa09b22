"""Level files as a stream: what each batch brings, levels that are missing, surfaces as they get finer."""

import os
import shutil

from pyspark.sql import functions as F

from terraspan.operators import raster
from terraspan.sources import terrain
from terraspan.streaming import arrivals


def made(spark, path):
    cells = [(z, ty, tx, r, c, (z * 50 + ty * 31 + tx * 17 + r * 7 + c * 3) % 97) for z in (0, 1, 2) for ty in range(2 << z) for tx in range(4 << z) for r in range(4) for c in range(4)]
    stored = spark.createDataFrame(cells, "z int, ty long, tx long, r long, c long, h long")
    stats = stored.groupBy("z", "ty", "tx").agg(F.max("h").alias("error"), F.min("h").alias("low"), F.max("h").alias("high"))
    terrain.write_levels(stored, stats, path, 3, 9, 2)
    return stored


def test_offsets_and_missing_levels(spark, tmp_path):
    made(spark, str(tmp_path / "made"))
    there = tmp_path / "in"
    os.makedirs(there)
    give = lambda z: shutil.copy(tmp_path / "made" / f"level-{z}.bin", there / f"level-{z}.bin")
    s = terrain.TerrainStream(str(there), terrain.MAGIC, 5)
    tiles = lambda a, b: sum(len(p.entries) for p in s.partitions(a, b))
    assert s.latestOffset() == {} and tiles({}, {}) == 0
    give(0)
    first = s.latestOffset()
    assert first == {"0": 8} and tiles({}, first) == 8
    give(2)
    second = s.latestOffset()
    assert second == {"0": 8, "1": -1, "2": 128} and tiles(first, second) == 128
    give(1)  # too late: the level is written off
    third = s.latestOffset()
    assert tiles(second, third) == 0 and tiles({}, third) == 8 + 32 + 128
    assert sum(b.num_rows for p in s.partitions(first, second) for b in s.read(p)) == 128


def test_a_surface_by_batches_equals_the_whole(spark, tmp_path):
    stored = made(spark, str(tmp_path / "made"))
    there, path, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    os.makedirs(there)
    points = spark.createDataFrame([(k, ((k * 37) % 101) / 50 - 0.5, ((k * 53) % 97) / 97, "x") for k in range(150)], "point_id long, u double, v double, more string")
    seen = []
    for z in (0, 1, 2):
        shutil.copy(tmp_path / "made" / f"level-{z}.bin", tmp_path / "level")
        os.rename(tmp_path / "level", there / f"level-{z}.bin")
        arrivals.start_surface(terrain.stream_levels(spark, str(there), run="7"), points, path, check, 2, 2).awaitTermination()
        got = arrivals.surface(points, path).collect()
        want = raster.sample_heights(points, stored.filter(F.col("z") <= z), 2, 2).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        seen.append({r.answered for r in got})
    assert seen == [{0}, {1}, {2}]
    arrivals.start_surface(terrain.stream_levels(spark, str(there), run="7"), points, path, check, 2, 2).awaitTermination()  # nothing new
    assert sorted(map(tuple, arrivals.surface(points, path).collect())) == sorted(map(tuple, got))
