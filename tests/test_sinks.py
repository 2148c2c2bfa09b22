"""Sinks with commit and abort: written once whatever is tried again, nothing left of an aborted job."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.sources import shapes, staged, terrain


class Texts(staged.StagedWriter):
    def parts(self, rows):
        for name, text in rows:
            yield name, iter([text])


def test_a_task_that_runs_twice_counts_once(tmp_path):
    path = str(tmp_path / "out")
    w = Texts(path, True)
    first, again, other = w.write(iter([("a", b"1"), ("b", b"2")])), w.write(iter([("a", b"1"), ("b", b"2")])), w.write(iter([]))
    assert first.files != again.files and not os.path.exists(f"{path}/a")  # nothing appears before the commit
    w.commit([again, None, other])
    assert sorted(os.listdir(path)) == ["a", "b"] and open(f"{path}/a", "rb").read() == b"1"
    with pytest.raises(FileExistsError):
        Texts(path, False)
    w = Texts(path, True)
    w.commit([w.write(iter([("a", b"3")]))])
    assert os.listdir(path) == ["a"] and open(f"{path}/a", "rb").read() == b"3"


def test_an_abort_leaves_nothing_and_a_shared_file_is_refused(tmp_path):
    path = str(tmp_path / "out")
    w = Texts(path, True)
    w.abort([w.write(iter([("a", b"1")])), None])
    assert os.listdir(path) == []
    w = Texts(path, True)
    with pytest.raises(ValueError):
        w.commit([w.write(iter([("a", b"1")])), w.write(iter([("a", b"2")]))])
    assert os.listdir(path) == []


def test_a_failing_job_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "grids")
    good = spark.range(12).select(F.lit("g").alias("name"), (F.col("id") % 4).alias("sx"), F.floor(F.col("id") / 4).alias("sy"), (F.col("id") * 9000 % 32768).alias("value"))
    terrain.write_grids(good, path)
    before = open(f"{path}/g.bin", "rb").read()
    rows = spark.createDataFrame([("g", bytearray(b"x")), ("h", None)], "name string, content binary")
    with pytest.raises(Exception):  # noqa: B017
        rows.repartition(2).write.format("grid").mode("overwrite").save(path)
    assert os.listdir(path) == ["g.bin"] and open(f"{path}/g.bin", "rb").read() == before
    got = {(r.sx, r.sy): r.value for r in terrain.read_grid(spark, path).collect()}
    assert got == {(k % 4, k // 4): float(k * 9000 % 32768) for k in range(12)}


def test_levels_are_written_once_and_read_back(spark, tmp_path):
    path = str(tmp_path / "levels")
    cells = spark.range(2 * 8 * 36).select((F.col("id") % 2).cast("int").alias("z"), (F.floor(F.col("id") / 2) % 2).alias("ty"), (F.floor(F.col("id") / 4) % 4).alias("tx"), (F.floor(F.col("id") / 16) % 6).alias("r"), (F.floor(F.col("id") / 96) % 6).alias("c"), (F.col("id") * 31 % 777).alias("h"))
    stats = cells.groupBy("z", "ty", "tx").agg(F.max("h").alias("error"), F.min("h").alias("low"), F.max("h").alias("high"))
    made = terrain.write_levels(cells, stats, path, 2, 9, 4)
    stamp = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path)}
    assert made.count() == 2 and {r.file: (r.bytes, r.tiles) for r in made.collect()} == {f: (os.path.getsize(f"{path}/{f}"), 8) for f in ("level-0.bin", "level-1.bin")}
    assert stamp == {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path)}  # counting wrote nothing anew
    back = terrain.samples_of(terrain.read_levels(spark, path), 6)
    key = lambda df: sorted((r.z, r.ty, r.tx, r.r, r.c, r.h) for r in df.collect())
    want = cells.groupBy("z", "ty", "tx", "r", "c").agg(F.max("h").alias("h"))
    if want.count() == cells.count():
        assert key(back.filter("z = 0")) == key(want.filter("z = 0"))
    terrain.write_levels(cells.filter("z = 0"), stats, path, 1, 9, 4)
    assert os.listdir(path) == ["level-0.bin"]


def test_geotiff_round_trip(spark, tmp_path):
    want = np.random.default_rng(2).normal(0, 4000, (37, 50)).astype(np.float32)
    rows = [(x, y, float(want[y, x])) for y in range(37) for x in range(50)]
    for tile, path in ((16, str(tmp_path / "many")), (64, str(tmp_path / "one"))):
        terrain.write_geotiff(spark.createDataFrame(rows, "sx long, sy long, value double"), path, 50, 37, tile)
        got = terrain.read_geotiff(spark, f"{path}/raster.tif").collect()
        assert sorted((r.sx, r.sy, r.value) for r in got) == sorted(rows) and os.listdir(path) == ["raster.tif"]


def test_models_are_files(spark, tmp_path):
    path = str(tmp_path / "m")
    v = spark.createDataFrame([("a/b", i, i * 1.0, 0.5, 0.25) for i in range(3)], "model string, i int, x double, y double, z double")
    f = spark.createDataFrame([("a/b", 0, 0, 1, 2, 9, 8, 7)], "model string, f int, a int, b int, c int, r int, g int, bl int")
    shapes.write_models(v, f, path)
    assert os.listdir(path) == ["a%2Fb.json"]
    vertices, faces, faults = shapes.read_models(spark, path)
    assert [tuple(r) for r in faces.collect()] == [("a/b", 0, 0, 1, 2, 9, 8, 7)] and vertices.count() == 3 and faults.count() == 0
