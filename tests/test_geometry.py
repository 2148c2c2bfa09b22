"""Golden constants and properties of the geometry, and the edge cases that tables don't hold."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import geo, numbers, text
from terraspan.operators import curves, fields, mesh, morphs, orbits, raster, scene, state, tiles, tracks
from terraspan.sources import shapes, terrain
from terraspan.streaming import sessions

LONDON, NEW_YORK, TOKYO, SYDNEY, SINGAPORE, CAPE, SANTIAGO = (-0.1276, 51.5072), (-74.006, 40.7128), (139.6917, 35.6895), (151.2093, -33.8688), (103.8198, 1.3521), (18.4241, -33.9249), (-70.6693, -33.4489)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def line(spark, *lines):
    return spark.createDataFrame([(k, i, float(a), float(b)) for k, way in enumerate(lines) for i, (a, b) in enumerate(way)], "line_id int, idx int, lon double, lat double")


def test_rounding(spark):
    assert [value(spark, numbers.round_up(F.lit(v))) for v in (-2.5, 2.5, -0.5)] == [-2, 3, 0]
    assert value(spark, numbers.wrap16(F.lit(40_000))) == -25_536
    assert value(spark, numbers.wrap(F.lit(-1.0), 12.0)) == 11.0
    assert math.isnan(value(spark, numbers.clamp(F.lit(float("nan")), 0.0, 1.0))) or value(spark, numbers.clamp(F.lit(float("nan")), 0.0, 1.0)) == 1.0


def test_span_east(spark):
    spans = [value(spark, geo.span_east(F.lit(float(w)), F.lit(float(e)))) for w, e in ((170, -170), (-180, 180), (5, 5))]
    assert spans == [20.0, 360.0, 360.0]


def test_geodesic_steps(spark):
    n = {r["line_id"]: r["n"] for r in curves.geodesic(line(spark, (LONDON, NEW_YORK), (TOKYO, SYDNEY), (CAPE, SANTIAGO), (LONDON, SINGAPORE, SYDNEY))).groupBy("line_id").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 52, 1: 72, 2: 73, 3: 156}


def test_geodesic_edges(spark):
    got = curves.geodesic(line(spark, [LONDON], [LONDON, LONDON], [(0, 0), (180, 0)])).orderBy("line_id", "leg", "i").collect()
    assert [sum(r["line_id"] == k for r in got) for k in (0, 1, 2)] == [1, 2, 2]
    assert abs(got[0]["lon"] - LONDON[0]) < 1e-9


def test_graticule_counts(spark):
    kinds = {r["kind"]: (r["lines"], r["n"]) for r in curves.graticule(spark).groupBy("kind").agg(F.countDistinct("line").alias("lines"), F.count("*").alias("n")).collect()}
    assert kinds == {"meridian": (12, 12 * 91), "parallel": (5, 5 * 181)}


def test_orbit_reaches_its_inclination(spark):
    o = spark.createDataFrame([(1, 420.0, 51.6, 10.0, 5580.0, None)], "orbit_id int, altitude_km double, inclination double, node double, period double, phase double")
    track = orbits.ground_track(o, 240)
    assert track.count() == 241
    assert abs(track.agg(F.max("lat")).first()[0] - 51.6) < 1e-9


def test_projection_round_trip(spark):
    cam = geo.globe_camera(800, 600, 1.0, 0.3, -0.2)
    p = spark.createDataFrame([(float(a), float(b)) for a in range(-180, 180, 20) for b in range(-80, 90, 20)], "lon double, lat double")
    v = geo.to_unit(F.col("lon"), F.col("lat"))
    p = p.withColumn("s", geo.project(cam, v)).filter(F.col("s.depth") > 0.05).withColumn("g", geo.unproject(cam, F.col("s.x"), F.col("s.y")))
    worst = p.agg(F.max(F.abs(F.col("g.latitude") - F.col("lat")))).first()[0]
    assert worst < 1e-6
    assert value(spark, geo.unproject(cam, F.lit(0.0), F.lit(0.0))) is None


def test_occlusion_crossing_is_visible(spark):
    a, b = (F.lit(0.0), F.lit(1.5), F.lit(-0.5)), (F.lit(0.0), F.lit(0.2), F.lit(-1.2))
    c = value(spark, geo.occlusion_crossing(a, b))
    assert c["x"] ** 2 + c["y"] ** 2 >= 1 and c["y"] < 1.001


def ring(spark, lon, lat, radius, n=60, k=0):
    c = spark.createDataFrame([(k, float(lon), float(lat), float(radius))], "line_id int, lon double, lat double, radius double")
    p = curves.small_circles(c, n).filter(f"i < {n}")
    return p.select(F.col("line_id").alias("ring_id"), F.col("i").alias("idx"), *(c.alias(m) for m, c in zip("xyz", geo.to_unit(F.col("lon"), F.col("lat")))))


def test_clip_rings(spark):
    cam = geo.camera(0, 0, 1, 0.0, 0.0)
    whole = curves.clip_rings(ring(spark, 0, 0, 20), cam).toPandas()
    assert len(whole) == 60 and whole.loop.nunique() == 1
    half = curves.clip_rings(ring(spark, 90, 0, 30), cam).toPandas()
    size = np.hypot(half.sx, half.sy)
    assert half.loop.nunique() == 1 and (size <= 1 + 1e-9).all() and (size > 1 - 1e-9).sum() >= 3
    assert curves.clip_rings(ring(spark, 180, 0, 20), cam).count() == 0


def test_clip_lines_ends_on_limb(spark):
    cam = geo.camera(0, 0, 1, 0.0, 0.0)
    equator = spark.range(0, 361, 10).select(F.lit(0).alias("line_id"), F.col("id").alias("idx"), *(c.alias(m) for m, c in zip("xyz", geo.to_unit(F.col("id").cast("double") - 180.0, F.lit(0.0)))))
    p = curves.clip_lines(equator, cam).toPandas()
    assert p.piece.nunique() == 1 and abs(p.sx.min() + 1) < 1e-9 and abs(p.sx.max() - 1) < 1e-9


def test_ring_rules(spark):
    pts = [(0, 0, i, *p) for i, p in enumerate([(0.0, 0.0), (0.001, 0.001), (1.0, 0.0), (1.0, 1.0)])] + [(1, 0, i, *p) for i, p in enumerate([(0.0, 0.0), (1.0, 1.0), (1.0, 1.0)])]
    clean = curves.clean_rings(spark.createDataFrame(pts, "polygon_id int, ring_id int, idx int, lon double, lat double"))
    assert [tuple(r) for r in clean.select("polygon_id", "idx").orderBy("idx").collect()] == [(0, 0), (0, 1), (0, 2)]
    assert tuple(curves.ring_counts(clean).first()) == (1, 1, 3)
    back = ring(spark, 0, 0, 10).withColumn("idx", 59 - F.col("idx"))
    forward = [c.select("turn").first()[0] > 0 for c in (curves.ring_measures(curves.orient_rings(back)), curves.ring_measures(curves.orient_rings(ring(spark, 0, 0, 10))))]
    assert forward == [True, True]


def track(spark, frames, times, **options):
    f = spark.createDataFrame([(1, float(a), float(v)) for a, v in frames], "series_id int, at double, value double")
    q = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate(times)], "series_id int, query_id int, time double")
    return [(r["a"], r["b"], r["mix"]) for r in tracks.sample(f, q, **options).orderBy("query_id").collect()]


def test_tracks(spark):
    assert track(spark, [], [0]) == [(None, None, None)]
    assert track(spark, [(3, 7)], [0, 3, 9], loop=True) == [(7.0, 7.0, 0.0)] * 3
    phase = track(spark, [(0, 0), (6, 1)], [0, 3, 6, 9, 12], loop=True, duration=12, ease=numbers.smoothstep)
    assert [round(a + (b - a) * m, 9) for a, b, m in phase] == [0, 0.5, 1, 0.5, 0]
    assert track(spark, [(0, 1), (1, 2), (1, 5), (2, 9)], [1, 1.5]) == [(5.0, 9.0, 0.0), (5.0, 9.0, 0.5)]
    assert track(spark, [(0, 1), (2, 3)], [-5, 7]) == [(1.0, 1.0, 0.0), (3.0, 3.0, 0.0)]
    assert track(spark, [(0, 1), (2, 3)], [-1], loop=True) == [(1.0, 3.0, 0.5)]


def test_palette_and_field(spark):
    one = fields.palette(spark.createDataFrame([(0, 0.5, 10.0, 20.0, 30.0, None)], "palette_id int, at double, r double, g double, b double, alpha double"))
    assert one.count() == 256 and tuple(one.filter("n = 200").select("r", "a").first()) == (10, 255)
    assert fields.field(spark, 8, 4, 2.0, 2.0, lambda lon, lat: F.lit(5.0)).agg(F.min("v")).first()[0] == 255


def test_mesh_counts(spark):
    c = mesh.chunks(spark)
    assert c.count() == 128 and [c.k for c in c.orderBy("k").select("k").collect()] == list(range(128))
    assert mesh.chunk_indices(spark).count() == 16_384
    assert mesh.vertices(c.filter("k = 5")).count() == 8_385
    shared = mesh.vertices(c, 8).select("x", "y", "z").distinct().count()
    assert shared == 4 * 4 ** (2 + 3) + 2  # neighbours' edges are the same to the bit


def test_tile_bases(spark):
    ids = spark.createDataFrame([(0,), (7,), (8,), (39,), (40,), (168,), (680,)], "id long").select("id", raster.level_of(F.col("id"), 5).alias("z"))
    assert [r.z for r in ids.orderBy("id").collect()] == [0, 0, 1, 1, 2, 3, 4]


def test_sampling_without_tiles(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.7, 0.1)], "point_id int, u double, v double")
    none = spark.createDataFrame([], "z int, ty long, tx long, r long, c long, h long")
    assert {(r.height, r.answered) for r in raster.sample_heights(p, none, 2).collect()} == {(0.0, -1)}


def test_labels(spark):
    rows = [("s", 1, "a", True, 1.0, None, 0.0, 0.0, 10.0, 10.0), ("s", 2, "b", True, 1.0, None, 10.0, 0.0, 20.0, 10.0), ("s", 3, "c", True, 1.0, None, 5.0, 5.0, 15.0, 15.0), ("s", 4, "d", True, 1.0, False, 5.0, 5.0, 15.0, 15.0), ("s", 5, "e", True, 0.01, None, 50.0, 50.0, 60.0, 60.0)]
    df = spark.createDataFrame(rows, "scene string, priority int, text string, visible boolean, alpha double, declutter boolean, bl double, bt double, br double, bb double")
    assert sorted(r.text for r in scene.declutter(df).collect()) == ["a", "b", "d"]
    assert sorted((r.a, r.b) for r in scene.overlaps(df, cell=4.0).collect()) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_models(spark):
    v, f = scene.cylinder_model(spark, "c", (0, 0, 0), 1.0, 2.0, "x", 5, (1, 2, 3))
    assert (v.count(), f.count()) == (12, 20) and scene.model_faults(v, f).count() == 0


def polygon(spark, centre, radius, polygon=0, ring_=0, n=40):
    c = spark.createDataFrame([(0, *map(float, centre), float(radius))], "line_id int, lon double, lat double, radius double")
    return curves.small_circles(c, n).select(F.lit(0).alias("morph_id"), F.lit(polygon).alias("polygon"), F.lit(ring_).alias("ring"), F.col("i").alias("idx"), "lon", "lat")


def test_morph(spark):
    before = polygon(spark, (0, 0), 10).unionByName(polygon(spark, (0, 0), 3, ring_=1))
    after = polygon(spark, (2, 0), 9).unionByName(polygon(spark, (40, 0), 4, polygon=1))
    m = morphs.morph(before, after, 32)
    assert m.count() == 3
    outline = morphs.at(m, 0.5).filter("pos = 0 and ring = 0").agg(*(F.avg(c) for c in "xyz")).first()
    assert abs(math.degrees(math.atan2(outline[0], outline[2])) - 1) < 0.01
    gone = morphs.at(m, 1.0).filter("pos = 0 and ring = 1").select(*(F.round(c, 9) for c in "xyz")).distinct().count()
    assert gone == 1


def test_morph_holds_opposites(spark):
    v = geo.morphed((F.lit(1.0), F.lit(0.0), F.lit(0.0)), (F.lit(-1.0), F.lit(0.0), F.lit(0.0)), F.lit(0.5))
    assert [value(spark, c) for c in v] == [1.0, 0.0, 0.0]


def test_state_identity(spark):
    log = spark.createDataFrame([(1, i, i, v) for i, v in enumerate([0.0, -0.0, float("nan"), float("nan"), None, None])], "session int, at int, seq int, v double")
    assert [r.seq for r in state.changes(log, ["v"]).orderBy("seq").collect()] == [0, 1, 2, 4]


def test_eviction_and_ladder(spark):
    cache = spark.range(400).select("id", (F.col("id") % 40 / 8).cast("int").alias("z"), (-F.col("id")).alias("used"))
    assert tiles.evicted(cache).count() == 80 and tiles.evicted(cache).filter("z = 0").count() == 0
    assert tiles.evicted(cache.limit(300)).count() == 0


def test_readings(spark):
    assert value(spark, text.compass(F.lit(-51.46), "N", "S")) == "51.5°S"
    assert value(spark, text.spacing(F.lit(4))) == "4.9 km" and value(spark, text.spacing(F.lit(0))) == "78 km"
    assert value(spark, text.whole_latitude(F.lit(0.0))) == "0°N"


def test_codec_overflows(spark):
    grid = np.array([[30_000, -30_000], [32_767, -32_768]])
    assert (terrain.decode_tile(terrain.encode_tile(grid), 2) == grid).all()


def test_options():
    assert terrain.check_levels(5) == 5 and shapes.check_resolution("50m") == "50m"
    with pytest.raises(ValueError):
        terrain.check_levels(7)
    with pytest.raises(ValueError):
        shapes.check_resolution("10m")


def tiff(values, tw, th):
    """A tiled float TIFF with Deflate and the floating-point predictor."""
    h, w = values.shape
    blobs = []
    for ty in range(-(-h // th)):
        for tx in range(-(-w // tw)):
            tile = np.full((th, tw), -99_999, dtype=">f4")
            part = values[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw]
            tile[: part.shape[0], : part.shape[1]] = part
            planes = tile.view(np.uint8).reshape(th, tw, 4).transpose(0, 2, 1).reshape(th, tw * 4).astype(np.int64)
            planes[:, 1:] -= planes[:, :-1].copy()
            blobs.append(zlib.compress((planes % 256).astype(np.uint8).tobytes()))
    n = len(blobs)
    tags = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, 32), (259, 3, 1, 8), (317, 3, 1, 3), (322, 3, 1, tw), (323, 3, 1, th)]
    lists = 8 + 2 + 12 * 10 + 4
    data = lists + 8 * n
    at = [data + sum(map(len, blobs[:k])) for k in range(n)]
    tags += [(324, 4, n, lists if n > 1 else at[0]), (325, 4, n, lists + 4 * n if n > 1 else len(blobs[0])), (339, 3, 1, 3)]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, c) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, c, v in tags) + b"\0" * 4
    return b"II*\0" + struct.pack("<I", 8) + body + struct.pack(f"<{n}I", *at) + struct.pack(f"<{n}I", *map(len, blobs)) + b"".join(blobs)


def test_geotiff(spark, tmp_path):
    want = np.random.default_rng(1).normal(0, 4000, (21, 34)).astype(np.float32)
    want[3, 4] = np.nan
    (tmp_path / "a.tif").write_bytes(tiff(want, 16, 16))
    got = terrain.read_geotiff(spark, str(tmp_path / "a.tif"))
    assert got.rdd.getNumPartitions() == 6
    grid = np.full(want.shape, 0.0, np.float32)
    for r in got.collect():
        grid[r.sy, r.sx] = r.value
    assert np.array_equal(grid, want, equal_nan=True)
    assert raster.valid_samples(got).count() == 21 * 34 - 1


def test_single_grid(spark, tmp_path):
    grid = np.arange(12).reshape(3, 4) * 9000
    residual = grid.astype(np.int64).copy()
    residual[:, 1:] -= grid[:, :-1]
    residual[1:, 0] -= grid[:-1, 0]
    (tmp_path / "e.bin").write_bytes(zlib.compress(b"\0" * 4 + struct.pack("<HH", 4, 3) + residual.astype("<i2").tobytes()))
    got = {(r.sy, r.sx): r.value for r in terrain.read_grid(spark, str(tmp_path / "e.bin")).collect()}
    assert got == {(y, x): float(np.int16(grid[y, x])) for y in range(3) for x in range(4)}


def test_headers():
    head = struct.pack(terrain.HEADER, b"TILELEVL", 2, 128, 1, 3, 1, 512, 544, 32, 8848)
    assert terrain.read_header(head, "TILELEVL")["data_offset"] == 544 and len(head) == 32
    with pytest.raises(ValueError):
        terrain.read_header(head, "OTHERMAG")
    with pytest.raises(ValueError):
        terrain.read_header(head[:8] + b"\3\0" + head[10:])


def test_stream_over_several_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for part, rows in enumerate([[(1, 0, 0, "a"), (1, 1, 1, "a"), (1, 2, 2, "b")], [(1, 3, 3, "b"), (1, 4, 4, "a")]]):
        spark.createDataFrame(rows, "session long, at long, seq long, v string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("session long, at long, seq long, v string").option("maxFilesPerTrigger", 1).parquet(src)
    out = sessions.drain(sessions.stream_changes(stream, "v"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [(r.seq, r.value) for r in out.orderBy("seq").collect()] == [(0, "a"), (2, "b"), (4, "a")]


def test_rebuild_on_arrival(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1,), (2,)], "k long").write.parquet(src)
    stream = spark.readStream.schema("k long").parquet(src)
    sessions.rebuild_on_arrival(stream, lambda b: b.select("k", (F.col("k") * 10).alias("v")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [10, 20]


def test_sampling_by_samples_and_by_arrays(spark):
    """Tiles with all samples, one that lacks some, and points on borders; repeated points and other columns stay."""
    rows = [(z, ty, tx, r, c, (z * 50 + ty * 31 + tx * 17 + r * 7 + c * 3) % 97) for z in (0, 1) for ty in range(2 << z) for tx in range(4 << z) for r in range(6) for c in range(6) if not (z == 1 and tx % 3 == 0)]
    lost = (0, 0, 0, 2, 2)
    stored = spark.createDataFrame([r for r in rows if r[:5] != lost], "z int, ty long, tx long, r long, c long, h long")
    have, tiles = {r[:5]: float(r[5]) for r in rows if r[:5] != lost}, {r[:3] for r in rows}
    asked = [(k, ((k * 37) % 101) / 50 - 0.5, ((k * 53) % 97) / 97, "x") for k in range(200)] + [(0, -0.5, 0.0, "x"), (900, 0.99999, 1.0, None)]
    points = spark.createDataFrame(asked, "point_id long, u double, v double, more string")

    def plain(u, v):
        for z in (1, 0):
            across, down, f = 4 << z, 2 << z, u - math.floor(u)
            tx, ty = min(across - 1, max(0, math.floor(f * across))), min(down - 1, max(0, math.floor(v * down)))
            if (z, ty, tx) in tiles:
                x, y = f * across * 4 - 0.5 - tx * 4 + 1, v * down * 4 - 0.5 - ty * 4 + 1
                c, r = math.floor(x), math.floor(y)
                h = [have.get((z, ty, tx, r + i // 2, c + i % 2)) for i in range(4)]
                if None in h:
                    return 0.0, z
                top, bottom = h[0] + (h[1] - h[0]) * (x - c), h[2] + (h[3] - h[2]) * (x - c)
                return top + (bottom - top) * (y - r), z
        return 0.0, -1

    want = sorted((k, more or "", round(plain(u, v)[0], 9), plain(u, v)[1]) for k, u, v, more in asked)
    for given in (stored, raster.tile_arrays(stored, 4)):
        got = raster.sample_heights(points, given, 1, 4).collect()
        assert sorted((r.point_id, r.more or "", round(r.height, 9), r.answered) for r in got) == want
