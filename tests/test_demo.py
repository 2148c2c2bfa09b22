"""The worked scene: counts that follow from the formulas."""

from pyspark.sql import functions as F

from terraspan.operators import morphs
from terraspan.plans import demo_scene as demo


def test_routes(spark):
    n = {(r["kind"], r["line_id"]): r["n"] for r in demo.routes(spark).groupBy("kind", "line_id").agg(F.count("*").alias("n")).collect()}
    assert [n["route", k] for k in range(4)] == [52, 72, 73, 156]
    assert [n["range", k] for k in range(3)] == [181] * 3
    assert n["area", 0] in range(174, 182)  # two legs of 30 degrees turn on rounding


def test_borders(spark):
    north = morphs.morph(demo.boxes(spark, demo.NORTH[0]), demo.boxes(spark, demo.NORTH[1]))
    assert sorted((r["pos"], r["ring"]) for r in north.select("pos", "ring").collect()) == [(0, 0), (0, 1), (1, 0)]
    assert north.select(F.size("start").alias("n"), F.size("finish").alias("m")).distinct().collect() == [(256, 256)]
    assert [demo.phase_at(t) for t in (0, 3, 6, 9, 12)] == [0, 0.5, 1, 0.5, 0]


def test_forecast_is_a_loop(spark):
    assert tuple(demo.forecast_at(spark, 4.5).first()) == (2, 3, 0.25)
    assert tuple(demo.forecast_at(spark, 15.0).first()) == (7, 0, 0.5)
    assert tuple(demo.forecast_at(spark, 16.0).first()) == (0, 1, 0.0)
