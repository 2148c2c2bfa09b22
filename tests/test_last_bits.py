"""Results whose sixth decimal hangs on the last bits of an angle function, against the values that SQL gives for them."""

import math

import pytest
from pyspark.sql import functions as F

from terraspan.functions import geo
from terraspan.plans import geo_queries, registry

N = 900_000


def few(spark):
    """Four places of 900,000; the longitude of the third, -111.8671875, is a half of a millionth."""
    rows = [(k, math.fmod(k * 137.50776405, 360.0) - 180, math.asin(2 * (k + 0.5) / N - 1) * 180 / math.pi) for k in range(156_248, 156_252)]
    return spark.createDataFrame(rows, "id long, lon double, lat double")


@pytest.mark.parametrize("name", ["geo_places", "geo_small_circles", "sql_small_circles", "geo_geodesic", "geo_geodesic_ring", "sql_geodesic"])
def test_halves_fall_as_in_sql(spark, monkeypatch, name):
    monkeypatch.setattr(geo_queries, "places", lambda *_: few(spark))
    got = registry.QUERIES[name](spark, "")
    if name == "geo_places":
        assert [tuple(r) for r in got.filter("id = 156250").select("lon", "lat").collect()] == [(-111_867_187, -40_751_279)]
    elif "circles" in name:
        want = {(9, -111_867_187, -41_751_279), (27, -111_867_187, -39_751_279)}
        assert {tuple(r) for r in got.filter("line_id = 156250 and i in (9, 27)").select("i", "lon", "lat").collect()} == want
    else:
        assert [tuple(r) for r in got.filter("line_id = 39062 and leg = 1").orderBy(F.desc("i")).limit(1).select("i", "lon", "lat").collect()] == [(90, -111_867_187, -40_751_279)]


def test_near_functions(spark):
    """Those of the C library but for a few in a thousand; nulls stay null."""
    rows = spark.range(4000).select((F.rand(1) * 2 - 1).alias("a"), (F.rand(2) * 2 - 1).alias("b"))
    for name in geo.Trig._fields:
        columns = ["a", "b"][: 2 if name == "atan2" else 1]
        got = rows.select(*columns, getattr(geo.NEAR, name)(*(F.col(c) for c in columns)).alias("r")).collect()
        assert sum(getattr(math, name)(*r[:-1]) != r.r for r in got) < 40
        assert rows.limit(1).select(getattr(geo.NEAR, name)(*(F.lit(None).cast("double") for _ in columns))).collect()[0][0] is None
