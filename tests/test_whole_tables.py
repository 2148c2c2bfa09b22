"""Queries without an oracle in SQL take their whole tables."""

import os

import pytest
from pyspark.sql import functions as F

from compare import DATA
from terraspan.plans import registry
from terraspan.plans.geo_queries import CAM, places, unit

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_visible_place_is_painted(spark):
    def seen(p):
        z1 = p.x * CAM.sin_lon + p.z * CAM.cos_lon
        x, y, z = p.x * CAM.cos_lon - p.z * CAM.sin_lon, p.y * CAM.cos_lat - z1 * CAM.sin_lat, p.y * CAM.sin_lat + z1 * CAM.cos_lat
        return not (z < 0 and x * x + y * y < 1)

    want = {p.id: 12 if p.id % 2 == 0 else 32 for p in unit(places(spark, DATA)).collect() if seen(p)}
    got = {r.placement: r["count"] for r in registry.QUERIES["model_paint"](spark, DATA).groupBy("placement").count().collect()}
    assert len(want) > 40 and got == want


def test_every_chunk_that_wants_it_is_rebuilt(spark):
    got = registry.QUERIES["mesh_rebuild"](spark, DATA).select("k", F.col("n").cast("int").alias("n")).collect()
    assert {(r.k, r.n) for r in got} == {(k, 129 * 130 // 2) for k in range(128) if k % 3 == 0 or k % 4 < 3 and k % 5 > 0}
