"""Table functions of SQL against the DataFrame operators."""

from pyspark.sql import functions as F

from terraspan.functions import tables
from terraspan.operators import curves, mesh


def close(a, b):
    a, b = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert len(a) == len(b) and all(len(x) == len(y) and all(abs(p - q) < 1e-9 for p, q in zip(x, y)) for x, y in zip(a, b))


def test_circles_and_legs(spark):
    tables.register(spark)
    centres = spark.createDataFrame([(1, 10.0, 20.0, 5.0), (2, -170.0, 89.0, 30.0), (3, 0.0, -90.0, 90.0)], "line_id long, lon double, lat double, radius double")
    close(spark.sql("SELECT line_id, inline(p) FROM (SELECT line_id, small_circle(lon, lat, radius, 12) AS p FROM {c})", c=centres), curves.small_circles(centres, 12))
    ways = spark.createDataFrame([(1, 0, 0.0, 50.0), (1, 1, -74.0, 40.0), (2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0), (3, 0, 0.0, 0.0), (3, 1, 0.3, 0.0)], "line_id long, idx int, lon double, lat double")
    legs = ways.groupBy("line_id").agg(*(F.min(F.when(F.col("idx") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("lon", "lat")))
    close(spark.sql("SELECT line_id, 0L AS leg, inline(p) FROM (SELECT line_id, great_circle(lon0, lat0, lon1, lat1, 2.5D) AS p FROM {l})", l=legs), curves.geodesic(ways, 2.5))


def test_grid_nulls_and_plans(spark):
    tables.register(spark)
    chunks = mesh.chunks(spark).limit(3)
    corners = ", ".join(f"{n}.{c}" for n in "abc" for c in "xyz")
    close(spark.sql(f"SELECT k, inline(p) FROM (SELECT k, triangle_grid({corners}, 4) AS p FROM {{c}})", c=chunks), mesh.vertices(chunks, 4).select("k", "i", "j", "x", "y", "z"))
    none = spark.createDataFrame([(1, None, 2.0)], "k int, lon double, lat double")
    assert spark.sql("SELECT inline(p) FROM (SELECT small_circle(lon, lat, 3.0D, 4) AS p FROM {n})", n=none).count() == 0
    assert spark.sql("SELECT inline(p) FROM (SELECT great_circle(lon, lat, 1.0D, 2.0D, 1.0D) AS p FROM {n})", n=none).count() == 0
    plan = spark.sql("SELECT k, inline(p) FROM (SELECT k, small_circle(lon, lat, 3.0D, 4) AS p FROM {n})", n=none)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Exchange" not in plan
