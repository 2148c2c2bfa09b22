"""Readings as text where the last digit hangs on a half."""

from compare import connection
from pyspark.sql import functions as F

from terraspan.functions import text


def test_halves_go_to_the_even_digit(spark):
    """Exact halves, decimals that only look like halves, whole numbers and large ones, against SQL's printf."""
    values = [0.0, 0.125, 0.375, 0.625, 0.15, 0.25, 0.35, 0.45, 0.5, 1.005, 1.5, 2.5, 2.675, 9.995, 12.25, 89.95, 137.5, 293.125, 1465.625, 123456789.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", *(text.fixed(F.col("v"), n) for n in (0, 1, 2))).collect()
    con = connection("/nowhere")
    want = [con.execute("SELECT printf('%.0f', ?::DOUBLE), printf('%.1f', ?::DOUBLE), printf('%.2f', ?::DOUBLE)", [v] * 3).fetchall()[0] for v in values]
    assert [tuple(r)[1:] for r in got] == want


def test_sizes_on_a_half(spark):
    ids = spark.createDataFrame([(131_072,), (655_360,), (1,), (446,), (448,)], "id long")
    assert [r[0] for r in ids.select(text.megabytes(F.col("id") * 2_345)).collect()] == ["293.12 MB", "1465.62 MB", "2 kB", "1021 kB", "1.00 MB"]
