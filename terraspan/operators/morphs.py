"""Morphing polygons: centroids, resampling by arc length, alignment, matching, and the blend.

Rings are ``(ring_id, idx, x, y, z)`` of unit vectors, open (the last point isn't the first).
Resampled rings travel as arrays: a ring is small and its points are used together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import curves


def open_rings(points: DataFrame) -> DataFrame:
    """Closed rings ``(ring_id, idx, lon, lat)`` without their repeated last point, those of 3 points at least, as oriented unit vectors."""
    w = Window.partitionBy("ring_id")
    ends = points.select("*", F.min_by(F.struct("lon", "lat"), "idx").over(w).alias("_f"), F.max("idx").over(w).alias("_last"), F.count(F.lit(1)).over(w).alias("_n"))
    closing = (F.col("idx") == F.col("_last")) & (F.col("_n") > 1) & (F.struct("lon", "lat") == F.col("_f"))
    kept = ends.filter(~closing).select("ring_id", "idx", *(c.alias(n) for n, c in zip("xyz", geo.to_unit(F.col("lon"), F.col("lat")))), F.count(F.lit(1)).over(w).alias("_k")).filter("_k >= 3").drop("_k")
    return curves.orient_rings(kept)


def resample(rings: DataFrame, count: int = 256) -> DataFrame:
    """``(ring_id, s, x, y, z)``: ``count`` points at even arc length from the first point on; a ring without length repeats it."""
    w = Window.partitionBy("ring_id").orderBy("idx")
    after = [F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("n" + c) for c in "xyz"]
    pairs = rings.select("ring_id", "idx", *"xyz", *after)
    here, nxt = tuple(F.col(c) for c in "xyz"), tuple(F.col("n" + c) for c in "xyz")
    pairs = pairs.withColumn("_len", geo.angle(here, nxt))
    whole = Window.partitionBy("ring_id")
    pairs = pairs.withColumn("_to", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.max("_to").over(whole)).withColumn("_at_last", F.lead("idx").over(w).isNull()).withColumn("_at_first", F.lag("idx").over(w).isNull())
    pairs = pairs.withColumn("_from", F.coalesce(F.lag("_to").over(w), F.lit(0.0)))
    flat = F.col("_total") <= 0
    # candidates a step wider than needed on both sides, so that the exact comparison below decides
    share = lambda c: F.floor(F.col(c) / F.col("_total") * count)
    low, high = F.greatest(F.lit(0), share("_from") - 1), F.when(F.col("_at_last"), count - 1).otherwise(F.least(F.lit(count - 1), share("_to") + 1))
    each = pairs.filter(~flat | F.col("_at_first")).withColumn("s", F.explode(F.when(flat, F.sequence(F.lit(0), F.lit(count - 1))).otherwise(F.sequence(low.cast("int"), high.cast("int")))))
    target = F.col("s") / F.lit(float(count)) * F.col("_total")
    mine = flat | (target >= F.col("_from")) & (F.col("_at_last") | (target < F.col("_to")))
    t = F.when(F.col("_len") > 0, (target - F.col("_from")) / F.col("_len")).otherwise(0.0)
    # step by step, so that no expression is written out many times over
    cut = each.filter(mine).withColumn("_t", t).withColumn("_flat", flat).withColumn("_sine", F.sin("_len"))
    curved = F.col("_sine") > geo.TINY
    cut = cut.withColumn("_wa", F.when(curved, F.sin((1 - F.col("_t")) * F.col("_len")) / F.col("_sine")).otherwise(1 - F.col("_t"))).withColumn("_wb", F.when(curved, F.sin(F.col("_t") * F.col("_len")) / F.col("_sine")).otherwise(F.col("_t")))
    cut = cut.withColumns({"_" + c: F.col(c) * F.col("_wa") + F.col("n" + c) * F.col("_wb") for c in "xyz"})
    cut = cut.withColumn("_size", geo.length(tuple(F.col("_" + c) for c in "xyz")))
    size = F.when(F.col("_size") == 0, F.lit(1.0)).otherwise(F.col("_size"))
    return cut.select("ring_id", "s", *(F.when(F.col("_flat"), F.col(c)).otherwise(F.col("_" + c) / size).alias(c) for c in "xyz"))


def as_arrays(points: DataFrame, order: str = "s") -> DataFrame:
    """``(ring_id, points)``: a ring's points in order, as an array of structs."""
    listed = F.array_sort(F.collect_list(F.struct(order, *"xyz")))
    return points.groupBy("ring_id").agg(F.transform(listed, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("points"))


def best_rotation(a: Column, b: Column) -> Column:
    """The k for which the sum of a_i . b_(i + k) is largest, the first such."""
    n = F.size(a)
    twice = F.concat(b, b)

    def total(k: Column) -> Column:
        zipped = F.arrays_zip(a.alias("a"), F.slice(twice, k + 1, n).alias("b"))
        return F.aggregate(zipped, F.lit(0.0), lambda s, p: s + p["a"]["x"].cast("double") * p["b"]["x"] + p["a"]["y"].cast("double") * p["b"]["y"] + p["a"]["z"].cast("double") * p["b"]["z"])

    scored = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(total(k).alias("sum"), (-k).alias("k")))
    return -F.array_max(scored)["k"]


def rotated(ring: Column, k: Column) -> Column:
    return F.concat(F.slice(ring, k + 1, F.size(ring)), F.slice(ring, F.lit(1), k))


def match(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(morph_id, i, j)``: greedy pairs of polygons ``(morph_id, idx, x, y, z, extent)`` by centroid.

    The largest ``before`` chooses first and takes the nearest free ``after``, ties by index; what is
    left has a null partner. The choice is sequential, so a morph's polygons meet in one fold.
    """
    left = before.groupBy("morph_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("extent")).alias("e"), "idx", *"xyz"))).alias("a"))
    right = after.groupBy("morph_id").agg(F.array_sort(F.collect_list(F.struct("idx", *"xyz"))).alias("b"))
    both = left.join(right, "morph_id", "full").select("morph_id", F.coalesce("a", F.array().cast(left.schema["a"].dataType)).alias("a"), F.coalesce("b", F.array().cast(right.schema["b"].dataType)).alias("b"))
    kind = "struct<pairs:array<struct<i:bigint,j:bigint>>,free:" + right.schema["b"].dataType.simpleString() + ">"

    def choose(s: Column, p: Column) -> Column:
        ranked = F.transform(s["free"], lambda q: F.struct((1 - (p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"])).alias("d"), q["idx"].cast("bigint").alias("j")))
        j = F.array_min(ranked)["j"]
        return F.struct(F.concat(s["pairs"], F.array(F.struct(p["idx"].cast("bigint").alias("i"), j.alias("j")))).alias("pairs"), F.filter(s["free"], lambda q: ~q["idx"].cast("bigint").eqNullSafe(j)).alias("free")).cast(kind)

    start = F.struct(F.array().cast("array<struct<i:bigint,j:bigint>>").alias("pairs"), F.col("b").alias("free")).cast(kind)
    done = both.select("morph_id", F.aggregate("a", start, choose).alias("s"))
    rest = F.transform(F.col("s.free"), lambda q: F.struct(F.lit(None).cast("bigint").alias("i"), q["idx"].cast("bigint").alias("j")))
    pairs = done.select("morph_id", F.posexplode(F.concat(F.col("s.pairs"), rest)).alias("pos", "p"))
    return pairs.select("morph_id", "pos", "p.i", "p.j")


def morph(before: DataFrame, after: DataFrame, count: int = 256) -> DataFrame:
    """``(morph_id, pos, ring, start, finish)`` from polygons ``(morph_id, polygon, ring, idx, lon, lat)``.

    ``start`` and ``finish`` are arrays of ``count`` unit vectors with corresponding places. Rings
    pair by position; one without a partner shrinks to, or grows from, its centroid.
    """
    def prepared(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        key = F.struct("morph_id", "polygon", "ring")
        rings = open_rings(df.select(key.alias("ring_id"), "idx", "lon", "lat"))
        made = as_arrays(resample(rings, count)).join(curves.ring_measures(rings).select("ring_id", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")).alias("centre"), "perimeter"), "ring_id")
        # a ring that is dropped for having too few points doesn't hold a place
        w = Window.partitionBy("ring_id.morph_id", "ring_id.polygon").orderBy("ring_id.ring")
        made = made.select(F.col("ring_id.morph_id").alias("morph_id"), F.col("ring_id.polygon").alias("polygon"), F.row_number().over(w).alias("ring"), "points", "centre", "perimeter")
        outline = made.filter("ring = 1").select("morph_id", F.col("polygon").alias("idx"), "centre.*", F.col("perimeter").alias("extent"))
        return made, outline

    (a, a1), (b, b1) = prepared(before), prepared(after)
    pairs = match(a1, b1)
    left = pairs.join(a.withColumnRenamed("polygon", "i"), ["morph_id", "i"]).select("morph_id", "pos", "ring", F.col("points").alias("pa"), F.col("centre").alias("ca"))
    right = pairs.join(b.withColumnRenamed("polygon", "j"), ["morph_id", "j"]).select("morph_id", "pos", "ring", F.col("points").alias("pb"), F.col("centre").alias("cb"))
    both = left.join(right, ["morph_id", "pos", "ring"], "full")
    start = F.coalesce("pa", F.array_repeat("cb", count))
    finish = F.when(F.col("pb").isNull(), F.array_repeat("ca", count)).when(F.col("pa").isNull(), F.col("pb")).otherwise(rotated(F.col("pb"), best_rotation(F.col("pa"), F.col("pb"))))
    return both.select("morph_id", "pos", (F.col("ring") - 1).alias("ring"), start.alias("start"), finish.alias("finish"))


def at(morphs: DataFrame, t: float) -> DataFrame:
    """``(morph_id, pos, ring, s, x, y, z)``: the outline at share t."""
    each = morphs.select("morph_id", "pos", "ring", F.posexplode(F.arrays_zip("start", "finish")).alias("s", "p"))
    v = geo.morphed(tuple(F.col(f"p.start.{c}") for c in "xyz"), tuple(F.col(f"p.finish.{c}") for c in "xyz"), F.lit(float(t)))
    return each.select("morph_id", "pos", "ring", "s", *(c.alias(n) for n, c in zip("xyz", v)))
