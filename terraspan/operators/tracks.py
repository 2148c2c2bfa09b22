"""Keyframe tracks: which two keyframes a time lies between, and how far.

Keyframes are ``(series_id, at, value)`` and queries ``(series_id, query_id, time)``. The as-of lookup
is a union, sorted by time and cut into pieces, where each piece is told the keyframes before and after it (``series``);
no join compares times, and one long series is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import eased, wrap
from .series import along, following, last


def sample(frames: DataFrame, queries: DataFrame, loop: bool = False, duration: float | None = None, ease=None) -> DataFrame:
    """Adds ``a, b, mix`` to the queries: the values around the time and the eased share of b.

    Before the first and after the last keyframe that one holds; a looping track wraps its
    time by the duration, at least the covered span, and closes from the last to the first.
    Keyframes of one time keep the order of ``value``; the later one wins. An empty track gives
    nulls; a single keyframe gives its value.
    """
    series = frames.groupBy("series_id").agg(
        F.min("at").alias("_start"), F.max("at").alias("_end"), F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("at", "value"))["value"].alias("_first"), F.max(F.struct("at", "value"))["value"].alias("_last"),
    )
    asked = queries.join(series, "series_id", "left")
    covered = F.col("_end") - F.col("_start")
    length = F.greatest(covered, F.lit(float(duration))) if duration is not None else covered
    looping = F.lit(loop) & (length > 0) & (F.col("_n") > 1)
    asked = asked.withColumn("_t", F.when(looping, F.col("_start") + wrap(F.col("time") - F.col("_start"), length)).otherwise(F.col("time").cast("double")))
    asked = asked.withColumn("_closing", looping & (F.col("_t") >= F.col("_end"))).withColumn("_length", length)

    ask = asked.select("*", F.col("_t").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(frames.schema["value"].dataType).alias("_value"))
    frame = frames.select("series_id", F.col("at").cast("double").alias("_at"), F.lit(0).alias("_kind"), F.col("value").alias("_value"))
    both = ask.unionByName(frame, allowMissingColumns=True)
    both = both.withColumn("_here", F.when(F.col("_kind") == 0, F.struct("_at", "_value")))
    both = both.withColumn("_tie", F.xxhash64(*(F.col(c) for c in queries.columns)))  # many queries of one time are no one's piece
    placed = along(both, ["series_id"], ["_at", "_kind", "_value", "_tie"], _p=last("_here"), _q=following("_here")).filter("_kind = 1")

    inside = (F.col("_t") - F.col("_p._at")) / (F.col("_q._at") - F.col("_p._at"))
    gap = F.col("_start") + F.col("_length") - F.col("_end")
    closing = F.when(gap > 0, (F.col("_t") - F.col("_end")) / gap).otherwise(0.0)
    held_first = (F.col("_n") == 1) | ~F.lit(loop) & (F.col("_t") <= F.col("_start"))
    held_last = ~F.col("_closing") & (F.col("_t") >= F.col("_end"))
    a = F.when(held_first, F.col("_first")).when(F.col("_closing") | held_last, F.col("_last")).otherwise(F.col("_p._value"))
    b = F.when(held_first | F.col("_closing"), F.col("_first")).when(held_last, F.col("_last")).otherwise(F.col("_q._value"))
    u = F.when(F.col("_n").isNull(), F.lit(None)).when(held_first, 0.0).when(F.col("_closing"), closing).when(held_last, 0.0).otherwise(inside)
    held = held_first | (held_last & ~F.col("_closing"))
    out = placed.withColumn("a", a).withColumn("b", b).withColumn("mix", F.when(F.col("_n").isNull(), F.lit(None).cast("double")).when(held, 0.0).otherwise(eased(u, ease)))
    return out.select(*queries.columns, "a", "b", "mix")


def interpolated(sampled: DataFrame) -> DataFrame:
    """Adds ``value``: the mix of numeric a and b."""
    return sampled.withColumn("value", F.col("a") + (F.col("b") - F.col("a")) * F.col("mix"))
