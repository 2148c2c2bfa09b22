"""Planning tile reads: what is missing, byte runs, priorities, eviction, the level ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import along, cut, previous, total

#: Reads in flight, cached tiles, cached fields, levels that stay resident.
MAX_IN_FLIGHT, CACHE_TILES, CACHE_FIELDS, RESIDENT_LEVELS = 8, 320, 32, 2


def missing(wanted: DataFrame, resident: DataFrame, pending: DataFrame) -> DataFrame:
    """The wanted tiles (by ``id``, each once) that are neither resident nor on their way."""
    return wanted.dropDuplicates(["id"]).join(resident.select("id"), "id", "left_anti").join(pending.select("id"), "id", "left_anti")


def asked_once(asks: DataFrame) -> DataFrame:
    """A tile asked for several times in a frame counts once."""
    return asks.dropDuplicates(["frame", "id"])


def coalesce_runs(tiles: DataFrame) -> DataFrame:
    """Byte runs ``(z, from, to, n, ids, error)`` of tiles ``(z, id, offset, length, error)``: touching payloads join.

    Gaps and islands inside each level's file, which is cut into pieces.
    """
    file = (["z"], ["offset", "id"])
    tiles = along(cut(tiles.withColumn("_to", F.col("offset") + F.col("length")), *file), *file, _before=previous("_to"))
    runs = along(tiles.withColumn("_begins", F.when(F.col("offset") == F.col("_before"), 0).otherwise(1)), *file, _run=total("_begins"))
    grouped = runs.groupBy("z", "_run").agg(
        F.min("offset").alias("from"), F.max("_to").alias("to"), F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("offset", "id"))), lambda s: s["id"]).alias("ids"), F.max("error").alias("error"),
    )
    return grouped.drop("_run")


def next_runs(runs: DataFrame, in_flight: int = 0) -> DataFrame:
    """The runs to read now: coarse levels first, then the largest error, as many as may be in flight."""
    return runs.orderBy("z", F.desc("error"), "from").limit(max(0, MAX_IN_FLIGHT - in_flight))


def evicted(cache: DataFrame, limit: int = CACHE_TILES, pinned: str = "z = 0") -> DataFrame:
    """The rows ``(id, z, used)`` to drop: least recently used first, pinned ones never, until ``limit`` are left.

    The cache is bounded by its own limit, so ranking it in one window is.
    """
    total = cache.agg(F.count(F.lit(1)).alias("_total"))
    rank = F.row_number().over(Window.orderBy("used", "id"))
    free = cache.filter(f"not ({pinned})").withColumn("_rank", rank)
    return free.join(F.broadcast(total)).filter(F.col("_rank") <= F.col("_total") - limit).drop("_rank", "_total")


def ladder(levels: DataFrame, through: int) -> DataFrame:
    """Adds ``action`` to ``(z, status)``: ``want`` its tiles, ``open`` it, or neither.

    Levels are earned one by one, and a missing level gives its turn to the next.
    """
    below = Window.orderBy("z").rowsBetween(Window.unboundedPreceding, -1)  # a row a level
    skipped = F.coalesce(F.sum(F.when((F.col("status") == "missing") & F.col("z").between(1, RESIDENT_LEVELS), 1).otherwise(0)).over(below), F.lit(0))
    earned = F.col("z").between(1, RESIDENT_LEVELS) & (F.col("z") <= through + skipped)
    action = F.when(~earned | (F.col("status") == "missing"), "none").when(F.col("status") == "ready", "want").when(F.col("status") == "absent", "open").otherwise("none")
    return levels.withColumn("action", action)


def transfer_totals(fetches: DataFrame) -> DataFrame:
    """Bytes fetched and tiles resident, from ``(bytes, tiles)`` a fetch."""
    return fetches.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("tiles"), F.lit(0)).alias("resident"))
