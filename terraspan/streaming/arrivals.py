"""Surfaces that get finer as tiles arrive: what is sampled is sampled anew where, and only where, new tiles lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster


def root_tile(u, v):
    """The tile of level 0 that holds a position, as one number of 8."""
    tx, ty = raster.tile_of(F.lit(0), u, v)
    return (ty * 4 + tx).cast("int")


def start_surface(arrivals: DataFrame, points: DataFrame, path: str, checkpoint: str, level: int, tile: int = raster.TILE):
    """Starts a query over a stream of tiles ``(z, ty, tx, samples)`` that keeps the heights of ``points`` up to date; ``surface`` reads them.

    A batch's tiles are added to the resident ones under ``path``; points under a tile of level 0 into which some of them
    fall are sampled anew from all that are resident. Both writes are by batch or place, so a batch that is tried again changes nothing.
    """
    rooted = points.withColumn("k", root_tile(F.col("u"), F.col("v")))

    def write(batch: DataFrame, number: int) -> None:
        batch.select("z", "ty", "tx", "samples").write.mode("overwrite").parquet(f"{path}/resident/batch={number}")
        spark = batch.sparkSession
        resident = spark.read.parquet(f"{path}/resident")
        new = spark.read.parquet(f"{path}/resident/batch={number}")
        touched = [r["k"] for r in new.select(F.expr("cast(shiftright(ty, z) * 4 + shiftright(tx, z) as int)").alias("k")).distinct().collect()]  # 8 at most
        if touched:
            built = raster.sample_heights(rooted.filter(F.col("k").isin(touched)), resident, level, tile)
            built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("k").parquet(f"{path}/surface")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def surface(points: DataFrame, path: str) -> DataFrame:
    """``points`` with ``height, answered`` as far as tiles have arrived; height 0 and level -1 where none has."""
    built = points.sparkSession.read.schema(points.select("*", F.lit(0.0).alias("height"), F.lit(0).alias("answered"), F.lit(0).alias("k")).schema).parquet(f"{path}/surface").select("point_id", "height", "answered")
    joined = points.join(built, "point_id", "left")
    return joined.select(*points.columns, F.coalesce("height", F.lit(0.0)).alias("height"), F.coalesce("answered", F.lit(-1)).alias("answered"))
