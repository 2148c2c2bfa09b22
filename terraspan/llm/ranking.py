"""Exact ranks over any number of rows without a task that holds a whole group.

A row's place is found in two steps. A uniform key (bits of a digest, or a fraction that is
uniform by construction) deals a group into ``BINS`` bins; the bins' counts, at most BINS
numbers a group, give each bin its offset; a window inside one bin gives the rest. So a
source with a third of all rows is spread over BINS windows, and nothing is sampled: the
result doesn't depend on the partitioning, and a recomputed task gives the same ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins a group: three hexadecimal digits of a digest.
BINS = 4096


def seeded_digest(seed: int, *columns: Column) -> Column:
    """A digest of the seed and the columns as 32 hexadecimal digits; it orders a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns)))


def rank_in_groups(df: DataFrame, group: str, digest: str, ties: list[str], rank: str, size: str) -> DataFrame:
    """Adds the 1-based ``rank`` by (``digest``, ``ties``) in each ``group`` and the group's ``size``.

    ``digest`` holds hexadecimal digits that are uniform over the rows; ``group`` isn't null. The join and the
    window have the same keys, so rows are shuffled once.
    """
    binned = df.withColumn("_bin", F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"))
    counts = binned.groupBy(group, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        group, "_bin",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(size),
    )
    inner = Window.partitionBy(group, "_bin").orderBy(digest, *ties)
    joined = binned.join(offsets, [group, "_bin"])
    return joined.withColumn(rank, F.col("_before") + F.row_number().over(inner)).drop("_bin", "_before")


def rank_by_fraction(df: DataFrame, fraction: str, ties: list[str], position: str, total: str) -> DataFrame:
    """Adds the 0-based ``position`` by (``fraction``, ``ties``) over all rows and their ``total``.

    ``fraction`` lies in [0, 1] and is near uniform, as ranks less a random phase divided by a group's size are, however small the groups.
    The only window over everything sees one row a bin, BINS rows at most.
    """
    binned = df.withColumn("_bin", F.floor(F.col(fraction) * BINS).cast("int"))
    counts = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_bin").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias(total),
    )
    inner = Window.partitionBy("_bin").orderBy(fraction, *ties)
    joined = binned.join(F.broadcast(offsets), F.col("_bin") == F.col("_b"))  # BINS rows at most
    return joined.withColumn(position, F.col("_before") + F.row_number().over(inner) - 1).drop("_bin", "_b", "_before")
