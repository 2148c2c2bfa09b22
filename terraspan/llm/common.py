"""Helpers shared by the training-data operators: tables, scratch storage, column packing."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw bytes up to which a side may be broadcast; a hash table of it takes about twice that. Larger sides are shuffled.
BROADCAST_BYTES = 24 << 20
#: Bytes of a row's fixed part and of a column of fixed width, as Spark lays rows out.
ROW_BYTES, COLUMN_BYTES = 16, 8

#: What tells rows of documents apart: the id (null ids last) and the text. One id may have several texts.
KEY = ["_no_id", "_id", "_hash"]
KEY_SCHEMA = "_no_id boolean, _id long, _hash long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent a temporary folder serves, but only for a local master:
    on a cluster such a folder would be different on each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"user-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, compression: str | None = None, **options: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet, with the writer's ``options``, and read back.

    This cuts the lineage: a lost executor costs a re-read of files instead of a
    recomputation, and a plan that is read twice is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.options(**options).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a superseded ``materialize`` result."""
    path = getattr(df, "_scratch_path", None)
    if path:
        fs, p = _hadoop(df.sparkSession, path)
        fs.delete(p, True)


def small_enough(df: DataFrame) -> bool:
    """Whether a materialized table is at most BROADCAST_BYTES: rows times the fixed width, plus the measured length of strings and arrays."""
    fixed = ROW_BYTES + COLUMN_BYTES * len(df.columns)
    more = [F.octet_length(f.name) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    more += [F.length(F.to_json(f.name)) for f in df.schema if f.dataType.simpleString().startswith(("array", "struct", "map"))]
    if not more:
        return df.count() * fixed <= BROADCAST_BYTES  # Parquet footers answer
    got = df.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c.cast("long")), F.lit(0)) for c in more)).first()
    return got[0] * fixed + sum(got[1:]) <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df``, a materialized table, with a broadcast hint if its measured size allows, else as it is (shuffle join)."""
    return F.broadcast(df) if small_enough(df) else df


def key_columns(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """The KEY columns of a table of documents; the order of KEY is that of ids, then of text hashes."""
    given = F.col(doc_id).cast("long")
    values = (given.isNull(), F.coalesce(given, F.lit(0).cast("long")), F.xxhash64(text_or_empty(text)))
    return [v.alias(k) for k, v in zip(KEY, values)]


def id_of_key() -> Column:
    """The ``doc_id`` of KEY columns."""
    return F.when(~F.col(KEY[0]), F.col(KEY[1]))


def with_columns(row: str, df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """The fields of struct column ``row`` followed by ``added``.

    An input column whose name equals an added one (case aside) gives way to it.
    """
    names = {n.lower() for n in added}
    kept = [F.col(row)[f.name].alias(f.name) for f in df.schema[row].dataType.fields if f.name.lower() not in names]
    return df.select(*kept, *(c.alias(n) for n, c in added.items()))


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` so that it is evaluated once a row.

    The optimizer may otherwise copy a costly expression into every filter and lambda that
    uses the column, and a lambda would evaluate it once an element. It doesn't look through a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until the table has no such column (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    """The text as a string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
