"""Shared folders for intermediate files, and files of any store opened through Arrow."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A fresh path under ``spark.checkpoint.dir``, deleted with the driver's JVM; a temporary folder only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"user-{os.getuid()}")
    path = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: computed once, and not again after a lost executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """``(file system, path in it)`` of a local or remote path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def files(path: str) -> list[str]:
    """The data files under a folder, or the file itself, as paths that ``filesystem`` takes."""
    from pyarrow import fs

    where, root = filesystem(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = where.get_file_info(root)
    found = [info] if info.is_file else where.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(prefix + x.path for x in found if x.is_file and x.size and not x.base_name.startswith(("_", ".")))


def read_range(path: str, start: int, end: int | None = None) -> bytes:
    """Bytes ``start`` up to ``end`` of a file, or all from ``start`` on. A store that gives no ranges is read from the file's beginning, as far as needed."""
    from pyarrow import ArrowNotImplementedError

    where, name = filesystem(path)
    try:
        opened = where.open_input_file(name)
    except (ArrowNotImplementedError, NotImplementedError):
        with where.open_input_stream(name) as f:
            return f.read(end)[start:]
    with opened as f:
        f.seek(start)
        return f.read(None if end is None else end - start)
