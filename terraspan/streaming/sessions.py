"""Structured Streaming forms of the state operators, and incremental rebuilding.

State is kept per session by the engine (``applyInPandasWithState``), so a stream may be cut
into micro-batches anywhere; within a batch a session's rows are put in order of (at, seq).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import WINDOW_MS


def stream_changes(log: DataFrame, column: str) -> DataFrame:
    """``(session, at, seq, value)`` where the value of ``column`` (a string) differs from the session's last one."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["at", "seq"])
        seen, last = state.get if state.exists else (False, None)
        kept = []
        for at, seq, value in rows[["at", "seq", column]].itertuples(index=False):
            if not seen or value != last:
                kept.append((key[0], at, seq, value))
            seen, last = True, value
        state.update((seen, last))
        yield pd.DataFrame(kept, columns=["session", "at", "seq", "value"])

    return log.groupBy("session").applyInPandasWithState(run, "session long, at long, seq long, value string", "seen boolean, last string", "append", GroupStateTimeout.NoTimeout)


def stream_performance(frames: DataFrame) -> DataFrame:
    """``(session, closed, fps, draw_ms)``: windows that open where the last one closed, as ``state.performance``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["at", "seq"])
        start, n, draw = state.get if state.exists else (None, 0, 0.0)
        out = []
        for at, cost in rows[["at", "draw_ms"]].itertuples(index=False):
            if start is None:
                start = int(at)
                continue
            n, draw = n + 1, draw + cost
            if at - start >= WINDOW_MS:
                out.append((key[0], int(at), n * 1000.0 / (at - start), draw / n))
                start, n, draw = int(at), 0, 0.0
        state.update((start, n, draw))
        yield pd.DataFrame(out, columns=["session", "closed", "fps", "draw_ms"])

    return frames.groupBy("session").applyInPandasWithState(run, "session long, closed long, fps double, draw_ms double", "start long, n long, draw double", "append", GroupStateTimeout.NoTimeout)


def rebuild_on_arrival(arrivals: DataFrame, rebuild: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that re-materialises what late tiles change: each batch's result overwrites its own partitions ``k``."""

    def write(batch: DataFrame, _: int) -> None:
        rebuild(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("k").parquet(path)

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an append stream over what there is into Parquet files, exactly once, and reads them."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def read_events(spark: SparkSession, sf_dir: str, per_batch: int | None = None) -> DataFrame:
    """``events`` as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader
    return reader.parquet(f"{sf_dir}/events.parque[t]").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
