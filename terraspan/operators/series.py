"""Long ordered series spread over tasks: running totals, last and next values, folds whose steps compose.

No task holds a series. Rows are dealt to pieces, ranges of (series, order) that Spark samples to be about
equal, and written with their piece. Each piece of a series is summed up, the summaries (a row a piece
and series) are scanned in order, and every piece then works on its own from what comes before or after it.
So the largest task is a piece, whether there is one series or a million, and a lost executor costs a piece.

Pieces can only be equal as far as ``order`` tells rows apart: give it columns that break ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


@dataclass(frozen=True)
class Measure:
    """What ``along`` adds: the ``total`` of a column up to a row, its ``first`` or ``last`` value up to a row, the ``following`` one from a row on (these skip nulls), or the ``previous`` row's."""

    kind: str
    column: str


def total(column: str) -> Measure:
    return Measure("total", column)


def first(column: str) -> Measure:
    return Measure("first", column)


def last(column: str) -> Measure:
    return Measure("last", column)


def following(column: str) -> Measure:
    return Measure("following", column)


def previous(column: str) -> Measure:
    return Measure("previous", column)


def cut(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_piece``, the range of (keys, order) that a row belongs to; pieces are numbered in that order."""
    return materialize(df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id()))


def along(df: DataFrame, keys: list[str], order: list[str], **measures: Measure) -> DataFrame:
    """Adds each measure along the series of equal ``keys``, in ascending ``order`` (nulls first). Null keys are a series.

    What is cut already, by the same keys and order, is not cut again and keeps its ``_piece``.
    """
    pieces = df if "_piece" in df.columns else cut(df, keys, order)
    at = F.struct(*order)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))
    summed = {
        "total": lambda c: F.sum(c), "first": lambda c: F.min(known(c))["v"], "last": lambda c: F.max(known(c))["v"], "following": lambda c: F.min(known(c))["v"], "previous": lambda c: F.max(F.struct(at.alias("at"), F.col(c).alias("v")))["v"],
    }
    summaries = pieces.groupBy(*keys, "_piece").agg(*(summed[m.kind](m.column).alias(f"_of_{n}") for n, m in measures.items()))
    series = Window.partitionBy(*keys).orderBy("_piece")
    before, after = series.rowsBetween(Window.unboundedPreceding, -1), series.rowsBetween(1, Window.unboundedFollowing)
    carried = {
        "total": lambda c: F.sum(c).over(before), "first": lambda c: F.first(c, ignorenulls=True).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(before), "following": lambda c: F.first(c, ignorenulls=True).over(after), "previous": lambda c: F.lag(c).over(series),
    }
    carries = summaries.select(*(F.col(k).alias(f"_s_{k}") for k in keys), F.col("_piece").alias("_s"), *(carried[m.kind](f"_of_{n}").alias(f"_to_{n}") for n, m in measures.items()))
    same = F.col("_piece") == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    both = pieces.join(carries, same)
    own = Window.partitionBy(*keys, "_piece").orderBy(*order)
    until, since = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    to = lambda n: F.col(f"_to_{n}")
    local = {
        "total": lambda n, c: F.when(F.sum(c).over(until).isNull(), to(n)).otherwise(F.sum(c).over(until) + F.coalesce(to(n), F.lit(0))),
        "first": lambda n, c: F.coalesce(to(n), F.first(c, ignorenulls=True).over(until)), "last": lambda n, c: F.coalesce(F.last(c, ignorenulls=True).over(until), to(n)), "following": lambda n, c: F.coalesce(F.first(c, ignorenulls=True).over(since), to(n)),
        "previous": lambda n, c: F.when(F.row_number().over(own) == 1, to(n)).otherwise(F.lag(c).over(own)),
    }
    return both.select(*(F.col(c) for c in df.columns), *(local[m.kind](n, m.column).alias(n) for n, m in measures.items()))


def scanned(log: DataFrame, key: str, columns: list[str], schema: str, start: tuple, step: Callable, identity: tuple, absorb: Callable, apply: Callable) -> DataFrame:
    """``step(state, values) -> (state, row or None)`` over each series of equal ``key`` in the order of ``columns``, all series side by side and long ones in pieces.

    A state and a summary are tuples of numbers. ``absorb(summary, values)`` adds a step to what a piece does to any state, ``identity``
    at first; ``apply(summary, state)`` is the state after the piece. ``schema`` are the emitted row's columns (bigint, double or boolean).
    """
    spark, kind = log.sparkSession, log.schema[key].dataType.simpleString()
    given = log.select(F.col(key).alias("_key"), *columns)
    typed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    names = ["_key", *columns]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, n, here, made = TaskContext.get().partitionId(), 0, summarise, identity  # no key equals this function
        held = None  # a batch waits for the next one, which tells whether its last row ends a series

        def closed(b: pa.RecordBatch, ends: dict) -> pa.RecordBatch:
            cells = [ends.get(i) for i in range(b.num_rows)]
            return pa.RecordBatch.from_arrays([*b.columns, pa.array([piece] * b.num_rows, pa.int32()), pa.array(range(n - b.num_rows, n), pa.int64()), pa.array(cells, pa.list_(pa.float64()))], names=[*names, "_piece", "_n", "_summary"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            if held is not None:
                yield closed(held[0], held[1] | ({} if rows[0][0] == here else {held[0].num_rows - 1: [float(x) for x in made]}))
            ends = {}
            for i, (who, *values) in enumerate(rows):
                if who != here:
                    if i:
                        ends[i - 1] = [float(x) for x in made]
                    here, made = who, identity
                made = absorb(made, values)
            n += len(rows)
            held = b, ends
        if held is not None:
            yield closed(held[0], held[1] | {held[0].num_rows - 1: [float(x) for x in made]})

    dealt = given.repartitionByRange(*names).sortWithinPartitions(*names)
    written = materialize(dealt.mapInArrow(summarise, f"_key {kind}, {typed}, _piece int, _n long, _summary array<double>"))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = entered, start
        for b in batches:
            states = []
            for who, made in zip(b.column("_key").to_pylist(), b.column("_summary").to_pylist()):
                if who != here:
                    here, state = who, start
                states.append([float(x) for x in state])
                state = apply(made, state)
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_piece"), pa.array(states, pa.list_(pa.float64()))], names=["_of", "_at", "_state"])

    summaries = written.filter("_summary is not null").select("_key", "_piece", "_summary").repartition("_key").sortWithinPartitions("_key", "_piece")
    entries = materialize(summaries.mapInArrow(entered, f"_of {kind}, _at int, _state array<double>"))

    full = f"{key} {kind}, {schema}"
    kinds = [pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in spark.createDataFrame([], full).schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = run, start
        for b in batches:
            out = []
            given_state = b.column("_state")
            for i, (who, piece, *values) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_key", "_piece", *columns)))):
                if (who, piece) != here:
                    here, state = (who, piece), tuple(given_state[i].as_py())
                state, row = step(state, values)
                if row is not None:
                    out.append((who, *row))
            if out:
                cells = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(next(cells), b.column("_key").type), *(pa.array(c, f.type) for c, f in zip(cells, kinds))], names=[key, *(f.name for f in kinds)])

    both = written.drop("_summary").join(entries, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_piece") == F.col("_at")))
    placed = both.select("_key", "_piece", "_n", "_state", *columns).repartition("_key", "_piece").sortWithinPartitions("_key", "_piece", "_n")
    return placed.mapInArrow(run, full)
