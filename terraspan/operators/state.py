"""State folded from event logs: changes, reducers, the clock, frame statistics, the handover.

A log is ``(session, at, seq, ...)``; a session's events are ordered by (at, seq). Running values and the
reducers work on pieces of sessions (``series``), so one long session is spread over tasks too: each
reducer's steps compose to a few numbers. The windows of ``performance`` open where the last one closed, which doesn't
compose; they read a session as a sorted stream and hold one state, so its length costs time but no memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp01, round_up
from .series import _ARROW, along, cut, first, previous, scanned, total

#: Seconds of a frame at most, milliseconds of a performance window, of the handover (seconds), bounds.
TURN, POLE = 2 * math.pi, math.pi / 2
MAX_STEP, WINDOW_MS, HANDOVER_S, ZOOM, MAX_EXAGGERATION = 0.1, 250, 0.6, (0.5, 8.0), 80.0
INITIAL = {"lon": 0.0, "lat": 0.35, "zoom": 1.0, "outlines": True, "overlay": False, "exaggeration": 30.0}

_SERIES = (["session"], ["at", "seq"])


def _identity(df: DataFrame, column: str) -> Column:
    """A value as it is compared: NaN equals NaN, and 0.0 differs from -0.0."""
    c = F.col(column)
    return c.cast("string") if df.schema[column].dataType.typeName() in ("double", "float") else c


def changes(log: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a log of whole states in which some column differs from the row before; a session's first row counts."""
    keyed = log.withColumn("_values", F.struct(*(_identity(log, c).alias(c) for c in columns)))
    before = along(keyed, *_SERIES, _before=previous("_values"))  # null for a session's first row alone
    return before.filter(F.col("_before").isNull() | ~F.col("_values").eqNullSafe(F.col("_before"))).select(*log.columns)


def published(log: DataFrame) -> DataFrame:
    """Readings ``(session, at, seq, triangles, frame_ms, lon, lat)`` rounded for display, only where the display changes."""
    shown = log.select(
        "session", "at", "seq", (round_up(F.col("triangles") / 100) * 100).cast("long").alias("triangles"), (round_up(F.col("frame_ms") * 10) / 10.0).alias("frame_ms"),
        (round_up(F.col("lon") * 10) / 10.0).alias("lon"), (round_up(F.col("lat") * 10) / 10.0).alias("lat"),
    )
    return changes(shown, ["triangles", "frame_ms", "lon", "lat"])


def folded(log: DataFrame, columns: list[str], schema: str, start: Callable, step: Callable) -> DataFrame:
    """``step(state, values)`` over each session's events in the order of ``columns``; it returns the next state and a row to emit or None.

    Sessions are dealt by a shuffle and sorted (on disk where they are long); a task holds one state and one batch.
    """
    given = log.select("session", *columns).repartition("session").sortWithinPartitions("session", *columns)
    full = f"session {log.schema['session'].dataType.simpleString()}, {schema}"
    empty = log.sparkSession.createDataFrame([], full)
    kinds = [pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in empty.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = run, None  # no session equals this function
        for b in batches:
            out = []
            for who, *values in zip(*(c.to_pylist() for c in b.columns)):
                if who != session:
                    session, state = who, start()
                state, row = step(state, values)
                if row is not None:
                    out.append((who, *row))
            if out:
                cells = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(next(cells), b.column(0).type), *(pa.array(c, f.type) for c, f in zip(cells, kinds))], names=["session", *(f.name for f in kinds)])

    return given.mapInArrow(run, full)


def _amount(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


def _between(low: float, x: float, high: float) -> float:
    return min(high, max(low, x))


def _reduced(s: tuple, event: list) -> tuple[tuple, list]:
    """The state ``(lon, lat, zoom, outlines, overlay, exaggeration)`` after an event, and the row to emit."""
    _, seq, act, a, b = event
    lon, lat, zoom, outlines, overlay, exaggeration = s
    if act == "rotate" and _amount(a) and _amount(b):
        lon, lat = math.fmod(lon + a, TURN), _between(-POLE, lat + b, POLE)
    elif act == "zoom" and _amount(a):
        zoom = _between(ZOOM[0], zoom * a, ZOOM[1])
    elif act == "exaggerate" and _amount(a):
        exaggeration = _between(0.0, a, MAX_EXAGGERATION)
    elif act == "outlines":
        outlines = not outlines
    elif act == "overlay":
        overlay = not overlay
    elif act == "reset":
        lon, lat, zoom, outlines, overlay, exaggeration = INITIAL.values()
    new = lon, lat, zoom, bool(outlines), bool(overlay), exaggeration
    return new, [seq, *new]


#: What some events do to any state: whether they leave one known state (then its six values follow), else the sum of turns with the two bounds
#: explained at ``_turned``, latitude and zoom as an amount and the bounds that clamp it, whether each switch flips, and the exaggeration set (NaN: none).
_NOTHING = (0.0, 0.0, -math.inf, math.inf, 0.0, -POLE, POLE, 1.0, *ZOOM, 0.0, 0.0, math.nan)


def _turned(lon: float, turn: float, low: float, high: float) -> float:
    """The longitude after turns of ``turn`` in all, each followed by a remainder that keeps its sign.

    The result is lon + turn - K TURN. K is a whole number that every step clamps to the floor and the ceiling of (lon + turns so far) / TURN.
    As a function of lon it climbs by one at each of the places (v - 1) TURN + t, where t starts from minus infinity for v <= 0 and from
    infinity for v > 0, and every step clamps t to [-turns, TURN - turns]: ``low`` and ``high`` are what these two have come to.
    """
    up = math.floor((lon - high) / TURN) + 1 if math.isfinite(high) else 0
    k = up if up >= 1 else min(0, math.floor((lon - low) / TURN) + 1) if math.isfinite(low) else 0
    return math.fmod(lon + turn - k * TURN, TURN)


def _absorbed(made: tuple, event: list) -> tuple:
    """``made`` followed by one more event."""
    _, _, act, a, b = event
    if made[0]:
        return (1.0, *_reduced(made[1:7], event)[0], *_NOTHING[7:])
    if act == "reset":
        return (1.0, *INITIAL.values(), *_NOTHING[7:])
    _, turn, low, high, move, south, north, factor, far, near, outlines, overlay, exaggeration = made
    if act == "rotate" and _amount(a) and _amount(b):
        turn += a
        low, high = (_between(-turn, t, TURN - turn) for t in (low, high))
        move, south, north = move + b, _between(-POLE, south + b, POLE), _between(-POLE, north + b, POLE)
    elif act == "zoom" and _amount(a):
        factor, (far, near) = factor * a, sorted((_between(ZOOM[0], far * a, ZOOM[1]), _between(ZOOM[0], near * a, ZOOM[1])))
    elif act == "exaggerate" and _amount(a):
        exaggeration = _between(0.0, a, MAX_EXAGGERATION)
    elif act == "outlines":
        outlines = 1.0 - outlines
    elif act == "overlay":
        overlay = 1.0 - overlay
    return 0.0, turn, low, high, move, south, north, factor, far, near, outlines, overlay, exaggeration


def _applied(made: list, s: tuple) -> tuple:
    """The state after events that do ``made``, from the state before them."""
    if made[0]:
        return tuple(made[1:7])
    _, turn, low, high, move, south, north, factor, far, near, outlines, overlay, exaggeration = made
    return (
        _turned(s[0], turn, low, high), _between(south, s[1] + move, north), _between(far, s[2] * factor, near),
        bool(s[3]) != bool(outlines), bool(s[4]) != bool(overlay), s[5] if math.isnan(exaggeration) else exaggeration,
    )


def reduce_states(log: DataFrame) -> DataFrame:
    """``(session, seq, lon, lat, zoom, outlines, overlay, exaggeration)`` after each event ``(session, at, seq, action, a, b)``.

    Actions: ``rotate`` by a and b (longitude keeps its remainder's sign, latitude is clamped to the
    poles), ``zoom`` by factor a, ``exaggerate`` to a, ``outlines`` and ``overlay`` toggle, ``reset``.
    Others, and those whose amount is lacking or not finite, change nothing.
    """
    schema = "seq bigint, lon double, lat double, zoom double, outlines boolean, overlay boolean, exaggeration double"
    typed = log.select("session", "at", F.col("seq").cast("bigint").alias("seq"), "action", *(F.col(c).cast("double").alias(c) for c in "ab"))
    return scanned(typed, "session", ["at", "seq", "action", "a", "b"], schema, tuple(INITIAL.values()), _reduced, _NOTHING, _absorbed, _applied)


def clock(frames: DataFrame) -> DataFrame:
    """Adds ``delta, elapsed`` in seconds to frames ``(session, at, seq)`` with ``at`` in milliseconds; a step is 0.1 s at most."""
    stepped = along(cut(frames, *_SERIES), *_SERIES, _before=previous("at"))
    delta = F.least(F.lit(MAX_STEP), F.coalesce(F.col("at") - F.col("_before"), F.lit(0)) / 1000.0)
    return along(stepped.withColumn("delta", delta), *_SERIES, elapsed=total("delta")).select(*frames.columns, "delta", "elapsed")


def _closed(s: tuple | None, frame: list) -> tuple[tuple, list | None]:
    at, _, draw_ms = frame
    if s is None:  # the first frame opens the window and is no frame of it
        return (at, 0, 0.0), None
    start, n, draw = s[0], s[1] + 1, s[2] + draw_ms
    if at - start < WINDOW_MS:
        return (start, n, draw), None
    return (at, 0, 0.0), [at, n * 1000.0 / (at - start), draw / n]


def performance(frames: DataFrame) -> DataFrame:
    """``(session, closed, fps, draw_ms)`` of frames ``(session, at, seq, draw_ms)``, times in milliseconds.

    A window opens where the last one closed, first at the session's first frame, and closes with
    the first frame that is at least 250 ms later; its length is what it really took.
    """
    typed = frames.select("session", F.col("at").cast("bigint").alias("at"), "seq", F.coalesce(F.col("draw_ms").cast("double"), F.lit(0.0)).alias("draw_ms"))
    return folded(typed, ["at", "seq", "draw_ms"], "closed bigint, fps double, draw_ms double", lambda: None, _closed)


def handover(frames: DataFrame) -> DataFrame:
    """Adds ``veil`` to frames ``(session, at, seq, elapsed, ready)``: 1 until ready, then fading for 0.6 s; once gone it stays gone."""
    ready = frames.withColumn("_ready", F.when(F.col("ready"), F.col("elapsed")))
    begun = along(cut(ready, *_SERIES), *_SERIES, _began=first("_ready"))
    share = F.when(F.col("_began").isNull(), 0.0).otherwise(clamp01((F.col("elapsed") - F.col("_began")) / HANDOVER_S))
    ended = along(begun.withColumn("_share", share).withColumn("_over", (F.col("_share") >= 1).cast("int")), *_SERIES, _gone=total("_over"))
    return ended.withColumn("veil", F.when(F.col("_gone") > 0, 0.0).otherwise(1 - F.col("_share"))).select(*frames.columns, "veil")
