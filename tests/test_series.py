"""Series in pieces: measures against windows, composed steps against plain folds, one long series over many tasks."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terraspan.operators import series, state

@pytest.fixture(autouse=True)
def small_pieces(spark):
    """Tables this small would be one piece each."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


ACTS = ("rotate", "zoom", "exaggerate", "outlines", "overlay", "reset", "other")


def event(r, k, resets=0.02):
    act = "reset" if r.random() < resets else r.choice(ACTS[:5] + ACTS[6:])
    amount = {"rotate": r.choice([r.uniform(-9, 9), r.uniform(-1, 1), 2 * math.pi, -2 * math.pi, 0.0]), "zoom": r.choice([r.uniform(0.5, 2), -1.5, 0.0]), "exaggerate": r.uniform(-20, 120)}.get(act)
    odd = r.random()
    return [k // 3, k, act, None if odd < 0.02 else math.nan if odd < 0.03 else amount, None if odd > 0.98 else r.uniform(-1, 1)]


def folded(events, s=None):
    s = s or tuple(state.INITIAL.values())
    for e in events:
        s, _ = state._reduced(s, e)
    return s


def near(a, b):
    turn = abs(a[0] - b[0])
    return min(turn, abs(turn - state.TURN)) < 1e-9 and all(abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))


@pytest.mark.parametrize("seed", range(12))
def test_composed_steps_equal_the_fold(seed):
    """From any state, whatever the events and wherever they are cut; also the sign of the longitude, where it isn't a whole turn."""
    r = random.Random(seed)
    for _ in range(60):
        events = [event(r, k, 0.0 if seed % 2 else 0.05) for k in range(r.randrange(1, 40))]
        s = (r.uniform(-6.2, 6.2), r.uniform(-1.5, 1.5), r.uniform(0.5, 8), r.random() < 0.5, r.random() < 0.5, r.uniform(0, 80))
        want, made = folded(events, s), state._NOTHING
        for e in events:
            made = state._absorbed(made, e)
        got = state._applied([float(x) for x in made], s)
        assert near(got, want), (events, s, got, want)
        if abs(math.remainder(want[0], state.TURN)) > 1e-6:
            assert abs(got[0] - want[0]) < 1e-9


def test_one_long_session_is_spread_and_equals_the_fold(spark):
    r = random.Random(1)
    events = [event(r, k, 0.0005) for k in range(20_000)]
    short = [event(r, k, 0.1) for k in range(30)]
    rows = [(1, *e) for e in events] + [(None, *e) for e in short] + [(2, *short[0])]
    log = spark.createDataFrame(rows, "session long, at long, seq long, action string, a double, b double")
    got = {(x.session, x.seq): x for x in state.reduce_states(log).collect()}
    assert len(got) == len(rows)
    for who, those in ((1, events), (None, short), (2, short[:1])):
        s = tuple(state.INITIAL.values())
        for e in those:
            s, row = state._reduced(s, e)
            x = got[who, e[1]]
            assert near((x.lon, x.lat, x.zoom, x.outlines, x.overlay, x.exaggeration), s)
    sizes = [x["count"] for x in series.cut(log, ["session"], ["at", "seq"]).groupBy("_piece").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_measures_against_windows(spark):
    r = random.Random(4)
    rows = [(r.choice([None, 1, 1, 1, 1, 2]), r.randrange(40), k, None if r.random() < 0.5 else r.randrange(100)) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, at long, seq long, v long")
    w = Window.partitionBy("k").orderBy("at", "seq")
    up, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select("*", F.sum("v").over(up).alias("total"), F.first("v", ignorenulls=True).over(up).alias("first"), F.last("v", ignorenulls=True).over(up).alias("last"), F.first("v", ignorenulls=True).over(on).alias("following"), F.lag("v").over(w).alias("previous"))
    got = series.along(df, ["k"], ["at", "seq"], total=series.total("v"), first=series.first("v"), last=series.last("v"), following=series.following("v"), previous=series.previous("v"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert series.along(df.limit(0), ["k"], ["at"], t=series.total("v")).count() == 0
    assert state.reduce_states(spark.createDataFrame([], "session long, at long, seq long, action string, a double, b double")).count() == 0
