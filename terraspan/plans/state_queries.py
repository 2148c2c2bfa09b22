"""Queries that fold ``events`` as a log of user actions and frames, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import micro
from ..operators import state
from ..storage import scratch
from ..streaming import sessions
from .geo_queries import M
from .raster_queries import read


def log(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    action = F.element_at(F.array(*map(F.lit, ("rotate", "zoom", "exaggerate", "outlines", "overlay", "reset", "other"))), F.when(F.col("event_id") % 23 == 0, 6).otherwise(F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), action.alias("action"),
        F.when(F.col("event_id") % 5 == 1, F.col("value") / 250).when(F.col("event_id") % 5 == 2, F.col("value") - 300).otherwise(F.col("value") / 40 - 5).alias("a"), (F.col("value") / 300 - 0.8).alias("b"),
    )


LOG = """log AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS at_, event_id AS seq, CASE WHEN event_id % 23 = 0 THEN 'reset' ELSE (['rotate', 'zoom', 'exaggerate', 'outlines', 'overlay'])[event_id % 5 + 1] END AS action,
  CASE event_id % 5 WHEN 1 THEN value / 250 WHEN 2 THEN value - 300 ELSE value / 40 - 5 END AS a, value / 300 - 0.8::DOUBLE AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


def q_reduce(spark, sf_dir):
    s = state.reduce_states(log(spark, sf_dir))
    return s.select("session", "seq", *(micro(F.col(c)).alias(c) for c in ("lon", "lat", "zoom", "exaggeration")), "outlines", "overlay")


REDUCE = f"""WITH RECURSIVE {LOG}, r AS (
  SELECT DISTINCT session, 0::BIGINT AS n, NULL::BIGINT AS seq, 0.0::DOUBLE AS lon, 0.35::DOUBLE AS lat, 1.0::DOUBLE AS zoom, true AS outlines, false AS overlay, 30.0::DOUBLE AS ex FROM log
  UNION ALL
  SELECT r.session, l.n, l.seq, CASE action WHEN 'rotate' THEN lon + a - trunc((lon + a) / (2 * pi())) * (2 * pi()) WHEN 'reset' THEN 0 ELSE lon END, CASE action WHEN 'rotate' THEN least(pi() / 2, greatest(-pi() / 2, lat + b)) WHEN 'reset' THEN 0.35::DOUBLE ELSE lat END,
    CASE action WHEN 'zoom' THEN least(8.0::DOUBLE, greatest(0.5::DOUBLE, zoom * a)) WHEN 'reset' THEN 1 ELSE zoom END, CASE action WHEN 'outlines' THEN NOT outlines WHEN 'reset' THEN true ELSE outlines END,
    CASE action WHEN 'overlay' THEN NOT overlay WHEN 'reset' THEN false ELSE overlay END, CASE action WHEN 'exaggerate' THEN least(80.0::DOUBLE, greatest(0.0::DOUBLE, a)) WHEN 'reset' THEN 30 ELSE ex END
  FROM r JOIN log l ON l.session = r.session AND l.n = r.n + 1
) SELECT session, seq, {M('lon')} AS lon, {M('lat')} AS lat, {M('zoom')} AS zoom, {M('ex')} AS exaggeration, outlines, overlay FROM r WHERE n > 0"""


def q_changes(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("level", (F.col("seq") % 4).cast("int")).withColumn("half", F.when(F.col("seq") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(0.5)))
    return state.changes(e.select("session", "at", "seq", "level", "half"), ["level", "half"]).select("session", "seq", "level")


CHANGES = f"""WITH {LOG}, v AS (SELECT session, seq, n, (seq % 4)::INTEGER AS level, seq % 3 = 0 AS half FROM log)
SELECT session, seq, level FROM v WINDOW w AS (PARTITION BY session ORDER BY n) QUALIFY n = 1 OR level <> lag(level) OVER w OR half <> lag(half) OVER w"""


def q_published(spark, sf_dir):
    e = log(spark, sf_dir)
    shown = e.select("session", "at", "seq", ((F.col("seq") % 7) * 40).alias("triangles"), ((F.col("seq") % 5) / 40.0).alias("frame_ms"), ((F.col("seq") % 3) / 64.0).alias("lon"), F.lit(0.25).alias("lat"))
    out = state.published(shown)
    return out.select("session", "seq", "triangles", *(micro(F.col(c)).alias(c) for c in ("frame_ms", "lon", "lat")))


PUBLISHED = f"""WITH {LOG}, v AS (SELECT session, seq, n, CAST(floor((seq % 7) * 40 / 100.0::DOUBLE + 0.5) * 100 AS BIGINT) AS t, floor((seq % 5) / 40.0::DOUBLE * 10 + 0.5) / 10 AS f, floor((seq % 3) / 64.0::DOUBLE * 10 + 0.5) / 10 AS lon FROM log)
SELECT session, seq, t AS triangles, {M('f')} AS frame_ms, {M('lon')} AS lon, 300000::BIGINT AS lat FROM v WINDOW w AS (PARTITION BY session ORDER BY n) QUALIFY n = 1 OR t <> lag(t) OVER w OR f <> lag(f) OVER w OR lon <> lag(lon) OVER w"""


def frames(spark, sf_dir) -> DataFrame:
    """Frames of each user: events an hour apart become frames a few milliseconds apart."""
    return log(spark, sf_dir).select("session", F.expr("at div 60000").alias("at"), "seq", ((F.col("seq") * 37 % 64) / 16.0).alias("draw_ms"))


FRAMES = f"{LOG}, fr AS (SELECT session, at_ // 60000 AS at_, seq, (seq * 37 % 64) / 16.0::DOUBLE AS d, row_number() OVER (PARTITION BY session ORDER BY at_ // 60000, seq) AS n FROM log)"


def q_clock(spark, sf_dir):
    c = state.clock(frames(spark, sf_dir))
    return c.select("session", "seq", micro(F.col("delta")).alias("delta"), micro(F.col("elapsed")).alias("elapsed"))


CLOCK = f"""WITH {FRAMES}, d AS (SELECT *, least(0.1::DOUBLE, coalesce(at_ - lag(at_) OVER (PARTITION BY session ORDER BY n), 0) / 1000.0::DOUBLE) AS delta FROM fr)
SELECT session, seq, {M('delta')} AS delta, {M('sum(delta) OVER (PARTITION BY session ORDER BY n)')} AS elapsed FROM d"""


def q_performance(spark, sf_dir):
    p = state.performance(frames(spark, sf_dir))
    return p.select("session", "closed", micro(F.col("fps")).alias("fps"), micro(F.col("draw_ms")).alias("draw_ms"))


PERFORMANCE = f"""WITH RECURSIVE {FRAMES}, r AS (
  SELECT session, n, at_ AS start, 0::BIGINT AS c, 0.0::DOUBLE AS draw, NULL::BIGINT AS closed, NULL::DOUBLE AS fps, NULL::DOUBLE AS ms FROM fr WHERE n = 1
  UNION ALL
  SELECT r.session, f.n, CASE WHEN f.at_ - start >= 250 THEN f.at_ ELSE start END, CASE WHEN f.at_ - start >= 250 THEN 0 ELSE c + 1 END, CASE WHEN f.at_ - start >= 250 THEN 0 ELSE draw + f.d END,
    CASE WHEN f.at_ - start >= 250 THEN f.at_ END, CASE WHEN f.at_ - start >= 250 THEN (c + 1) * 1000.0::DOUBLE / (f.at_ - start) END, CASE WHEN f.at_ - start >= 250 THEN (draw + f.d) / (c + 1) END
  FROM r JOIN fr f ON f.session = r.session AND f.n = r.n + 1
) SELECT session, closed, {M('fps')} AS fps, {M('ms')} AS draw_ms FROM r WHERE closed IS NOT NULL"""


def q_handover(spark, sf_dir):
    """The clock runs in hundredths of the frames' numbers, the mesh is ready from the fourth frame on, and a reset sets the clock back."""
    f = frames(spark, sf_dir).withColumn("elapsed", (F.col("seq") % 97) / 64.0).withColumn("ready", F.col("seq") % 4 == 3)
    return state.handover(f).select("session", "seq", micro(F.col("veil")).alias("veil"))


HANDOVER = f"""WITH {FRAMES}, e AS (SELECT *, (seq % 97) / 64.0::DOUBLE AS el, seq % 4 = 3 AS ready FROM fr), b AS (SELECT *, min(CASE WHEN ready THEN n END) OVER (PARTITION BY session) AS first_n FROM e),
s AS (SELECT b.session, b.seq, b.n, CASE WHEN b.n < b.first_n OR b.first_n IS NULL THEN 0 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (b.el - f.el) / 0.6::DOUBLE)) END AS share FROM b LEFT JOIN e f ON f.session = b.session AND f.n = b.first_n),
g AS (SELECT *, max(CASE WHEN share >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY n) AS gone FROM s)
SELECT session, seq, {M('CASE WHEN gone = 1 THEN 0 ELSE 1 - share END')} AS veil FROM g"""


def q_stream_changes(spark, sf_dir):
    e = sessions.read_events(spark, sf_dir).select(F.col("user_id").alias("session"), "at", F.col("event_id").alias("seq"), "event_type")
    return sessions.drain(sessions.stream_changes(e, "event_type"), scratch(spark), scratch(spark))


def q_stream_performance(spark, sf_dir):
    e = sessions.read_events(spark, sf_dir).select(F.col("user_id").alias("session"), F.expr("at div 60000").alias("at"), F.col("event_id").alias("seq"), ((F.col("event_id") * 37 % 64) / 16.0).alias("draw_ms"))
    out = sessions.drain(sessions.stream_performance(e), scratch(spark), scratch(spark))
    return out.select("session", "closed", micro(F.col("fps")).alias("fps"), micro(F.col("draw_ms")).alias("draw_ms"))


QUERIES = {
    "state_reduce": q_reduce, "state_changes": q_changes, "state_published": q_published, "state_clock": q_clock, "state_performance": q_performance, "state_handover": q_handover,
    "stream_changes": q_stream_changes, "stream_performance": q_stream_performance,
}
SQL = {
    "state_reduce": REDUCE, "state_changes": CHANGES, "state_published": PUBLISHED, "state_clock": CLOCK, "state_performance": PERFORMANCE, "state_handover": HANDOVER, "stream_performance": PERFORMANCE,
    "stream_changes": "SELECT user_id AS session, epoch_us(ts) // 1000 AS at, event_id AS seq, event_type AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lag(event_type) OVER w IS NULL OR event_type <> lag(event_type) OVER w".replace("AS at,", 'AS "at",'),
}
