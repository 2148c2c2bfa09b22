"""Operator 10: shards that each mirror the mixture of sources.

Method, proportional stratified interleaving: the rows of each source are shuffled by a
seeded digest and ranked; rank r of n rows has the fractional rank (r - u) / n, where the phase u in (0, 1)
is the source's own, by a seeded digest; all rows are sorted by it, which spreads each source evenly, and
many sources of a row or two over the whole sequence instead of its middle. The sorted sequence is cut into
shards whose row counts differ by at most one (law ``rows``).

Defined cases: null or empty source is a source of its own; a null text counts as the empty
text (size 8, CRC 0); rows with null or equal ``doc_id`` are ordered by CRC and size, and
rows equal in all of these are interchangeable; more shards than rows leaves shards empty;
an empty table gives no rows. Extra columns are carried along by ``shard``; one named like
an added column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, with_columns
from .ranking import rank_by_fraction, rank_in_groups, seeded_digest

SHARDS = 24
SEED = 20


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, keep_row: bool = True) -> DataFrame:
    """Adds ``size, text_crc32, shard, slot`` to every row; slots of a shard count from 0.

    With ``keep_row`` the input's columns are carried through the two shuffles, else only
    ``doc_id`` and ``source``. Shard s holds positions ceil(s N / shards) up to ceil((s + 1) N / shards).
    """
    text = text_or_empty()
    row = F.struct(*docs.columns) if keep_row else F.struct("doc_id", "source")
    base = docs.select(
        row.alias("_row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.col("doc_id").alias("_id"),
        (F.octet_length(text).cast("long") + 8).alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
    ).withColumn("_digest", seeded_digest(seed, F.col("_id"), F.col("_crc")))
    ranked = rank_in_groups(base, "_source", "_digest", ["_id", "_crc", "_size"], "_rank", "_of")
    phase = (F.conv(F.substring(seeded_digest(seed, F.col("_source")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    ranked = ranked.withColumn("_fraction", (F.col("_rank") - phase) / F.col("_of"))
    placed = rank_by_fraction(ranked, "_fraction", ["_source", "_digest", "_id", "_crc", "_size"], "_at", "_total")
    placed = placed.withColumn("_shard", F.expr(f"cast((_at * {shards}) div _total as int)"))
    first = F.expr(f"(_shard * _total + {shards - 1}) div {shards}")
    return with_columns("_row", placed, {
        "size": F.col("_size"), "text_crc32": F.col("_crc"), "shard": F.col("_shard"), "slot": (F.col("_at") - first).cast("long"),
    })


def cut(docs: DataFrame, position: str, shards: int = SHARDS) -> DataFrame:
    """Adds ``size, text_crc32, shard, slot`` to rows whose order is given: ``position`` counts them from 0 and goes.

    Shards are consecutive runs of that order with the bounds of ``shard``; no shuffle.
    """
    total, text = docs.count(), text_or_empty()
    base = docs.select(
        F.struct(*(c for c in docs.columns if c != position)).alias("_row"), (F.octet_length(text).cast("long") + 8).alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
        F.col(position).cast("long").alias("_at"), F.expr(f"cast((`{position}` * {shards}) div {max(1, total)} as int)").alias("_shard"),
    )
    return with_columns("_row", base, {
        "size": F.col("_size"), "text_crc32": F.col("_crc"), "shard": F.col("_shard"),
        "slot": (F.col("_at") - F.expr(f"(_shard * {total}L + {shards - 1}) div {shards}")).cast("long"),
    })


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; law ``rows``."""
    out = shard(table(spark, sf_dir, "documents"), keep_row=False)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source",
    )


#: The same law in SQL. The CRC is the usual table-driven one, its table built by rule.
SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), texts AS (
  SELECT DISTINCT coalesce(text, '') AS text FROM documents
), crcs AS (
  SELECT text, xor(4294967295, list_reduce(
      list_transform(range(0, octet_length(encode(text))::BIGINT), lambda i: ('0x' || hex(encode(text))[2 * i + 1 : 2 * i + 2])::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS crc
  FROM texts, tab
), base AS (
  SELECT doc_id, coalesce(source, '') AS source, octet_length(encode(coalesce(d.text, ''))) + 8 AS size, crc AS text_crc32,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '\\N') || '|' || crc::VARCHAR) AS digest
  FROM documents d JOIN crcs c ON c.text = coalesce(d.text, '')
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY digest, doc_id, text_crc32, size) - (('0x' || substr(md5('{SEED}|' || source), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)
            / (count(*) OVER (PARTITION BY source))::DOUBLE AS fraction
  FROM base
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source, digest, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, ((pos * {SHARDS}) // total)::INTEGER AS shard,
       (pos - ((((pos * {SHARDS}) // total) * total + {SHARDS - 1}) // {SHARDS}))::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
FROM placed
"""
