"""Operator 12: how far the sources of a language diverge from one another, and in which terms.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps the V terms
in at least LEAST_DOCS of its documents. A group is a (lang, source); a term with count occurrences among
the group's N kept ones has the smoothed share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two shares
differ by f = floor((p - q)^2 / (p + q)). All arithmetic is in whole numbers (shares in decimals, the rest in 64 bits).

Method, a systolic rotation. Each language's vocabulary is cut into slices of about SLICE (group, term) entries
by the terms' hash, and its groups into blocks of about BLOCK by their names' hash. A block's vectors of a slice lie
in one partition and stay there; the others' vectors come to it, packed (term gaps and shares in 32 bits, compressed),
in the order of a round-robin tournament by the circle method: in round r blocks x and y meet where
x + y = r modulo the rounds, one of the two at the other's home, so each pair of blocks meets once.
A task reads its block, holds it as rows of shares over the slice, and then takes one arriving vector at a time, so its memory is
BLOCK + 1 vectors of a slice whatever the number of groups. A meeting gives both directions. Rounds go in waves of
WAVE, each written, so that the vectors on the way are at most WAVE times the table.
Terms are ranked where a group's vector of a slice is packed, by a heap of TOP; the heaps of its slices are merged by a window.

Hot groups and terms: counts are summed in the task that reads the texts, then by (lang, term); a group's
vector is as many rows as there are slices, however many documents it has.

Defined cases: null text, lang and source are ''; texts without terms and languages that keep no term give groups all the same
(pairs of value 0, no term rows); repeated rows count as often as they occur; an only source has no pairs; an empty
table gives no rows; extra columns, and doc_id, are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, release, table
from .terms import LETTER_TERMS, pieces

#: The documents of a language that a kept term is in at least, and the terms ranked for each group.
LEAST_DOCS, TOP = 10, 10
#: (group, term) entries of a slice, groups of a block, rounds written at once.
SLICE, BLOCK, WAVE = 1 << 18, 8, 16
#: (group, term) entries that a reading task holds before it passes them on.
HELD = 1 << 18
#: Partitions over which the homes of one language's blocks are dealt; slices share them.
LANES = 256

BILLION = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, d)``: occurrences and documents of each term, summed as far as one task reads; a term may come in several rows."""
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def packed(counts: dict, within: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), n in counts.items():
            d, terms = within[lang, source], list(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(n.values(), pa.int64()), pa.array([d[t] for t in terms], pa.int64()),
            ], names=["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        within: dict[tuple, Counter] = {}
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                n, d, seen = counts.setdefault((lang, source), Counter()), within.setdefault((lang, source), Counter()), set()
                for terms in pieces(text.as_py().translate(LETTER_TERMS)):
                    n.update(terms)
                    seen.update(terms)
                d.update(seen)
            if sum(map(len, counts.values())) > HELD:
                yield from packed(counts, within)
                counts, within = {}, {}
        yield from packed(counts, within)

    return given.mapInArrow(run, "lang string, source string, term string, n long, d long")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exact for any counts."""
    made = F.lit(BILLION).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", made, (total + 2 * kept).cast("decimal(19,0)")).cast("long")


def profiles(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups ``(lang, source, total, vocabulary, lang_total, slices, blocks, block)`` and their kept terms ``(lang, source, term, n, lang_n)``."""
    one = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    everywhere = Window.partitionBy("lang", "term")
    kept = one.withColumns({"_d": F.sum("d").over(everywhere), "lang_n": F.sum("n").over(everywhere), "_one": F.row_number().over(everywhere.orderBy("source"))})
    kept = materialize(kept.filter(F.col("_d") >= LEAST_DOCS).select("lang", "source", "term", "n", "lang_n", "_one"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("_one") == 1, 1)).alias("_v"), F.count(F.lit(1)).alias("_e"))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = named.join(sums, ["lang", "source"], "left").select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "_v", "_e")))
    groups = materialize(groups)
    langs = groups.groupBy("lang").agg(F.sum("_v").alias("vocabulary"), F.sum("total").alias("lang_total"), F.sum("_e").alias("_e"), F.count(F.lit(1)).alias("_g"))
    langs = langs.select("lang", "vocabulary", "lang_total", F.expr(f"cast(1 + _e div {SLICE} as int)").alias("slices"), F.expr(f"cast((_g + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"))
    groups = groups.drop("_v", "_e").join(maybe_broadcast(materialize(langs)), "lang")
    return materialize(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks").cast("long")).cast("int"))), kept


def _pack(at: np.ndarray, shares: np.ndarray) -> bytes:
    gaps = np.diff(at, prepend=0).astype(np.uint32)
    return pa.compress(np.concatenate([gaps, shares.astype(np.uint32)]).tobytes(), codec="zstd", asbytes=True)


def _unpack(vector: bytes, entries: int, width: int, absent: int) -> np.ndarray:
    """The shares over all terms of the slice."""
    out = np.full(width, absent, dtype=np.int64)
    if entries:
        raw = np.frombuffer(pa.decompress(vector, decompressed_size=8 * entries, codec="zstd", asbytes=True), dtype=np.uint32)
        out[np.cumsum(raw[:entries], dtype=np.int64)] = raw[entries:]
    return out


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def vectors(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, slice, source, block, blocks, width, absent, size, vector, top)``, one row for each group and slice.

    ``absent`` is the share of a term that the group lacks, ``top`` the slice's TOP terms that it has above the language's share.
    """
    by = maybe_broadcast(groups)
    sliced = kept.join(by, ["lang", "source"]).withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices").cast("long")).cast("int"))
    at = Window.partitionBy("lang", "slice").orderBy("term")
    numbered = materialize(sliced.select("lang", "slice", "source", "term", (F.dense_rank().over(at) - 1).alias("at"), _share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary")).alias("q")))
    widths = numbered.groupBy("lang", "slice").agg((F.max("at") + 1).alias("width"))
    roster = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    entries = numbered.groupBy("lang", "slice", "source").agg(F.array_sort(F.collect_list(F.struct("at", "p", "q", "term"))).alias("entries"))
    whole = roster.join(maybe_broadcast(materialize(widths)), ["lang", "slice"], "left").join(entries, ["lang", "slice", "source"], "left")
    absent = F.when(F.col("vocabulary") > 0, _share(F.lit(0), F.col("total"), F.greatest(F.col("vocabulary"), F.lit(1)))).otherwise(1)
    given = whole.select("lang", "slice", "source", "block", "blocks", F.coalesce("width", F.lit(0)).alias("width"), absent.alias("absent"), "entries")
    plain = ["lang", "slice", "source", "block", "blocks", "width", "absent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, packed, tops = [], [], []
            for cell in b.column("entries"):
                e = cell.values
                if e is None:
                    sizes.append(0)
                    packed.append(b"")
                    tops.append([])
                    continue
                a, p, q = (e.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                above = np.flatnonzero(p > q)
                f = _differ(p[above], q[above])
                names = e.field(3).take(pa.array(above)).to_pylist()
                tops.append([{"item": t, "value": int(v)} for v, t in heapq.nsmallest(TOP, zip((-f).tolist(), map(str.encode, names)))])
                sizes.append(len(a))
                packed.append(_pack(a, p))
            tops = [[{"item": t["item"].decode(), "value": -t["value"]} for t in x] for x in tops]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in plain), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.array(tops, pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())])))], names=[*plain, "size", "vector", "top"])

    return given.mapInArrow(run, "lang string, slice int, source string, block int, blocks int, width int, absent long, size int, vector binary, top array<struct<item:string,value:long>>")


def meetings(blocks: Column, block: Column, first: int, last: int) -> Column:
    """Where a block's vectors go: an array of ``(home, round)``, its own home at round -1 and those homes of opponents of the rounds ``first`` to ``last`` - 1 to which it travels.

    With n the blocks, one more if they are odd, x and y (below n - 1) meet in round (x + y) mod (n - 1), and the
    block n - 1 meets x in round 2 x mod (n - 1). The smaller is the host where x + y is even, else the larger.
    """
    rounds = blocks - 1 + blocks % 2

    def met(r: Column) -> Column:
        mirror = F.pmod(r - block, rounds)
        other = F.when(block == rounds, F.when(r % 2 == 0, r / 2).otherwise((r + rounds) / 2).cast("int")).when(mirror == block, rounds).otherwise(mirror)
        host = F.when((block + other) % 2 == 0, F.least(block, other)).otherwise(F.greatest(block, other))
        return F.when((other < blocks) & (host == other), F.struct(other.alias("home"), r.alias("round")))

    these = F.when(F.least(rounds, F.lit(last)) > first, F.sequence(F.lit(first), F.least(rounds, F.lit(last)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.struct(block.alias("home"), F.lit(-1).alias("round"))), F.filter(F.transform(these, met), lambda m: m.isNotNull()))


def _met(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a block's groups with those that arrive; rows come sorted by home, slice and round. ``inside``: also pairs within the block."""
    here, who, p, filled, absent = None, [], np.empty((0, 0), dtype=np.int64), 0, None
    for b in batches:
        out: list[tuple] = []
        columns = [b.column(k).to_pylist() for k in ("lang", "home", "slice", "round", "source", "width", "absent", "size")]
        for (lang, home, part, turn, source, width, lacking, size), vector in zip(zip(*columns), b.column("vector")):
            if here != (lang, home, part):
                here, who, p, filled = (lang, home, part), [], np.empty((BLOCK, width), dtype=np.int64), 0
            q = _unpack(vector.as_py(), size, width, lacking)
            if who and (turn >= 0 or inside):
                out += zip([lang] * len(who), who, [source] * len(who), _differ(p[:filled], q).sum(axis=1).tolist())
            if turn < 0:
                if filled == len(p):
                    p = np.concatenate([p, np.empty((max(1, len(p)), width), dtype=np.int64)])
                p[filled] = q
                filled += 1
                who.append(source)
        if out:
            lang, a, c, value = zip(*out)
            for x, y in ((a, c), (c, a)):
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def rotated(packed: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for all ordered pairs of a language's groups, from the written ``vectors``."""
    most = packed.agg(F.max("blocks")).first()[0] or 0
    rounds, parts = most - 1 + most % 2, []
    for first in range(0, max(1, rounds), WAVE):
        sent = packed.withColumn("_to", F.explode(meetings(F.col("blocks"), F.col("block"), first, first + WAVE))).select("lang", "slice", "source", "width", "absent", "size", "vector", "_to.home", "_to.round")
        sent = sent.withColumn("_lane", F.pmod(F.col("slice"), F.greatest(F.lit(1), F.floor(LANES / F.lit(max(1, most))).cast("int"))))
        dealt = sent.repartition("lang", "home", "_lane").sortWithinPartitions("lang", "home", "slice", "round")
        inside = first == 0
        met = dealt.mapInArrow(lambda batches, inside=inside: _met(batches, inside), "lang string, source string, item string, value long")
        parts.append(materialize(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def audit(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` has the other sources of the language, part ``term`` the TOP terms above the language's share."""
    groups, kept = profiles(docs)
    packed = materialize(vectors(groups, kept))
    release(kept)
    pairs = rotated(packed).withColumn("part", F.lit("pair"))
    terms = packed.select("lang", "source", F.explode("top").alias("_t")).select("lang", "source", "_t.item", "_t.value", F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return audit(table(spark, sf_dir, "documents"))


#: The same in SQL.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), t AS (SELECT lang, source, i, unnest(w) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST_DOCS}
), langs AS (SELECT lang, count(term) AS V, coalesce(sum(n), 0)::BIGINT AS L FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
), counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS N FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + ({BILLION}::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.N + 2 * V))::BIGINT AS p, (1 + ({BILLION}::HUGEINT * (k.n + 2)) // (L + 2 * V))::BIGINT AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q), row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term) FROM shares WHERE n > 0 AND p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term) <= {TOP}
)
SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked
"""
