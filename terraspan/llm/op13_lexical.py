"""Operator 13: ranked lexical search, every item of a query table against all documents.

Terms are runs of letters, digits and characters beyond ASCII, only A-Z lower-cased. With N documents that have terms,
L terms in all, n in a document and tf of one term there, a term in df documents weighs w = floor(1000 ln((2 N + 2) / (2 df + 1)))
and adds w (10^9 tf div (1000 tf + 8 m)) to a document's score for each time the item has it, where m = 25 + 75 n N div L.

Index (``index``): a task turns the texts that it reads into segments of at most SEGMENT documents (or POSTINGS postings) in
ascending doc_id, with no shuffle of texts: a row of ids and lengths, and a row a term with its slots and counts.
If the distinct terms of the items are at most VOCABULARY_BYTES, the tasks keep these terms alone; otherwise all
terms are indexed, and the join with the items' terms selects. Both give the same postings.

Search, windowed bucket scoring: a segment's postings of the asked terms meet in one task, for one block of at most
ITEMS items or so; postings are traversed in fixed windows of WINDOW documents. In a window an item's terms
scatter-add into one array of buckets that fits the cache and mark 64 buckets a bit of occupancy; the occupied
ones that reach the heap's least score are harvested into the item's heap of ``top`` documents. Heaps
live as long as the task works on a block of items; what they hold is ranked by a window (top rows a task and item, limited before its shuffle).

Hot terms cost each segment one row, and a source or an id with many rows is spread as its files are. Nothing is pruned
by impact, so scores are exact.

Defined cases: null or termless texts count for nothing and are never found; items without terms give no rows; a
repeated item (same id and text) counts once, texts of one ``item_id`` are items each, ranked each; rows with equal or null ``doc_id`` are documents
each, null ids come last among equal scores; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, table, text_or_empty
from .terms import ALPHANUMERIC_TERMS, pieces

TOP = 10
#: Documents and postings of a segment, documents of a window (32 KB of buckets), items searched together.
SEGMENT, POSTINGS, WINDOW, ITEMS = 1 << 14, 1 << 21, 1 << 12, 1024
#: Bytes of distinct item terms up to which the reading tasks get them all.
VOCABULARY_BYTES = 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_SCHEMA = "segment long, term string, slots array<int>, counts array<int>, ids array<long>, lengths array<long>"


def terms_of(text: Column) -> Column:
    """The terms of a text column, as an array."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BREAKS), lambda t: t != "")


class _Segment:
    """Documents read so far; ``batches`` sorts them by id and turns them into rows."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.names = [], array("q"), {}
        self.term, self.slot, self.count = array("q"), array("q"), array("q")

    def add(self, doc_id: int | None, text: bytes, vocabulary: frozenset | None) -> None:
        found, n = Counter(), 0
        for terms in pieces(text.translate(ALPHANUMERIC_TERMS)):
            n += len(terms)
            found.update(terms if vocabulary is None else filter(vocabulary.__contains__, terms))
        if n:
            self.term.extend(self.names.setdefault(t, len(self.names)) for t in found)
            self.slot.extend([len(self.ids)] * len(found))
            self.count.extend(found.values())
            self.ids.append(doc_id)
            self.lengths.append(n)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT or len(self.term) >= POSTINGS

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        term, slot, count = np.frombuffer(self.term, dtype=np.int64), place[np.frombuffer(self.slot, dtype=np.int64)], np.frombuffer(self.count, dtype=np.int64)
        by = np.lexsort((slot, term))
        starts = np.searchsorted(term[by], np.arange(len(self.names) + 1)).astype(np.int32)
        ends, none = pa.array(starts, pa.int32()), len(self.names)
        lists = lambda v: pa.ListArray.from_arrays(ends, pa.array(v[by].astype(np.int32)))
        empty = lambda kind, k: pa.nulls(k, pa.list_(kind))
        names = ["segment", "term", "slots", "counts", "ids", "lengths"]
        lengths = np.frombuffer(self.lengths, dtype=np.int64)[order]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.string()), empty(pa.int32(), 1), empty(pa.int32(), 1), pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([number] * none, pa.int64()), pa.array(list(self.names), pa.binary()).cast(pa.string()), lists(slot), lists(count), empty(pa.int64(), none), empty(pa.int64(), none)], names=names)


def index(docs: DataFrame, vocabulary: frozenset | None = None) -> DataFrame:
    """The segments of ``docs``: rows ``(segment, ids, lengths)`` with a null term, and ``(segment, term, slots, counts)``. ``vocabulary``: the terms to index, as bytes, all if not given."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, kept = TaskContext.get().partitionId() << 32, _Segment(), held.value
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                now.add(doc_id, text.as_py(), kept)
                if now.full():
                    yield from now.batches(number)
                    number, now = number + 1, _Segment()
        yield from now.batches(number)

    return given.mapInArrow(run, _SCHEMA)


class _Postings:
    """One block of items over one segment: the documents, what each posting adds to them, and which items ask for it."""

    def __init__(self, ids: list, lengths: np.ndarray, n: int, total: int) -> None:
        self.ids, self.asked = ids, {}
        whole = 75 * n * int(lengths.max(initial=0)) < 1 << 63
        self.norm = 25 + (75 * n * lengths // total if whole else np.array([75 * n * int(x) // total for x in lengths], dtype=np.int64))
        self.edges = np.arange(0, len(ids) + WINDOW, WINDOW)

    def add(self, slots: np.ndarray, tf: np.ndarray, weight: int, asks: list[dict]) -> None:
        adds = weight * (1_000_000_000 * tf // (1000 * tf + 8 * self.norm[slots]))
        posting = slots, adds, np.searchsorted(slots, self.edges)
        for a in asks:
            self.asked.setdefault((a["item_id"], a["hash"]), []).append((posting, a["n"]))

    def harvest(self, heaps: dict, top: int) -> None:
        buckets, occupied = np.zeros(WINDOW, dtype=np.int64), np.zeros(WINDOW // 64, dtype=bool)
        for w in range(len(self.edges) - 1):
            first = w * WINDOW
            for item, terms in self.asked.items():
                for (slots, adds, at), n in terms:
                    part = slice(at[w], at[w + 1])
                    here = slots[part] - first
                    buckets[here] += adds[part] * n if n > 1 else adds[part]
                    occupied[here >> 6] = True
                heap = heaps.setdefault(item, [])
                groups = np.flatnonzero(occupied)
                scores = buckets.reshape(-1, 64)[groups]
                row, column = np.nonzero(scores >= max(1, heap[0][0] if len(heap) == top else 1))
                for score, slot in zip(scores[row, column].tolist(), (first + 64 * groups[row] + column).tolist()):
                    doc = self.ids[slot]
                    entry = (score, doc is not None, -(doc or 0))
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                buckets.reshape(-1, 64)[groups] = 0
                occupied[groups] = False


def _scored(batches: Iterator[pa.RecordBatch], n: int, total: int, top: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block of items and segment, a segment's documents before its postings."""
    here, now, heaps = None, None, {}

    def out() -> Iterator[pa.RecordBatch]:
        found = [(item, hash_, -doc if known else None, score) for (item, hash_), heap in heaps.items() for score, known, doc in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["item_id", "hash", "doc_id", "score"])

    for b in batches:
        blocks, segments, weights, asks = (b.column(k).to_pylist() for k in ("block", "segment", "weight", "asks"))
        slots, counts, ids, lengths = (b.column(k) for k in ("slots", "counts", "ids", "lengths"))
        flat = lambda cell, kind: cell.values.to_numpy(zero_copy_only=False).astype(kind)
        for i, key in enumerate(zip(blocks, segments)):
            if key != here:
                if now is not None:
                    now.harvest(heaps, top)
                if here is not None and here[0] != key[0]:
                    yield from out()
                    heaps = {}
                here, now = key, _Postings(ids[i].as_py(), flat(lengths[i], np.int64), n, total)
            if weights[i] is not None:
                now.add(flat(slots[i], np.int64), flat(counts[i], np.int64), weights[i], asks[i])
    if now is not None:
        now.harvest(heaps, top)
    yield from out()


def asked(items: DataFrame) -> DataFrame:
    """``(item_id, hash, term, n)`` of each item's distinct terms; ``hash`` tells texts of one id apart."""
    given = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("_text")).distinct()
    one = given.select("item_id", F.xxhash64("_text").alias("hash"), F.explode(terms_of(F.col("_text"))).alias("term"))
    return one.groupBy("item_id", "hash", "term").agg(F.count(F.lit(1)).alias("n"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item."""
    wanted = materialize(asked(items))
    distinct = materialize(wanted.select("term").distinct())
    size = distinct.agg(F.sum(F.octet_length("term") + 64).cast("long")).first()[0] or 0
    vocabulary = frozenset(r["term"].encode() for r in distinct.toLocalIterator()) if size <= vocabulary_bytes else None
    segments = materialize(index(docs, vocabulary))
    shelves = segments.filter("term is null").select("segment", "ids", "lengths")
    n, total = shelves.agg(F.sum(F.size("ids")).cast("long"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    postings = segments.filter("term is not null").select("segment", "term", "slots", "counts")
    found = postings.select("term", F.size("slots").alias("_n")).join(maybe_broadcast(distinct), "term").groupBy("term").agg(F.sum("_n").alias("df"))
    weight = F.floor(1000.0 * F.log((F.lit(2 * (n or 0)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = materialize(found.select("term", weight.alias("weight")))
    blocks = -(-wanted.select("item_id", "hash").distinct().count() // ITEMS) or 1
    block = F.pmod(F.xxhash64("item_id", "hash"), F.lit(blocks)).cast("int")
    asks = wanted.withColumn("block", block).groupBy("term", "block").agg(F.collect_list(F.struct("item_id", "hash", "n")).alias("asks"))
    asks = materialize(asks.join(maybe_broadcast(weights), "term"))
    hits = postings.join(maybe_broadcast(asks), "term").select("block", "segment", "weight", "asks", "slots", "counts")
    everywhere = shelves.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = hits.unionByName(everywhere, allowMissingColumns=True).repartition("block", "segment").sortWithinPartitions("block", "segment", F.col("weight").isNotNull())
    best = dealt.mapInArrow(lambda batches: _scored(batches, n or 0, total or 1, top), "item_id long, hash long, doc_id long, score long")
    order = Window.partitionBy("item_id", "hash").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every benchmark item over all documents."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: The same in SQL.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_TERMS} AS w FROM documents
), stats AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS N, sum(len(w))::BIGINT AS L FROM d
), q AS (SELECT item_id, h, term, count(*) AS n FROM (SELECT item_id, hash(text) AS h, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), t AS (SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY i, term
), weights AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, stats GROUP BY term, N
), norms AS (SELECT i, doc_id, 25 + (75 * len(w) * N) // L AS m FROM d, stats
), scores AS (
  SELECT item_id, h, doc_id, d.i, sum(q.n * weights.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN weights USING (term) JOIN norms d ON d.i = t.i GROUP BY ALL
), ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, h ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= {TOP}
"""
