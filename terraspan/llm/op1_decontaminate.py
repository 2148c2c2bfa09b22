"""Operator 1: benchmark items inside documents, by size-partitioned MinHash containment search.

Native: DataFrame functions only. Words are runs of letters and digits in lower case,
shingles five words. An item of fewer words is one shingle of all its words, and documents
are also cut into shingles of each such width that an item has, so short items are found
inside long texts too. An item is found in a document that has at least ``THRESHOLD`` of
its distinct shingles.

A document is far larger than an item, so their Jaccard similarity is near zero and a fixed
signature of the document would miss items. The items are therefore the indexed side: they
are partitioned by the power of two of their shingle count, and each keeps a bottom-k
MinHash, k hashes of its shingles, where k depends on the partition's largest size U:
k = U - ceil(THRESHOLD U) + 1. Whatever part of an item a document may lack, at least one
of these k is then in it, so probing the index with all of a document's shingle hashes
finds every item: recall is 1 by construction, at a fraction of the items' hashes. The k are the
smallest hashes among those in the fewest items, so an opening that many items have in common
makes no candidates unless an item has nothing else. A candidate must also be large enough for
the item's size. Candidates are verified on the shingles' text, not on hashes.

The index is broadcast only if its counted rows allow it, and shuffled otherwise; so are
the candidates. Long documents are probed whole.

Defined cases: null or wordless texts match nothing; repeated items (of one ``item_id``) count as
one; rows equal in ``doc_id`` and text are reported once, texts of one ``doc_id`` each, rows with a null
``doc_id`` with null (one row per text and item); empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEY, fresh, id_of_key, key_columns, materialize, maybe_broadcast, pinned, table, text_or_empty

WORDS = 5
#: In tenths, so that the least count is exact: ceil(8 s / 10).
THRESHOLD_TENTHS = 8


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _each_shingle(words: Column, width: int, make) -> Column:
    """``make(words, i, width)`` for the 0-based start i of each shingle of ``width`` words of the array column ``words``."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))))
    return F.coalesce(F.transform(starts, lambda i: make(words, i, width)), F.array())


def _hash(words: Column, i: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(width)))


def _joined(words: Column, i: Column, width: int) -> Column:
    return F.array_join(F.slice(words, i + 1, width), " ")


def _by_width(width: Column, make, widths=range(1, WORDS + 1)) -> Column:
    """``make(w)`` for the w that equals ``width``."""
    out = F.when(width == widths[0], make(widths[0]))
    for w in widths[1:]:
        out = out.when(width == w, make(w))
    return out


def _need(count: Column) -> Column:
    return F.expr("0") + F.floor((count * THRESHOLD_TENTHS + 9) / 10).cast("int")


def index(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items ``(item_id, width, shingles, n_shingles, need)`` and the index ``(hash, width, item_id, need)``."""
    given = pinned(items.select("item_id", text_or_empty().alias("_text")).distinct().withColumn("_item", F.xxhash64("item_id", "_text")), "_words", words_of(F.col("_text"))).filter(F.size("_words") > 0)
    given = given.withColumn("width", F.least(F.size("_words"), F.lit(WORDS)))
    cut = lambda make: _by_width(F.col("width"), lambda w: _each_shingle(F.col("_words"), w, make))
    made = given.select(
        "item_id", "_item", "width", F.array_distinct(cut(_joined)).alias("shingles"), F.array_sort(F.array_distinct(cut(_hash))).alias("_hashes"),
    ).withColumn("n_shingles", F.size("shingles")).withColumn("need", _need(F.col("n_shingles")))
    made = made.withColumn("_class", F.floor(F.log2(F.col("n_shingles"))).cast("int"))
    largest = made.groupBy("_class").agg(F.max("n_shingles").alias("_largest"))
    made = materialize(made.join(largest, "_class").drop("_class"))
    k = F.col("_largest") - _need(F.col("_largest")) + 1
    each = made.select("item_id", "_item", "width", "need", k.alias("_k"), F.explode("_hashes").alias("hash"))
    common = each.groupBy("hash", "width").agg(F.count(F.lit(1)).alias("_items"))
    rarest = Window.partitionBy("_item").orderBy("_items", "hash")
    entries = each.join(common, ["hash", "width"]).withColumn("_at", F.row_number().over(rarest)).filter(F.col("_at") <= F.col("_k"))
    return materialize(made.select("item_id", "width", "shingles", "n_shingles", "need")), materialize(entries.select("item_id", "width", "need", "hash"))


def _with_width(width: int):
    return lambda h: F.struct(h.alias("hash"), F.lit(width).alias("width"))


def candidates(given: DataFrame, entries: DataFrame, widths: list[int]) -> DataFrame:
    """``(KEY, item_id)`` of documents ``(KEY, _text)`` that have one of an item's indexed hashes."""
    words = pinned(given, "_words", words_of(F.col("_text")))
    hashed = words.select(*KEY, F.concat(*(F.transform(_each_shingle(F.col("_words"), w, _hash), _with_width(w)) for w in widths)).alias("_hashes"))
    probes = hashed.select(*KEY, F.size("_hashes").alias("_size"), F.explode_outer("_hashes").alias("hash"))
    probes = probes.select(*KEY, "_size", "hash.*")
    hits = probes.join(maybe_broadcast(entries), ["hash", "width"]).filter(F.col("_size") >= F.col("need"))
    return materialize(hits.select(*KEY, "item_id").distinct())


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(KEY, doc_id, item_id, n_shingles, n_found)`` for every item found in a document."""
    whole, entries = index(items)
    widths = sorted(r["width"] for r in whole.select("width").distinct().collect()) or [WORDS]  # WORDS rows at most
    given = docs.select(*key_columns(), text_or_empty().alias("_text"))
    pairs = given.join(maybe_broadcast(candidates(given, entries, widths)), KEY).join(maybe_broadcast(whole), "item_id")
    pairs = pinned(pairs, "_words", words_of(F.col("_text")))
    there = _by_width(F.col("width"), lambda w: _each_shingle(F.col("_words"), w, _joined), widths)
    found = pinned(pairs, "n_found", F.size(F.array_intersect("shingles", there))).filter(F.col("n_found") >= F.col("need"))
    found = found.groupBy(*KEY, "item_id", "n_shingles").agg(F.max("n_found").alias("n_found"))
    return found.withColumn("doc_id", id_of_key())


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found."""
    names = [fresh(docs, k) for k in KEY]
    bad = materialize(contained(docs, items).select(*(F.col(k).alias(n) for k, n in zip(KEY, names))).distinct())
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(key_columns(), names)))
    return keyed.join(maybe_broadcast(bad), names, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    out = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_shingles", "n_found", F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment"))


SQL = """
WITH words AS (
  SELECT DISTINCT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w, 'd' AS kind FROM documents
  UNION ALL
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), 'b' FROM benchmark
), widths AS (SELECT DISTINCT least(len(w), 5) AS width FROM words WHERE kind = 'b' AND len(w) > 0
), shingles AS (
  SELECT DISTINCT kind, id, width, array_to_string(w[i + 1 : i + width], ' ') AS s
  FROM (SELECT kind, id, w, width, unnest(range(0, len(w) - width + 1)) AS i FROM words, widths WHERE len(w) >= width AND (kind = 'd' OR width = least(len(w), 5)))
), items AS (SELECT id, width, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'b')
SELECT d.id AS doc_id, i.id AS item_id, i.n::INTEGER AS n_shingles, count(*)::INTEGER AS n_found, round(count(*)::DOUBLE / i.n, 6) AS containment
FROM items i JOIN shingles d ON d.kind = 'd' AND d.width = i.width AND d.s = i.s
GROUP BY d.id, i.id, i.n HAVING count(*) * 10 >= i.n * 8
"""
