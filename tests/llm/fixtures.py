"""Small tables with the awkward rows that every operator must survive."""

from pyspark.sql import functions as F

CLASH = ["fp", "key", "rank", "component_id", "score", "shard", "slot", "size", "_row", "_id", "_text", "position", "_row_id", "_score", "_scored_text", "_media_text", "spans", "media", "n_removed"]


def documents(spark, rows, clash=False):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)``; optionally with extra columns named like working ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def words(n, seed=0, vocabulary=500):
    """A text of n words that depends on the seed."""
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, words(40, 1)), (7, words(40, 1)), (7, words(40, 1)), (None, words(40, 1)), (None, words(30, 2)), (None, None), (8, words(30_000, 3)), (9, "\udc80".encode("utf-8", "replace").decode() + " é ß 漢字 " + words(12, 4))]
