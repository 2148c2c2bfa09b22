"""Operator 9: repeated runs of lines, found by winnowing and deleted from later documents.

Rule: a line is deleted if it lies in a run of consecutive lines of at least ``WORDS`` words
that occurs earlier, in a document with a smaller id or further up in the same one. Lines
are compared trimmed; blank lines don't count and fall with the run around them.

Method: a window is a shortest run of lines with WORDS words, from a line forwards or up to a
line backwards. Winnowing selects each window's smallest line hash (the last of equals); the
selected positions are the document's fingerprints, fewer than its lines. Two documents that
share a run of WORDS words share its windows, hence a fingerprint, guaranteed. Positions are
joined on fingerprints first: one that no other position has can't lie in a repeated run,
and its windows go no further. A fingerprint that is met again is extended both ways, by
the windows around it that selected it: each meets the first occurrence of its own content,
never all others, so a passage with thousands of occurrences costs a row a window, counted
by a partial aggregate. Windows forwards reach from a repeated run's start on, those backwards from
its end, so together they cover exactly the longest repeated run around a line.

Content keys are 128-bit XXH3. What is shuffled is a row of numbers per window of a repeated
fingerprint, then the documents once, to meet their own spans.

Defined cases: null and empty texts stay as they are (null as empty); documents of fewer
than WORDS words have no window; rows with one and the same ``doc_id`` and equal texts count
as one document, so neither is later; texts of one ``doc_id`` are documents of their own, in
order of their hashes; rows with a null ``doc_id`` come after all others, ordered by text
hash; very long lines are one line; an empty table gives no rows; extra
columns are carried along by ``strip``, one named like an added column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, KEY_SCHEMA, fresh, key_columns, materialize, maybe_broadcast, table, text_or_empty

WORDS = 50
_POSITIONS = f"{KEY_SCHEMA}, mark long, windows array<struct<high:long,low:long,first:int,last:int>>"


def windows(text: str, least: int = WORDS) -> list[tuple[int, int, int, int]]:
    """``(fingerprint, its line, first line, last line)`` of the shortest runs of ``least`` words from and up to each line.

    Line numbers count non-blank lines from 0.
    """
    lines = [s.encode("utf-8", "surrogatepass") for x in text.split("\n") if (s := x.strip())]
    if not lines:
        return []
    count = np.fromiter((len(x.split()) for x in lines), dtype=np.int64, count=len(lines))
    total = np.r_[0, np.cumsum(count)]
    if total[-1] < least:
        return []
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), dtype=np.uint64, count=len(lines))
    at = np.arange(len(lines))
    ends = np.searchsorted(total, total[:-1] + least, side="left") - 1
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    spans = {(int(a), int(b)) for a, b in zip(at[ends < len(lines)], ends[ends < len(lines)])}
    spans |= {(int(a), int(b)) for a, b in zip(starts[total[1:] >= least], at[total[1:] >= least])}
    out = []
    for a, b in sorted(spans):
        part = hashes[a : b + 1]
        at = b - int(part[::-1].argmin())
        out.append((int(hashes[at]), at, a, b))
    return out


def _select(least: int):
    """A row per selected position: its line hash and the windows that selected it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))

        def batch(rows: list) -> pa.RecordBatch:
            keys, marks, held = zip(*rows)
            high, low, first, last = zip(*(w for ws in held for w in ws))
            each = pa.StructArray.from_arrays([signed(high), signed(low), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["high", "low", "first", "last"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), each)
            none, ids, texts = zip(*keys)
            return pa.RecordBatch.from_arrays([pa.array(none, pa.bool_()), pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), signed(marks), lists], names=[*KEY, "mark", "windows"])

        rows: list = []
        for b in batches:
            for *key, text in zip(*(b.column(k).to_pylist() for k in KEY), b.column("_text")):
                text = text.as_py()
                found = windows(text, least)
                lines = [s.encode("utf-8", "surrogatepass") for x in text.split("\n") if (s := x.strip())] if found else []
                selected: dict[int, tuple] = {}
                for mark, at, first, last in found:
                    content = xxhash.xxh3_128_intdigest(b"\n".join(lines[first : last + 1]))
                    selected.setdefault(at, (key, mark, []))[2].append((content >> 64, content & 0xFFFFFFFFFFFFFFFF, first, last))
                for row in selected.values():
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def positions(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """``(KEY, mark, windows)``: the winnowed fingerprints of every document."""
    return docs.select(*key_columns(), text_or_empty().alias("_text")).mapInArrow(_select(least), _POSITIONS)


def repeated(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """``(KEY, spans)``: for documents with repeated runs, the ``(first, last)`` lines of windows that occur earlier."""
    found = materialize(positions(docs, least))
    again = materialize(found.groupBy("mark").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("mark"))
    met = found.join(maybe_broadcast(again), "mark", "left_semi").select(*KEY, F.explode("windows").alias("w")).select(*KEY, "w.*")
    content, place = ["high", "low"], F.struct(*KEY, "first")
    origin = met.groupBy(*content).agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    later = met.join(origin, content).filter(place > F.col("origin"))
    return later.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the spans' lines, its number of non-blank lines, and of removed ones."""
    lines = text.split("\n")
    where = [k for k, x in enumerate(lines) if x.strip()]
    gone = np.zeros(len(where) + 1, dtype=np.int64)
    for a, b in spans:
        if not 0 <= a <= b < len(where):
            raise ValueError("a span outside the text")
        gone[a] += 1
        gone[b + 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    if not gone.any():
        return text, len(where), 0
    kept, n = [], 0
    for k, line in enumerate(lines):
        if n < len(where) and where[n] == k:
            removed = gone[n]
            n += 1
        else:  # a blank line falls if both its neighbours do, or the only one
            around = [gone[j] for j in (n - 1, n) if 0 <= j < len(where)]
            removed = bool(around) and all(around)
        if not removed:
            kept.append(line)
    return "\n".join(kept), len(where), int(gone.sum())


def strip(docs: DataFrame, least: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with ``text`` rewritten, and ``n_lines, n_removed`` added."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("text", "n_lines", "n_removed")]
    source, marks, names = fresh(docs, "_text"), fresh(docs, "spans"), [fresh(docs, k) for k in KEY]
    schema = docs.select(*keep).schema.add("text", "string").add("n_lines", "integer").add("n_removed", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [without(t, [(s["first"], s["last"]) for s in spans or ()]) for t, spans in zip(b.column(source).to_pylist(), b.column(marks).to_pylist())]
            texts, n, removed = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(removed, pa.int32())], names=[*keep, "text", "n_lines", "n_removed"])

    given = docs.select(*keep, text_or_empty().alias(source), *(c.alias(n) for c, n in zip(key_columns(), names)))
    found = repeated(docs, least).select(*(F.col(k).alias(n) for k, n in zip(KEY, names)), F.col("spans").alias(marks))
    joined = given.join(found, names, "left").select(*keep, source, marks)
    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's line counts and the digest of what is left of its text."""
    out = strip(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
