"""Operator 2: near-duplicate classes by SimHash and deletion-variant signatures.

Text rule (the contract's): A-Z are lower-cased, words are runs without space and bytes
9-13, shingles are 3 consecutive words joined by a space, repeats included; a text with
fewer words is one shingle of all its words, one without words has fingerprint zero. A
fingerprint bit is 1 where more than half of the shingles' XXH64 (seed 42) have it.

Links, at most 3 differing bits, are found exactly: cut into 2 segments of 32 bits, a pair
differs by at most one bit in one of them, so both agree on one of that segment's 32
one-wildcard variants. Variants are dealt by their value, sorted and read as runs. A run
longer than RUN is never compared with itself: its rows go on to the next level, which
cuts what is left of the fingerprint again (16 + 16 bits, then 8 + 8) and adds a variant
of that to the key. Variants that may be that frequent are known from counts beforehand and
skip the first level, so no task reads them; on the second level 46 bits are fixed and a run
holds at most 2^18 fingerprints, on the third 53 bits and at most 2,048. Only edges of a spanning forest leave a run, never all pairs.
Equal fingerprints are one node from the start, so a group of copies costs one row.

``dedup(..., similar=True)`` also links texts whose sets of 5-word shingles are alike by a Jaccard similarity of
SIMILARITY or more: such texts differ in about ten bits of a SimHash, out of reach of any
segment. Texts meet where a band of BAND min-hashes agrees, at one of BANDS places (0.99 of pairs
at the threshold, more above); bands are counted first and runs of RUN at most read in sorted order.
A longer run has a leader, its least node, that all others are compared with where they lie. Those surely
alike are linked to it, and need no comparison with one another; the rest meet everyone, in
blocks of about RUN rows that are pairs of pieces of the run, so no task's share grows with the run. A run or block gives the edges of its
maximum spanning forest by similarity, measured on SIGNATURE min-hashes (standard error 0.025)
and from SURE below the threshold on; these, no more than rows of the run, are then checked
on the whole sets. A maximum forest connects what the links above any threshold connect, so
checking its edges alone loses a link only where the measure misorders two near the threshold.

Defined cases: a null text is the empty text; rows with a null ``doc_id`` take part, and a
class without any id has a null ``component_id``; repeated rows get equal results; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, fresh, key_columns, materialize, maybe_broadcast, table, text_or_empty
from .components import connected_components

MAX_BITS = 3
#: The longest run that one task compares with itself. Above 2,048 the third level needs no fourth.
RUN = 4096

#: The similarity on 5-word shingles from which ``dedup`` links texts if asked to, and the min-hashes it is measured on.
SIMILARITY, WIDTH, SIGNATURE = 0.8, 5, 256
BAND, BANDS = 6, 16
#: The allowance for the measure's error, and the equal bytes of two signatures from which they are a candidate.
SURE = 0.075
ALIKE = math.floor(1 + (SIMILARITY - SURE) * (SIGNATURE - 1))
#: The equal bytes from which two texts are taken for alike before the check: as far above the threshold.
SURELY = math.ceil(1 + (SIMILARITY + SURE) * (SIGNATURE - 1))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 of each shingle of ``width`` words, repeats included; nothing for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=max(1, len(words) - width + 1))


def signature(text: str | None) -> bytes | None:
    """The low bytes of SIGNATURE min-hashes over the text's 5-word shingles; None for a text without words."""
    hashes = shingle_hashes(text, WIDTH)
    if not len(hashes):
        return None
    least = np.full(SIGNATURE, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(hashes), 1024):  # a very long text in pieces
        part = hashes[at : at + 1024]
        low, high = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, (low + _FACTORS * high).min(axis=1), out=least)
    return least.astype(np.uint8).tobytes()


#: Odd factors, one a min-hash: the k-th hash of a shingle is the low half of its XXH64 plus this times the high half.
_FACTORS = np.random.default_rng(42).integers(0, 1 << 32, (SIGNATURE, 1), dtype=np.uint32) | np.uint32(1)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one text, of shingles of ``width`` words."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in pieces
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *keep: Column, width: int = 3, signed: bool = False) -> DataFrame:
    """The columns ``keep`` and ``fp``, one row per document, with ``sig`` if ``signed``; no shuffle."""
    given = docs.select(*keep, text_or_empty().alias("_text"))
    names = given.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").to_pylist()
            made = {"fp": pa.array(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))}
            if signed:
                made["sig"] = pa.array([signature(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), *made.values()], names=[*names, *made])

    schema = given.drop("_text").schema.add("fp", "long")
    return given.mapInArrow(run, schema.add("sig", "binary") if signed else schema)


def _mix(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A 64-bit key of two; a collision only brings a candidate that verification refuses."""
    x = (key * np.uint64(0x9E3779B97F4A7C15)) ^ more
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _variants(level: int):
    """Rows ``(key, fp, at, width)`` for rows of the level before; ``at, width``: the bits not yet cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                fp = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                key = part.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
                at = part.column("at").to_numpy(zero_copy_only=False).astype(np.uint64)
                half = np.uint64(64 >> level)
                for side in (0, 1):
                    low = at + half * np.uint64(side)
                    rest = at + half * np.uint64(1 - side)
                    segment = (fp >> low) & np.uint64((1 << int(half)) - 1)
                    tags = [segment & np.uint64(~(1 << p) & ((1 << int(half)) - 1)) | np.uint64((p << 1 | side) << 40) for p in range(int(half))]
                    keys = [_mix(key + np.uint64(level), t) for t in tags]
                    n = int(half)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, n).view(np.int64)), pa.array(np.tile(rest, n).astype(np.int32))],
                        names=["key", "fp", "at"],
                    )

    return run


def _forest(fps: np.ndarray) -> tuple[list, list]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left, right, open_, todo = [], [], fps, []
    while len(open_) or todo:
        if not todo:
            todo, open_ = [open_[0]], open_[1:]
        u = todo.pop()
        near = np.bitwise_count(open_ ^ u) <= MAX_BITS
        found = open_[near]
        if len(found):
            left.extend([u] * len(found))
            right.extend(found)
            todo.extend(found)
            open_ = open_[~near]
    return left, right


def _likest(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as places, of the maximum spanning forest by equal bytes, of those with ALIKE or more: grown from one place to the likest outside it."""
    n = len(sigs)
    best, via, outside = np.full(n, -1), np.zeros(n, dtype=np.int64), np.arange(1, n)
    left, right, last = [], [], 0
    while len(outside):
        equal = np.count_nonzero(sigs[outside] == sigs[last], axis=1)
        nearer = outside[equal > best[outside]]
        best[outside] = np.maximum(best[outside], equal)
        via[nearer] = last
        k = int(best[outside].argmax())
        last = outside[k]
        outside = np.delete(outside, k)
        if best[last] >= ALIKE:
            left.append(via[last])
            right.append(last)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _runs(last: bool):
    """Reads rows sorted by ``key``; rows ``(hot, key, fp, at)``: an edge ``fp``-``key`` (hot false) or a row for the next level."""

    def edges(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        a, b = fps[two], fps[two + 1]
        ok = np.bitwise_count(a ^ b) <= MAX_BITS
        lefts, rights = [a[ok]], [b[ok]]
        for start, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2]):
            x, y = _forest(np.unique(fps[start : start + n]))
            lefts.append(np.array(x, dtype=np.uint64))
            rights.append(np.array(y, dtype=np.uint64))
        pairs = np.unique(np.stack([np.concatenate(lefts), np.concatenate(rights)]), axis=1)
        return pairs[0], pairs[1]

    def batch(hot: bool, key: np.ndarray, fp: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(fp), hot)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(at.astype(np.int32))], names=["hot", "key", "fp", "at"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of the run that isn't ended, RUN rows at most
        n, hot = 0, None  # hot: the key of the run that is passed on
        for b in batches:
            key, fp = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp"))
            at = b.column("at").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            if hot is not None:
                same = int(np.searchsorted(key != hot, True)) if key[0] == hot else 0
                if same:
                    yield batch(True, key[:same], fp[:same], at[:same])
                key, fp, at = key[same:], fp[same:], at[same:]
                if not len(key):
                    continue
                hot = None
            if held:
                key, fp, at = (np.concatenate(x) for x in zip(*held, (key, fp, at)))
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            sizes = np.diff(bounds)
            big = np.zeros(len(key), dtype=bool)
            if not last:
                big = np.repeat(sizes > RUN, sizes)
            tail = bounds[-2]
            done = np.ones(len(key), dtype=bool)
            if big[-1]:
                hot = key[-1]
            else:
                done[tail:] = False
            if (now := done & ~big).any():
                x, y = edges(key[now], fp[now])
                if len(x):
                    yield batch(False, y, x, np.zeros(len(x)))
            if big.any():
                yield batch(True, key[big], fp[big], at[big])
            held = [] if big[-1] else [(key[tail:], fp[tail:], at[tail:])]
        if held:
            x, y = edges(held[0][0], held[0][1])
            if len(x):
                yield batch(False, y, x, np.zeros(len(x)))

    return run


def _crowded(rows: DataFrame) -> DataFrame:
    """``(key)``: the first level's variants that more than RUN rows could have.

    Such a variant stands for two segment values, so one of them has more than RUN / 2 rows. Values
    are counted by a partial aggregate, and only the few that are so frequent give their variants.
    """
    halves = F.array(*(F.struct(F.lit(s).alias("side"), F.expr(f"shiftrightunsigned(fp, {32 * s}) & 4294967295L").alias("segment")) for s in (0, 1)))
    counted = rows.select(F.explode(halves).alias("h")).groupBy("h.side", "h.segment").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > RUN // 2)
    # a fingerprint that has the frequent value as this segment, and its variants of this segment
    stand_in = counted.select(F.lit(0).cast("long").alias("key"), F.expr("shiftleft(segment, 32 * side)").alias("fp"), F.lit(0).alias("at"), F.col("side"))
    made = None
    for side in (0, 1):
        one = stand_in.filter(F.col("side") == side).select("key", "fp", "at").mapInArrow(_variants(1), _KEYED).filter(F.col("at") == 32 * (1 - side)).select("key")
        made = one if made is None else made.unionByName(one)
    return made.distinct()


_KEYED = "key long, fp long, at int"


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all links among the distinct fingerprints ``fp``."""
    found = []
    rows = nodes.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("at"))
    crowded = materialize(_crowded(rows))
    passed_on = None
    for level in (1, 2, 3):
        variants = rows.mapInArrow(_variants(level), _KEYED)
        if level == 1 and not crowded.isEmpty():
            # these rows never meet in one task: they go to the second level, where a run is of 2^18 rows at most
            few = maybe_broadcast(crowded)
            passed_on = variants.join(few, "key", "left_semi")
            variants = variants.join(few, "key", "left_anti")
        dealt = variants.repartition("key").sortWithinPartitions("key")
        out = materialize(dealt.mapInArrow(_runs(last=level == 3), "hot boolean, key long, fp long, at int"))
        found.append(out.filter("not hot").select(F.col("fp").alias("a"), F.col("key").alias("b")))
        rows = out.filter("hot").select("key", "fp", "at")
        if level == 1 and passed_on is not None:
            rows = rows.unionByName(passed_on)
        if level < 3 and rows.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def _alike_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows ``(key, sid, sig)`` sorted by ``key``; candidates ``(a, b)`` of a forest of each run."""

    def edges(key: np.ndarray, sid: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        two = two[np.count_nonzero(sig[two] == sig[two + 1], axis=1) >= ALIKE]
        lefts, rights = [two], [two + 1]
        for start, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2]):
            x, y = _likest(sig[start : start + n])
            lefts.append(start + x)
            rights.append(start + y)
        pairs = np.sort(np.stack([sid[np.concatenate(lefts)], sid[np.concatenate(rights)]]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    held: list[tuple] = []  # of the run that isn't ended
    for b in batches:
        if not b.num_rows:
            continue
        key, sid = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sid"))
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE)
        if held and key[-1] == held[0][0][0]:
            held.append((key, sid, sig))
            continue
        if held:
            key, sid, sig = (np.concatenate(x) for x in zip(*held, (key, sid, sig)))
        tail = int(np.searchsorted(key, key[-1]))
        if tail:
            yield edges(key[:tail], sid[:tail], sig[:tail])
        held = [(key[tail:], sid[tail:], sig[tail:])]
    if held:
        yield edges(*(np.concatenate(x) for x in zip(*held)))


def _beside_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, sid, lead, near)``; ``near``: surely alike the leader."""
    for b in batches:
        sig, lead = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE) for c in ("sig", "lead_sig"))
        near = np.count_nonzero(sig == lead, axis=1) >= SURELY
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "sid", "lead")), pa.array(near)], names=["key", "sid", "lead", "near"])


def _blocks(hot: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the rows ``(key, sid, lead)`` of long runs: links ``(a, b)`` to the leaders, and blocks ``(key, sid)`` in which all other pairs meet."""
    leaders = hot.select("lead").distinct().join(nodes.select(F.col("sid").alias("lead"), F.col("sig").alias("lead_sig")), "lead")
    beside = hot.join(nodes, "sid").join(maybe_broadcast(materialize(leaders)), "lead").select("key", "sid", "lead", "sig", "lead_sig")
    beside = materialize(beside.mapInArrow(_beside_leader, "key long, sid long, lead long, near boolean"))
    stars = beside.filter("near and sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    pieces = lambda n: F.ceil(n / max(1, RUN // 2))
    sizes = beside.groupBy("key").agg(pieces(F.count_if("near")).alias("near_pieces"), pieces(F.count_if(~F.col("near"))).alias("far_pieces")).filter("far_pieces > 0")
    placed = beside.join(maybe_broadcast(materialize(sizes)), "key")
    # pieces of near rows come first; two of them need not meet
    piece = F.when(F.col("near"), F.pmod("sid", "near_pieces")).otherwise(F.col("near_pieces") + F.pmod("sid", "far_pieces"))
    met = F.sequence(F.when(F.col("near"), F.col("near_pieces")).otherwise(F.lit(0).cast("long")), F.expr("near_pieces + far_pieces - 1"))
    rows = placed.select("key", "sid", piece.alias("piece"), F.explode(met).alias("other")).filter("piece <> other")
    return stars, rows.select(F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")).alias("key"), "sid")


def _candidates(nodes: DataFrame) -> DataFrame:
    """Distinct candidate pairs ``(a, b)``, the smaller first, among the materialized ``nodes`` ``(sid, sig)``.

    Bands are counted as rows of two numbers, so a signature that shares no band with another is never shuffled for it.
    """
    bands = F.array(*(F.xxhash64(F.lit(j), F.substring("sig", 1 + BAND * j, BAND)) for j in range(BANDS)))
    rows = nodes.select("sid", F.explode(bands).alias("key"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("sid").alias("_least")).filter("_n > 1")
    met = materialize(rows.join(counted.select("key", F.when(F.col("_n") > RUN, F.col("_least")).alias("lead")), "key"))
    runs, stars = met.filter("lead is null").select("key", "sid"), None
    hot = met.filter("lead is not null")
    if not hot.isEmpty():
        stars, blocks = _blocks(hot, nodes)
        runs = runs.unionByName(blocks)
    dealt = runs.join(nodes, "sid").select("key", "sid", "sig").repartition("key").sortWithinPartitions("key", "sid")
    pairs = dealt.mapInArrow(_alike_runs, "a long, b long")
    return (pairs if stars is None else pairs.unionByName(stars)).distinct()


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            sets = [np.unique(shingle_hashes(t, WIDTH)).view(np.int64) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("sid"), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "shingles"])


def alike_links(docs: DataFrame, fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints of texts alike by SIMILARITY; ``fps`` are the materialized ``(KEY, fp, sig)`` of ``docs``.

    Equal signatures are one node, and one text stands for it.
    """
    given = fps.filter("sig is not null").select(*KEY, "fp", "sig", F.xxhash64("sig").alias("sid"))
    least = F.min(F.struct("fp", *KEY)).alias("least")
    nodes = materialize(given.groupBy("sid").agg(least, F.any_value("sig").alias("sig")).select("sid", "least.*", "sig"))
    pairs = materialize(_candidates(nodes.select("sid", "sig")))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(nodes.select("sid", *KEY), "sid")
    texts = docs.select(*key_columns(), text_or_empty().alias("_text")).join(maybe_broadcast(materialize(wanted)), KEY)
    sets = materialize(texts.select("sid", "_text").mapInArrow(_shingle_sets, "sid long, shingles array<long>").dropDuplicates(["sid"]))
    one, other = (sets.select(F.col("sid").alias(s), F.col("shingles").alias(f"_{s}")) for s in ("a", "b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    linked = pairs.join(one, "a").join(other, "b").filter(shared >= SIMILARITY * (F.size("_a") + F.size("_b") - shared)).select("a", "b")
    for s in ("a", "b"):
        linked = linked.join(nodes.select(F.col("sid").alias(s), F.col("fp").alias(f"_{s}")), s)
    same = given.select("sid", F.col("fp").alias("a")).distinct().join(nodes.select("sid", F.col("fp").alias("b")), "sid")
    return linked.select(F.col("_a").alias("a"), F.col("_b").alias("b")).unionByName(same.select("a", "b")).filter("a <> b").distinct()


def _members(fps: DataFrame, order: Column, more: DataFrame | None = None) -> DataFrame:
    """``(fp, least, component)``: each fingerprint of the materialized ``fps`` with its rows' least ``order`` and its class, by its links and ``more`` edges."""
    nodes = materialize(fps.groupBy("fp").agg(F.min(order).alias("least")))
    edges = links(nodes)
    joined = connected_components(edges if more is None else edges.unionByName(more))
    return nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))


def _least(members: DataFrame) -> DataFrame:
    """``(component, least)``: the least of each class; a partial aggregate, so a class of any size."""
    return members.groupBy("component").agg(F.min("least").alias("least"))


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)``: every row with the smallest id of its class, null if no row of it has one."""
    fps = materialize(fingerprints(docs, F.col("doc_id").cast("long").alias("doc_id")))
    members = materialize(_members(fps, F.col("doc_id")))
    # written, so that the join reads plain shuffles on both sides: only then are the rows of one large class split over tasks
    found = members.select("fp", "component").join(materialize(_least(members)), "component")
    return fps.join(found.select("fp", "least"), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def dedup(docs: DataFrame, width: int = 3, similar: bool = False) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest id stays.

    Links are those of fingerprints of ``width``-word shingles and, if ``similar``, of texts alike by SIMILARITY on 5-word shingles.
    Rows are told apart by id and text, so one id with two texts is two documents; of one id's texts in a class
    the smallest hash stays, and rows without an id stay only in a class without any. Rows equal in both count as one.
    """
    names = [fresh(docs, k) for k in KEY]
    fps = materialize(fingerprints(docs, *key_columns(), width=width, signed=similar))
    kept = _least(_members(fps, F.struct(*KEY), alike_links(docs, fps) if similar else None)).select("least.*")
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(key_columns(), names)))
    kept = kept.select(*(F.col(k).alias(n) for k, n in zip(KEY, names)))
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and class."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
