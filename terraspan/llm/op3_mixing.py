"""Operator 3: interleaving sources by target weights, with less than one block of deviation.

Method, Pfair scheduling: each source's rows, in seeded-shuffle order, are cut into blocks.
In the ideal (fluid) mix every source that still has rows advances at its share of the
weights; a block's release is the slot in which the fluid mix begins it, its deadline the
slot by whose end the fluid mix has finished it. Earliest deadline first over released
blocks, one block a slot, meets all deadlines, so at any slot each source is less than one
block ahead of or behind its target. When a source runs out its share goes to the others in
proportion, so all rows are kept: the mix has every document exactly once.

The schedule is over blocks, not rows. A block is a fixed share of the mix, 1 / ``BLOCKS`` (and
each source's last may be short), so shares deviate by less than 1 / BLOCKS of all rows at any N,
and the one task that schedules holds as much. A finer mix takes a larger ``blocks``.
A source's rank is found by ``ranking`` without a task that holds a whole source.

Defined cases: null and empty source are one source, ``""``; without given weights a source
has the square root of its share (temperature 2); a source missing from given weights, or
with a weight of 0, follows after all others; a null text changes nothing; rows equal in id
and CRC are interchangeable; an empty table gives no rows. Extra columns are carried along
by ``mix``; one named like an added column gives way to it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, table, text_or_empty, with_columns
from .ranking import rank_in_groups, seeded_digest

BLOCKS = 1 << 16
SEED = 3
#: Weights are whole multiples of the total over this: fine enough that rounding moves a source by under 1e-4
#: blocks, and small enough that windows are exact (BLOCKS times UNITS is 2^50; fractions of such numbers differ as doubles).
UNITS = 1 << 34


def windows(blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(source, block, release, deadline)`` of all blocks, for whole weights of at least 1.

    With V the fluid mix's virtual time, source i has min(blocks_i, weight_i V) blocks, and the
    slot reached is T(V), their sum; block j of source i takes V from j / weight_i to (j + 1) / weight_i.
    """
    ends = blocks / weights
    order = np.argsort(ends, kind="stable")
    done = np.r_[0, np.cumsum(blocks[order])]
    rate = np.r_[np.cumsum(weights[order][::-1])[::-1], 0]
    source = np.repeat(np.arange(len(blocks)), blocks)
    block = np.arange(len(source)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    weight = weights[source]
    past = np.searchsorted(ends[order], block / weight, side="right")
    release = done[past] + (block * rate[past]) // weight
    past = np.searchsorted(ends[order], (block + 1) / weight, side="left")
    deadline = done[past] - (-((block + 1) * rate[past]) // weight)
    return source, block, release, deadline


def earliest_deadline_first(source: np.ndarray, release: np.ndarray, deadline: np.ndarray) -> np.ndarray:
    """The slot of each block; among equal deadlines the source that comes first."""
    slot = np.empty(len(source), dtype=np.int64)
    order = np.argsort(release, kind="stable")
    ready: list[tuple] = []
    at = 0
    due, who, when = deadline.tolist(), source.tolist(), release.tolist()
    todo = order.tolist()
    for t in range(len(todo)):
        while at < len(todo) and (not ready or when[todo[at]] <= t):
            heapq.heappush(ready, (due[todo[at]], who[todo[at]], todo[at]))
            at += 1
        slot[heapq.heappop(ready)[2]] = t
    return slot


def whole_weights(share: np.ndarray) -> np.ndarray:
    """Positive weights as whole numbers of sum UNITS, by largest remainders; at least 1 each."""
    exact = share / share.sum() * UNITS
    whole = np.floor(exact).astype(np.int64)
    short = UNITS - int(whole.sum())
    whole[np.argsort(whole - exact, kind="stable")[: max(0, short)]] += 1
    return np.maximum(1, whole)


def plan(sources: pd.DataFrame, block_rows: int) -> pd.DataFrame:
    """The schedule of sources ``(source, rows, weight)``: a row per block with its rows' first position ``start``."""
    s = sources.sort_values("source").reset_index(drop=True)
    weight = s["weight"].fillna(0.0).clip(lower=0.0).to_numpy(dtype=float)
    tiers, base, first = [], 0, 0
    for tier in (np.flatnonzero(weight > 0), np.flatnonzero(weight <= 0)):
        if not len(tier):
            continue
        rows = s["rows"].to_numpy(dtype=np.int64)[tier]
        share = weight[tier] if weight[tier[0]] > 0 else np.ones(len(tier))
        blocks = -(-rows // block_rows)
        who, block, release, deadline = windows(blocks, whole_weights(share))
        slot = earliest_deadline_first(who, release, deadline)
        size = np.minimum(block_rows, rows[who] - block * block_rows)
        order = np.argsort(slot)
        start = np.empty(len(slot), dtype=np.int64)
        start[order] = first + np.cumsum(size[order]) - size[order]
        tiers.append(pd.DataFrame({
            "_s": s["source"].to_numpy()[tier][who], "_b": block, "release": release + base, "deadline": deadline + base, "slot": slot + base, "_start": start,
        }))
        base, first = base + len(slot), first + int(size.sum())
    return pd.concat(tiers) if tiers else pd.DataFrame(columns=["_s", "_b", "release", "deadline", "slot", "_start"])


def mix(docs: DataFrame, weights: DataFrame | None = None, blocks: int = BLOCKS, seed: int = SEED, keep_row: bool = True) -> DataFrame:
    """Adds ``block, release, deadline, slot, position`` to every row; ``position`` counts the mix's rows from 0.

    ``weights`` has ``source, weight`` (any positive scale). With ``keep_row`` the input's
    columns are carried along, else only ``doc_id`` and ``source``.
    """
    total = docs.count()
    block_rows = max(1, -(-total // blocks))
    row = F.struct(*docs.columns) if keep_row else F.struct("doc_id", "source")
    base = docs.select(
        row.alias("_row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.col("doc_id").alias("_id"), F.crc32(text_or_empty().cast("binary")).alias("_crc"),
    ).withColumn("_digest", seeded_digest(seed, F.col("_id"), F.col("_crc")))
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.sqrt(F.col("rows").cast("double")))
    else:
        given = weights.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(given.groupBy("source").agg(F.sum("weight").alias("weight")), "source", "left")

    def scheduled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if found := [f for f in frames if len(f)]:
            yield plan(pd.concat(found), block_rows)

    schedule = materialize(sizes.coalesce(1).mapInPandas(scheduled, "_s string, _b long, release long, deadline long, slot long, _start long"))
    ranked = rank_in_groups(base, "_source", "_digest", ["_id", "_crc"], "_rank", "_of")
    ranked = ranked.withColumn("_block", F.expr(f"(_rank - 1) div {block_rows}"))
    placed = ranked.join(maybe_broadcast(schedule), (F.col("_source") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return with_columns("_row", placed, {
        "block": F.col("_block"), "release": F.col("release"), "deadline": F.col("deadline"), "slot": F.col("slot"),
        "position": F.expr(f"_start + (_rank - 1) % {block_rows}"),
    })


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` as consecutive partitions in order of position, ``position`` included."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix."""
    return mix(table(spark, sf_dir, "documents"), keep_row=False).select("doc_id", "source", "block", "release", "deadline", "slot", "position")
