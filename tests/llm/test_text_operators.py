"""Brute force, held-out accuracy and planted cases for the operators on documents."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from fixtures import documents, words
from terraspan.llm import op1_decontaminate, op2_simhash, op3_mixing, op5_toxicity, op9_lines, op10_sharding, ranking


def slow_fingerprint(text):
    """The contract's rule, a bit at a time."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    got, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                got.append(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(got[i : i + 3]) for i in range(len(got) - 2)] if len(got) >= 3 else [" ".join(got)] if got else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \n", "A", "Ab cD", "É É É", "a b c", "A  b\tc\nd e f g h", "x y z", words(500, 9)])
def test_fingerprint(text):
    assert op2_simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_hash_is_sparks(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] & (2**64 - 1)
    assert op2_simhash.fingerprint("a b é") == got


def brute_links(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("run", [4096, 6])
def test_links_against_brute_force(spark, monkeypatch, run):
    """With runs of 6 at most, crowded variants skip the first level and the deeper levels are used."""
    monkeypatch.setattr(op2_simhash, "RUN", run)
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(60)}
    for centre in list(fps)[:6]:
        for _ in range(40):
            near = centre
            for _ in range(r.randrange(1, 6)):
                near ^= 1 << r.randrange(20 if r.random() < 0.5 else 64)
            fps.add(near)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    members = op2_simhash.connected_components(op2_simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    groups = {}
    for m in members:
        groups.setdefault(m.component, set()).add(m.node & (2**64 - 1))
    got = {frozenset(g) for g in groups.values()} | {frozenset([f]) for f in fps if not any(f in g for g in groups.values())}
    assert got == brute_links(sorted(fps))


def test_refinement_in_process(monkeypatch):
    """The levels' own code, run here: rows of long runs go on, and all links come out."""
    import pyarrow as pa

    monkeypatch.setattr(op2_simhash, "RUN", 3)
    r = random.Random(1)
    fps = sorted({0x0123456789ABCDEF ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for _ in range(150)})
    rows = [pa.RecordBatch.from_arrays([pa.array([0] * len(fps)), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array([0] * len(fps), pa.int32())], names=["key", "fp", "at"])]
    found, most = set(), 0
    for level in (1, 2, 3):
        table = pa.Table.from_batches(list(op2_simhash._variants(level)(iter(rows)))).sort_by("key")
        out = [b.to_pydict() for b in op2_simhash._runs(last=level == 3)(iter(table.to_batches(max_chunksize=7)))]
        rows_ = [(h, k, f, a) for b in out for h, k, f, a in zip(b["hot"], b["key"], b["fp"], b["at"])]
        found |= {frozenset((k & (2**64 - 1), f & (2**64 - 1))) for h, k, f, _ in rows_ if not h}
        hot = [(k, f, a) for h, k, f, a in rows_ if h]
        most = max(most, level if hot else 0)
        if not hot:
            break
        k, f, a = zip(*hot)
        rows = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(a, pa.int32())], names=["key", "fp", "at"])]
    assert most == 2  # the third level passes nothing on
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for pair in found:
        a, b = tuple(pair)
        assert (a ^ b).bit_count() <= 3
        parent[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    assert {frozenset(g) for g in groups.values()} == brute_links(fps)


def test_simhash_classes_and_survivors(spark):
    base, other = words(300, 1), words(300, 2)
    docs = documents(spark, [(10, base), (4, base), (7, base + " extra"), (3, other), (None, base), (None, words(300, 5)), (None, words(300, 5)), (4, base)])
    got = {(r.doc_id, r.component_id) for r in op2_simhash.classes(docs).collect()}
    assert {(10, 4), (4, 4), (7, 4), (3, 3)} <= got
    kept = [r.doc_id for r in op2_simhash.dedup(docs).collect()]
    assert sorted(kept, key=str) == [3, 4, None]


def test_survivors_against_brute_force(spark):
    """Copies with few edits in long texts: one of each class stays, the smallest id."""
    r, rows = random.Random(4), []
    for group in range(12):
        base = words(900, 1000 + group, 5000).split()
        for _ in range(20 if group == 0 else 4):
            copy = list(base)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(copy))
    r.shuffle(rows)
    fps = [op2_simhash.fingerprint(t) for t in rows]
    groups = brute_links(sorted(set(fps)))
    want = sorted(min(i for i, f in enumerate(fps) if f in g) for g in groups)
    assert 12 <= len(want) < len(rows) - 20
    assert sorted(x.doc_id for x in op2_simhash.dedup(documents(spark, list(enumerate(rows)))).collect()) == want


def edited(r, base, edits):
    copy = list(base)
    for _ in range(edits):
        copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
    return " ".join(copy)


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("run", [4096, 4])
def test_alike_texts_against_brute_force(spark, monkeypatch, run):
    """Copies with 1 to 6 edits in 200 words: similarities on both sides of 0.8. With short runs, longer ones are compared with leaders and in blocks."""
    monkeypatch.setattr(op2_simhash, "RUN", run)
    r = random.Random(7)
    rows = [edited(r, words(200, 2000 + g, 5000).split(), r.randrange(1, 7)) for g in range(12) for _ in range(8)] + ["a b", "A  b", "c", "", words(9000, 1), words(9000, 1) + " end"]
    sets = [shingle_set(t) for t in rows]
    fps = [op2_simhash.fingerprint(t) for t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = 0
    for i in range(len(rows)):
        for j in range(i):
            alike = bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike or (fps[i] ^ fps[j]).bit_count() <= 3:
                near += alike
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert near >= 30
    want = sorted({find(i) for i in range(len(rows))})
    assert sorted(x.doc_id for x in op2_simhash.dedup(documents(spark, list(enumerate(rows))), similar=True).collect()) == want


def test_forest_of_the_likest():
    """A maximum spanning forest connects what all candidate links connect, above any number of equal bytes."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (3, op2_simhash.SIGNATURE), dtype=np.uint8)
    sigs = base[rng.integers(0, 3, 60)]
    sigs = np.where(rng.random(sigs.shape) < rng.random((60, 1)) * 0.25, rng.integers(0, 256, sigs.shape, dtype=np.uint8), sigs)
    left, right = op2_simhash._likest(sigs)
    equal = (sigs[:, None] == sigs[None]).sum(axis=2)
    for least in range(op2_simhash.ALIKE, op2_simhash.SIGNATURE, 7):
        groups = []
        for links in (np.argwhere(equal >= least), [(a, b) for a, b in zip(left, right) if equal[a, b] >= least]):
            label = list(range(60))
            for _ in range(60):
                for a, b in links:
                    label[a] = label[b] = min(label[a], label[b])
            groups.append(label)
        assert groups[0] == groups[1]


def test_equal_ids_of_different_texts_both_stay(spark):
    kept = op2_simhash.dedup(documents(spark, [(1, words(60, 1)), (1, words(60, 2)), (1, words(60, 2)), (2, words(60, 1))])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, words(60, 1)), (1, words(60, 2))])


def test_decontamination(spark):
    item = words(30, 11)
    partly = item.split()
    partly[3] = "other"
    ends = item.split()[:-3]
    docs = documents(spark, [
        (1, words(2000, 20) + " " + item.upper() + ". " + words(2000, 21)), (2, words(200, 22)), (3, " ".join(partly)), (4, "pre " + " ".join(ends) + " post"), (5, "a b c"), (6, "a b c d"), (7, None), (8, item.replace(" ", ",\n")), (None, item),
    ])
    items = spark.createDataFrame([(1, item), (2, "A, b! c"), (3, None), (4, "...")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_found) for r in op1_decontaminate.contained(docs, items).collect()}
    assert found == {(1, 1, 26), (4, 1, 23), (5, 2, 1), (6, 2, 1), (8, 1, 26), (None, 1, 26), (3, 1, 22)}
    assert sorted(r.doc_id for r in op1_decontaminate.decontaminate(docs, items).collect()) == [2, 7]


@pytest.mark.parametrize("sizes, weights", [([5], [1]), ([50, 3, 7], [1, 5, 2]), ([200, 40, 40, 1], [1, 1, 1, 9]), ([30, 300], [9, 1])])
def test_pfair_windows(sizes, weights):
    """All deadlines are met, nothing runs before its release, and a source is within a block of the fluid mix."""
    blocks, w = np.array(sizes), np.array(weights)
    source, block, release, deadline = op3_mixing.windows(blocks, w)
    slot = op3_mixing.earliest_deadline_first(source, release, deadline)
    assert sorted(slot) == list(range(len(slot))) and (slot >= release).all() and (slot < deadline).all()
    fluid = np.zeros(len(sizes))
    for t in range(len(slot)):
        left = 1.0
        while left > 1e-12:  # the fluid mix during one slot; shares move on when a source runs out
            live = fluid < blocks - 1e-12
            rate = w * live / (w * live).sum()
            step = min(left, *((blocks - fluid)[live] / rate[live]))
            fluid += rate * step
            left -= step
        done = np.bincount(source[slot <= t], minlength=len(sizes))
        assert (np.abs(done - fluid) < 1 + 1e-9).all()


@pytest.mark.parametrize("rows", [[21845, *[2185] * 20], [int(9000 / k) + 1 for k in range(1, 1001)], [30000, *[1] * 30000]], ids=["hot", "zipf", "many"])
def test_deviation_from_unrounded_weights(rows):
    """At full size every source is within a block of the fluid mix of its real weight, up to rounding."""
    rows = np.array(rows)
    weight = np.sqrt(rows)
    names = [f"{i:05}" for i in range(len(rows))]
    got = op3_mixing.plan(pd.DataFrame({"source": names, "rows": rows, "weight": weight}), 1)
    source, block, slot = got["_s"].astype(int).to_numpy(), got["_b"].to_numpy(), got["slot"].to_numpy()
    assert len(slot) == rows.sum() > 50_000
    ends = np.sort(rows / weight)
    order = np.argsort(rows / weight, kind="stable")
    reached = np.cumsum(rows[order]) + np.r_[np.cumsum(weight[order][::-1])[::-1][1:], 0] * ends
    fluid = lambda t: np.minimum(rows[source], weight[source] * np.interp(t, np.r_[0, reached], np.r_[0, ends]))
    assert (np.abs(block - fluid(slot)) < 1.001).all() and (np.abs(block + 1 - fluid(slot + 1)) < 1.001).all()


def test_mix_is_whole_and_repeatable(spark):
    rows = [(i, f"t{i}", f"s{i % 7 % 3}") for i in range(200)] + [(200, "x", None), (201, "y", ""), (5, "t5", "s2")]
    got = op3_mixing.mix(documents(spark, rows), blocks=50).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    again = op3_mixing.mix(documents(spark, rows[::-1]).repartition(5), blocks=50).collect()
    assert sorted((r.position, r.text) for r in got) == sorted((r.position, r.text) for r in again)
    ordered = op3_mixing.in_order(op3_mixing.mix(documents(spark, rows), blocks=50)).select("position").collect()
    assert [r.position for r in ordered] == list(range(len(rows)))


def test_given_weights(spark):
    rows = [(i, "t", "ab"[i % 2]) for i in range(400)] + [(900, "t", "c")]
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    got = sorted((r.position, r.source) for r in op3_mixing.mix(documents(spark, rows), weights).collect())
    assert 148 <= sum(s == "a" for _, s in got[:200]) <= 152 and got[-1][1] == "c"


def test_shards(spark):
    rows = [(i, "é" * (i % 5), "hot" if i % 3 else f"s{i % 9}") for i in range(480)]
    got = op10_sharding.shard(documents(spark, rows)).collect()
    for s in range(24):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(20))
        assert abs(sum(r["source"] == "hot" for r in mine) - 320 / 24) < 1.5
    assert all(r["size"] == 2 * (r["doc_id"] % 5) + 8 for r in got)
    few = op10_sharding.shard(documents(spark, rows[:7])).collect()
    assert len({r["shard"] for r in few}) == 7 and all(r["slot"] == 0 for r in few)


def toxic_corpus(n=1500, seed=0):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = [f"w{r.randrange(900)}" for _ in range(r.randrange(30, 120))]
        bad = r.random() < 0.15
        if bad:
            for _ in range(r.randrange(3, 7)):
                text.insert(r.randrange(len(text)), r.choice(["grumpf", "blarghen", "snorkel" + r.choice(["s", "ing", "ed"])]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = op5_toxicity.fit(docs, known)
    truth = {i: y for i, _, y in labels}
    got = op5_toxicity._scores(docs, model, ["doc_id"]).withColumn("held", op5_toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert len(held) > 300 and all(0 <= r._score <= 1 for r in got)
    assert sum((r._score >= 0.7) == truth[r.doc_id] for r in held) / len(held) > 0.97
    flipped = known.withColumn("toxic", F.when(op5_toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (op5_toxicity.fit(docs, flipped).score([rows[0][1], rows[1][1], ""]) == model.score([rows[0][1], rows[1][1], ""])).all()


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    model = op5_toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert (model.score(["x", ""]) == 0).all() and op5_toxicity.accept(docs, model).count() == 2


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    x = r.normal(size=400)
    at, level = op5_toxicity.isotonic(x, (x + r.normal(size=400) > 0).astype(float))
    assert (np.diff(at) >= 0).all() and (np.diff(level) >= 0).all() and 0 <= level[0] < 0.2 and 0.8 < level[-1] <= 1


def slow_lines(docs, least):
    """Lines to delete, by comparing every run with every earlier one."""
    lines = {i: [x.strip() for x in t.split("\n") if x.strip()] for i, t in docs}
    runs = {}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for b in range(a, len(lines[i])):
                if sum(len(x.split()) for x in lines[i][a : b + 1]) >= least:
                    runs.setdefault(tuple(lines[i][a : b + 1]), []).append((i, a, b))
    gone = {i: set() for i in lines}
    for places in runs.values():
        for i, a, b in places[1:]:
            gone[i].update(range(a, b + 1))
    return {i: len(g) for i, g in gone.items()}


def test_lines_against_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(f"v{r.randrange(40)}" for _ in range(r.randrange(1, 9))) for _ in range(12)]
    docs = [(i, "\n".join(r.choice(pool) + (" " if r.random() < 0.3 else "") for _ in range(r.randrange(0, 14)))) for i in range(40)]
    got = {x.doc_id: x.n_removed for x in op9_lines.strip(documents(spark, docs), least=10).collect()}
    assert got == slow_lines(docs, 10)


def test_lines_keep_the_first(spark):
    passage = "\n".join(words(20, k) for k in range(3))
    docs = [(2, "intro two\n" + passage + "\n\noutro two"), (1, "intro one\n\n" + passage), (3, passage), (4, words(49, 9)), (5, words(49, 9))]
    got = {x.doc_id: x.text for x in op9_lines.strip(documents(spark, docs)).collect()}
    assert got[1] == docs[1][1] and got[2] == "intro two\n\noutro two" and got[3] == "" and got[4] == got[5] == docs[3][1]


def test_short_items_inside_long_texts(spark):
    docs = documents(spark, [(1, words(3000, 1) + " red fox " + words(3000, 2)), (2, words(50, 3) + " red. Dog"), (2**62, "x fox y"), (4, "red")])
    items = spark.createDataFrame([(1, "Red fox"), (2, "fox"), (3, "red fox dog cat")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op1_decontaminate.contained(docs, items).collect()} == {(1, 1), (1, 2), (2**62, 2)}
    assert sorted(r.doc_id for r in op1_decontaminate.decontaminate(docs, items).collect()) == [2, 4]


def test_one_id_with_two_texts(spark):
    """Neither text is lost, crashes a task or loses lines to the other; the order of rows doesn't matter."""
    passage = "\n".join(words(20, k) for k in range(3))
    rows = [(5, words(60, 1)), (5, passage), (3, "first\n" + passage), (5, words(60, 2)), (2**63 - 1, words(60, 1)), (2**62, words(60, 3)), (None, passage)]
    for order in (rows, rows[::-1]):
        docs = documents(spark, order)
        kept = {(r.doc_id, r.text) for r in op2_simhash.dedup(docs).collect()}
        assert kept == {(5, words(60, 1)), (5, words(60, 2)), (2**62, words(60, 3)), (3, "first\n" + passage)}
        got = {(r.doc_id, r.text) for r in op9_lines.strip(docs).collect()}
        assert got == {(5, words(60, 1)), (5, ""), (3, "first\n" + passage), (5, words(60, 2)), (2**63 - 1, ""), (2**62, words(60, 3)), (None, "")}
        ids = {r.doc_id: r.component_id for r in op2_simhash.classes(docs).collect()}
        assert ids[2**62] == 2**62 and ids[2**63 - 1] == 5


def test_fingerprints_are_fewer_than_lines(spark):
    docs = [(i, "\n".join(words(8, 100 * i + k) for k in range(30))) for i in range(20)]
    assert 20 <= op9_lines.positions(documents(spark, docs)).count() < 20 * 30 * 0.7


def test_a_common_opening_makes_no_pairs(spark):
    """Items and documents that all begin alike, whatever hash the opening has: candidates don't grow with items times documents, and what is contained is found."""
    opening = "which of the following statements about this"
    n = 150
    items = [(k, f"{opening} {words(30, k)}") for k in range(n)]
    docs = [(k, f"{words(40, 9000 + k)} {opening} {words(30, k) if k % 10 == 0 else words(30, 5000 + k)}") for k in range(n)]
    table = documents(spark, docs)
    whole, entries = op1_decontaminate.index(spark.createDataFrame(items, "item_id long, text string"))
    given = table.select(*op1_decontaminate.key_columns(), op1_decontaminate.text_or_empty().alias("_text"))
    assert op1_decontaminate.candidates(given, entries, [5]).count() < 2 * n
    found = op1_decontaminate.contained(table, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(k, k) for k in range(0, n, 10)]


def test_many_small_sources_are_spread(spark):
    """20,000 sources of one row: they are dealt over all bins of the order, and every shard has its part of them and of a larger source."""
    docs = documents(spark, [(k, "x", f"s{k}") for k in range(20_000)] + [(k, "y", "big") for k in range(2400)])
    out = op10_sharding.shard(docs, keep_row=False).withColumn("big", (F.col("source") == "big").cast("int"))
    by = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.sum("big").alias("big")).collect()
    assert len(by) == 24 and {r.n for r in by} <= {933, 934} and all(r.last == r.n - 1 and abs(r.big - 100) <= 15 for r in by)
    digests = [hashlib.md5(f"{op10_sharding.SEED}|s{k}".encode()).hexdigest() for k in range(20_000)]
    bins = Counter(int((1 - (int(d[:8], 16) + 0.5) / 2**32) * ranking.BINS) for d in digests)
    assert max(bins.values()) < 25
