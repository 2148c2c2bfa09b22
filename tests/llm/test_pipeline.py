"""The corpus pipeline's stages together."""

import random
import re
from collections import Counter

import corpus_pipeline
from fixtures import documents, words
from pyspark.sql import functions as F
from test_text_operators import edited, shingle_set, toxic_corpus

from terraspan.llm import op2_simhash, op5_toxicity
from terraspan.llm.common import materialize


def run(spark, monkeypatch, rows, stages):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in stages])
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: documents(spark, rows))
    got = corpus_pipeline.run(spark, "").collect()
    monkeypatch.undo()
    return got


def test_shards_follow_the_mix(spark, monkeypatch):
    """The hot source has 5/6 of the rows, but by square roots 0.69 of the weight until the others run out."""
    rows = [(i, f"t{i}", "hot" if i % 6 else "rare") for i in range(1440)]
    got = run(spark, monkeypatch, rows, {"mixing", "sharding"})
    assert sorted(r.doc_id for r in got) == list(range(1440)) and "position" not in got[0].asDict()
    share = Counter(r["shard"] for r in got if r.source == "hot")
    assert all(abs(share[s] - 60 * 5**0.5 / (1 + 5**0.5)) < 2 for s in range(12)) and all(share[s] == 60 for s in range(13, 24))
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(24) for k in range(60)]
    order = [r.source for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert all(abs(order[:n].count("hot") - n * 5**0.5 / (1 + 5**0.5)) < 1 for n in range(1, 700))
    again = run(spark, monkeypatch, rows[::-1], {"mixing", "sharding"})
    assert {(r.doc_id, r["shard"], r["slot"]) for r in got} == {(r.doc_id, r["shard"], r["slot"]) for r in again}


def test_few_rows_and_none(spark, monkeypatch):
    got = run(spark, monkeypatch, [(i, "x", None) for i in range(7)], {"mixing", "sharding"})
    assert len({r["shard"] for r in got}) == 7 and all(r["slot"] == 0 for r in got)
    assert run(spark, monkeypatch, [], {"mixing", "sharding"}) == []


def brute_classes(rows):
    """The smallest id of each row's class, by 3 bits or by similarity 0.8 on 5-word shingles, over all pairs; rows are ``(doc_id, text)``."""
    sets, fps, least = [shingle_set(t) for _, t in rows], [op2_simhash.fingerprint(t) for _, t in rows], {i: i for i, _ in rows}
    for j in range(len(rows)):
        for i in range(j):
            alike = bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike or (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((least[rows[i][0]], least[rows[j][0]]))
                least = {k: a if v == b else v for k, v in least.items()}
    return least


def found_in(text, item):
    """Whether a text has at least 0.8 of an item's distinct shingles of five words (an item of fewer is one shingle)."""
    cut = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    item, text = re.findall(r"[^\W_]+", item.lower()), re.findall(r"[^\W_]+", text.lower())
    width = min(5, len(item))
    wanted = cut(item, width) if item else set()
    return bool(wanted) and len(wanted & cut(text, width)) * 10 >= 8 * len(wanted)


def test_each_stage_on_what_the_one_before_kept(spark, monkeypatch):
    r = random.Random(11)
    rows, truth = toxic_corpus(700, 5)
    rows, toxic = rows[:700], {i for i, _, y in truth if y}
    items = [(k, words(n, 900 + k)) for k, n in enumerate((3, 12, 40, 200))] + [(9, None), (9, "")]
    for k in range(40):
        base = words(150, 3000 + k // 8, 5000).split()
        rows.append((1000 + k, edited(r, base, r.randrange(0, 6))))
    for k, (_, text) in enumerate(items[:4] * 3):
        rows.append((2000 + k, f"{words(80, 50 + k, 5000)} {edited(r, text.split(), k // 8)} {words(80, 70 + k, 5000)}"))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, words(20_000, 8, 5000)), (3004, rows[0][1]), (3004, "another text of one id")]
    rows = [(i, t, "hot" if i % 3 else f"s{i % 2}") for i, t in rows]
    tables = {"labels": spark.createDataFrame(truth, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    monkeypatch.setattr(corpus_pipeline, "table", lambda _s, _d, name: tables[name])
    docs = given = documents(spark, rows).withColumn("position", F.lit("mine"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""))
        seen[name] = [(x.doc_id, x.text or "") for x in docs.collect()]
        assert name in ("mixing", "sharding") or docs.columns == given.columns

    model = op5_toxicity.fit(given, tables["labels"])
    assert sorted(seen["toxicity"]) == sorted((i, t or "") for i, t, _ in rows if model.score([t or ""])[0] < op5_toxicity.THRESHOLD)
    rejected = {i for i, _, _ in rows} - {i for i, _ in seen["toxicity"]}
    assert len(rejected & toxic) > 0.85 * len(toxic) and len(rejected - toxic) <= 5

    # an id with two texts is two documents: told apart here by a half
    told = {(i, t): i + 0.5 * (i == 3004 and t.startswith("another")) for i, t in seen["toxicity"]}
    classes = brute_classes([(told[x], x[1]) for x in seen["toxicity"]])
    assert sorted(seen["near_duplicates"]) == sorted(x for x in seen["toxicity"] if classes[told[x]] == told[x])
    assert len(seen["toxicity"]) - len(seen["near_duplicates"]) >= 10

    clean = [x for x in seen["near_duplicates"] if not any(found_in(x[1], t or "") for _, t in items)]
    assert sorted(seen["decontamination"]) == sorted(clean) and len(seen["near_duplicates"]) - len(clean) >= 6

    assert sorted(seen["mixing"]) == sorted(seen["decontamination"]) == sorted(seen["sharding"])
    got, n = docs.collect(), len(clean)
    want = [(p * 24 // n) for p in range(n)]
    assert sorted((x["shard"], x["slot"]) for x in got) == sorted((s, p - want.index(s)) for p, s in enumerate(want))
