"""The oracles of this part, and the edge cases that hold for every operator on documents."""

import os

import pytest
from pyspark.sql import functions as F

from compare import DATA, connection, rows
from fixtures import AWKWARD, documents
from terraspan.llm import components, op1_decontaminate, op2_simhash, op3_mixing, op4_telephony, op5_toxicity, op9_lines, op10_sharding, op11_quality, op12_divergence, op13_lexical, registry

BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "one two"), (1, "alpha beta gamma delta epsilon zeta eta theta")]


def bench(spark, rows_=BENCH):
    return spark.createDataFrame(rows_, "item_id long, text string")


def labels(spark, rows_=()):
    return spark.createDataFrame(list(rows_), "doc_id long, quality int, toxic int")


RUNS = {
    "op1": lambda s, d: op1_decontaminate.contained(d, bench(s)),
    "op1_keep": lambda s, d: op1_decontaminate.decontaminate(d, bench(s)),
    "op2": lambda s, d: op2_simhash.classes(d),
    "op2_keep": lambda s, d: op2_simhash.dedup(d),
    "op2_similar": lambda s, d: op2_simhash.dedup(d, similar=True),
    "op3": lambda s, d: op3_mixing.mix(d),
    "op4": lambda s, d: op4_telephony.described(op4_telephony.store(d, d.columns)),
    "op5": lambda s, d: op5_toxicity.accept(d, op5_toxicity.fit(d, labels(s, [(4, 1, 0), (5, None, None), (None, 1, 1), (77, 0, 1)]))),
    "op9": lambda s, d: op9_lines.strip(d),
    "op10": lambda s, d: op10_sharding.shard(d),
    "op11": lambda s, d: op11_quality.judged(d),
    "op11_keep": lambda s, d: op11_quality.accept(d),
    "op12": lambda s, d: op12_divergence.audit(d),
    "op13": lambda s, d: op13_lexical.search(d, bench(s)),
}
WHOLE = {"op3", "op4", "op5", "op9", "op10", "op11", "op2"}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_awkward_rows(spark, name):
    got = RUNS[name](spark, documents(spark, AWKWARD, clash=True)).collect()
    assert len(got) == len(AWKWARD) if name in WHOLE else len(got) <= len(AWKWARD)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, name):
    assert RUNS[name](spark, documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op1_keep", "op2_keep", "op5", "op11_keep"])
def test_filters_keep_their_columns(spark, name):
    docs = documents(spark, AWKWARD, clash=True)
    assert RUNS[name](spark, docs).columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_oracle(spark, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), connection().sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_components_against_union_find(spark):
    import random

    r = random.Random(5)
    edges = [(i, i + 1) for i in range(200, 260)] + [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(7, 7), (3, 4), (3, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_native_operators_stay_in_the_jvm(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = documents(spark, AWKWARD)
    for df in (op1_decontaminate.contained(docs, bench(spark)), registry.QUERIES["op6_chat"](spark, DATA) if os.path.isdir(DATA) else docs):
        assert not any(w in plan(df) for w in ("Python", "Pandas", "InArrow"))
    assert F is not None
