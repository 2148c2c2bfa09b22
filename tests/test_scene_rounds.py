"""Decluttering in rounds against the sequential rule."""

import random

import pytest

from terraspan.operators import scene


@pytest.fixture(autouse=True, params=[8, 512])
def fold(request, monkeypatch):
    """In rounds down to a few labels, and by the fold wherever it may be."""
    monkeypatch.setattr(scene, "FOLD", request.param)


def sequential(rows):
    drawn, out = {}, set()
    for s, p, text, visible, alpha, polite, *b in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        if not visible or alpha < 0.02 or not text:
            continue
        taken = drawn.setdefault(s, [])
        if polite is not False and any(b[0] < t[2] and b[2] > t[0] and b[1] < t[3] and b[3] > t[1] for t in taken):
            continue
        taken.append(b)
        out.add((s, p))
    return out


@pytest.mark.parametrize("seed, n, side, rude", [(1, 300, 400, 0.15), (2, 150, 60, 0.0), (3, 60, 40, 0.5), (4, 200, 4000, 0.1)])
def test_rounds_equal_the_sequential_rule(spark, seed, n, side, rude):
    r = random.Random(seed)
    rows = []
    for p in range(n):
        x, y = r.randrange(-side, side), r.randrange(-side, side)
        rows.append((r.choice([None, 1, 1, 2]), p, "" if r.random() < 0.05 else "t", r.random() > 0.05, r.choice([0.0, 1.0, 1.0, 1.0]), False if r.random() < rude else None, float(x), float(y), x + float(r.randrange(1, 90)), y + float(r.randrange(1, 40))))
    df = spark.createDataFrame(rows, "scene int, priority int, text string, visible boolean, alpha double, declutter boolean, bl double, bt double, br double, bb double")
    got = [(x.scene, x.priority) for x in scene.declutter(df).collect()]
    assert len(got) == len(set(got)) and set(got) == sequential(rows)


def test_a_chain_and_a_pile(spark):
    """Labels each overlapping the next, in order: every other one is drawn; of a pile of equal boxes the first."""
    chain = [(1, k, "t", True, 1.0, None, k * 10.0, 0.0, k * 10.0 + 15, 10.0) for k in range(14)]
    pile = [(2, k, "t", True, 1.0, None, 0.0, 0.0, 50.0, 10.0) for k in range(500)]
    df = spark.createDataFrame(chain + pile, "scene int, priority int, text string, visible boolean, alpha double, declutter boolean, bl double, bt double, br double, bb double")
    assert {(x.scene, x.priority) for x in scene.declutter(df).collect()} == {(1, k) for k in range(0, 14, 2)} | {(2, 0)}
    assert scene.declutter(df.limit(0)).count() == 0
