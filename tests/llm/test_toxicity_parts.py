"""The parts of operator 5 against their definitions, by plain loops."""

import math
import random
import re

import numpy as np
import pytest

from terraspan.llm import op5_toxicity as op5


def plain_features(text, weights):
    """Every feature by its meaning, a word and a character at a time."""
    words = re.findall(r"[^\W_]+", text.lower())
    data = text.encode()
    n, size = max(1, len(words)), max(1, len(data))
    weight = lambda w: max([weights.get("=" + w, 0.0)] + [weights.get(w[:k], 0.0) for k in range(4, min(8, len(w)) + 1)])
    hits = [(i, w) for i, w in enumerate(words) if weight(w) > 0]
    second = [i for i, w in enumerate(words) if w in op5.SECOND_PERSON]
    burst = max((sum(i <= j < i + op5.WINDOW for j, _ in hits) for i, _ in hits), default=0)
    close = sum(any(abs(i - s) <= op5.NEAR for s in second) for i, _ in hits)
    sums, seeds, distinct = sum(weight(w) for _, w in hits), sum(w in op5.SEED_LEXICON for w in words), len({w for _, w in hits})
    caps = len(re.findall(r"\b[^\W\d_a-zà-ÿ]{2,}\b", text))
    odd = len(re.findall(rb"[A-Za-z][0-9@$!*#%&]+[A-Za-z]", data)) + len(re.findall(rb"([A-Za-z!?.])\1\1", data))
    count = lambda keep: sum(keep(chr(b)) for b in data) / size
    return [
        math.log1p(len(words)), math.log1p(len(hits)), len(hits) / n, sums / n, max((weight(w) for _, w in hits), default=0.0), math.log1p(distinct), distinct / n, math.log1p(sums), burst, math.log1p(seeds), seeds / n,
        close / n, len(second) / n, count(lambda c: "A" <= c <= "Z"), caps / n, count(lambda c: c in "!?"), count(lambda c: 33 <= ord(c) < 127 and not c.isalnum() and c not in "!?"), odd / n,
    ]


def test_features():
    r = random.Random(8)
    weights = {"=scum": 3.0, "scum": 2.5, "blöd": 4.0, "=you": 2.0, "pathet": 2.2, "=xx": 5.0}
    stock = ["you", "YOU", "scum", "scummy", "Blödmann", "pathetic", "fine", "w0rd", "x!!!y", "XX", "xx", "é", "漢字", "a_b", "don't", "idiot", "???", "\n", "t@ke", "looool", "Ünter", "tu"]
    for k in range(200):
        text = " ".join(r.choice(stock) for _ in range(r.choice([0, 1, 5, 30, 200])))
        assert np.allclose(op5.features(text, op5.Lexicon(weights)), plain_features(text, weights)), text


def plain_tree(x, g, h, cuts, depth, rows):
    """The best split of each node by trying all, then the leaves' values; as nested tuples."""
    if depth == 0:
        return op5.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)
    best, gt, ht = (1e-9, 0, math.inf), sum(g[i] for i in rows), sum(h[i] for i in rows)
    for f, c in enumerate(cuts):
        for limit in c:
            left = [i for i in rows if x[i][f] <= limit]
            if op5.LEAF <= len(left) <= len(rows) - op5.LEAF:
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                if gain > best[0] + 1e-9:
                    best = gain, f, limit
    _, f, limit = best
    return f, limit, plain_tree(x, g, h, cuts, depth - 1, [i for i in rows if x[i][f] <= limit]), plain_tree(x, g, h, cuts, depth - 1, [i for i in rows if not x[i][f] <= limit])


def plain_decide(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("seed", range(3))
def test_trees(monkeypatch, seed):
    """Three rounds of boosting: each tree splits where an exhaustive search does, and the scores add up."""
    monkeypatch.setattr(op5, "TREES", 3)
    r = np.random.default_rng(seed)
    x = np.stack([r.normal(size=90), r.integers(0, 4, 90), r.normal(size=90), np.ones(90)], axis=1)
    y = ((x[:, 0] + x[:, 1] + 0.5 * r.normal(size=90)) > 1.5).astype(float)
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, op5.BIN_COUNT + 1)[1:-1]))) for c in x.T]
    base = math.log(y.mean() / (1 - y.mean()))
    score = [base] * len(y)
    for _ in range(3):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = plain_tree(x, [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p], cuts, op5.DEPTH, range(len(y)))
        score = [s + plain_decide(tree, row) for s, row in zip(score, x)]
    model = op5.Trees().fit(x, y)
    assert np.allclose(model.decide(x), score) and np.allclose(model.decide(x[:0]), [])


@pytest.mark.parametrize("seed", range(20))
def test_isotonic(seed):
    """The fit of a row is the largest, over beginnings before it, of the smallest mean up to an end after it; steps are smoothed."""
    r = random.Random(seed)
    score = sorted(r.choice([round(r.random(), 1), r.random()]) for _ in range(40))
    y = [int(r.random() < s) for s in score]
    values = sorted(set(score))
    groups = [[v for s, v in zip(score, y) if s == t] for t in values]
    mean = lambda a, b: sum(sum(g) for g in groups[a : b + 1]) / sum(len(g) for g in groups[a : b + 1])
    fit = [max(min(mean(a, b) for b in range(i, len(groups))) for a in range(i + 1)) for i in range(len(groups))]
    level = {}
    for v in sorted({round(f, 12) for f in fit}):
        rows = [x for f, g in zip(fit, groups) if round(f, 12) == v for x in g]
        level[v] = max([(sum(rows) + 0.1) / (len(rows) + 0.2), *level.values()])
    knots = op5.isotonic(np.array(score), np.array(y, dtype=float))
    assert np.allclose(np.interp(values, *knots), [level[round(f, 12)] for f in fit])
    assert (np.diff(knots[1]) >= 0).all() and (np.diff(knots[0]) > 0).all()
