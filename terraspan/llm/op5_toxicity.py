"""Operator 5: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of hits in a lexicon (weighted, distinct, largest number
in a window), hits near second-person words, capitals, punctuation, and obfuscation rates
(symbols or digits inside words, stretched characters). The lexicon is learned from labelled
rows, since insults differ by language and time: words and word beginnings of 4 to 8
characters that toxic texts have far more often. Labels, language, source and id are never
inputs of a score.

Learning reads a bounded sample: of the labelled rows allowed for training, the
``SAMPLE_ROWS`` first in a seeded digest's order, equal texts once. Lexicon counts and features run on the
executors; what comes to the driver is the entries that enough toxic texts of the sample
have, and at most SAMPLE_ROWS feature vectors. Two folds keep the trees honest: a row's training features come
from the other fold's lexicon, and the calibration sees predictions of trees that haven't
seen the row. Scoring is one pass over all texts, without a shuffle.

Defined cases: null and empty texts have the features of an empty text; labels that are
null, or rows of ``labels`` without a document, are not used; a document labelled twice with
different labels counts as toxic; without both classes among the training rows every score
is the share of toxic rows (0 without rows), held below the threshold; empty tables give no
rows; extra columns are ignored, or carried along by ``accept``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, release, table, text_or_empty

THRESHOLD = 0.7
#: Labelled rows that learning may read.
SAMPLE_ROWS = 12_000
#: Least toxic texts with an entry (and this share of them), and least smoothed log odds.
LEAST_TEXTS, LEAST_SHARE, LEAST_WEIGHT = 3, 0.004, 2.0
TREES, DEPTH, BIN_COUNT, RATE, LEAF = 60, 3, 32, 0.2, 5
WINDOW, NEAR = 50, 5

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros su".split())
#: Common insults.
SEED_LEXICON = frozenset("idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown jerk fool imbecile blödmann dummkopf abschaum verlierer crétin imbécile ordure salaud idiota estúpido basura imbécil".split())

WORD = re.compile(r"[^\W_]+")
CAPS = re.compile(r"\b[^\W\d_a-zà-ÿ]{2,}\b")
OBFUSCATED = re.compile(rb"[A-Za-z][0-9@$!*#%&]+[A-Za-z]")
STRETCHED = re.compile(rb"([A-Za-z!?.])\1\1")
UPPER = bytes(range(65, 91))
MARKS = b"!?"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in MARKS)
N_FEATURES = 18


def entries(word: str) -> Iterator[str]:
    """The lexicon entries that a lower-case word could match: itself, and its beginnings."""
    yield "=" + word
    for k in range(4, min(8, len(word)) + 1):
        yield word[:k]


class Lexicon:
    """Weights by entry, with a gate on the first four characters that most words fail."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.gate = {e.lstrip("=")[:4] for e in weights}

    def weight(self, word: str) -> float:
        return max((self.weights.get(e, 0.0) for e in entries(word)), default=0.0)


def features(text: str, lexicon: Lexicon) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = WORD.findall(text.lower())
    n, size = max(1, len(words)), max(1, len(data))
    gate = lexicon.gate
    near, at, sums, most, distinct, seeds = [], [], 0.0, 0.0, set(), 0
    for i, w in [(i, w) for i, w in enumerate(words) if w[:4] in gate]:
        if weight := lexicon.weight(w):
            at.append(i)
            sums += weight
            most = max(most, weight)
            distinct.add(w)
    seeds = sum(w in SEED_LEXICON for w in words)
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    burst = close = 0
    if at:
        spots = np.array(at)
        burst = int((np.searchsorted(spots, spots + WINDOW) - np.arange(len(spots))).max())
        if second:
            near = np.array(second)
            right = np.searchsorted(near, spots)
            gap = np.minimum(np.abs(near[np.minimum(right, len(near) - 1)] - spots), np.abs(near[np.maximum(right - 1, 0)] - spots))
            close = int((gap <= NEAR).sum())
    share = lambda removed: (len(data) - len(data.translate(None, removed))) / size
    return [
        np.log1p(len(words)), np.log1p(len(at)), len(at) / n, sums / n, most, np.log1p(len(distinct)), len(distinct) / n, np.log1p(sums),
        burst, np.log1p(seeds), seeds / n, close / n, len(second) / n, share(UPPER), len(CAPS.findall(text)) / n, share(MARKS), share(PUNCTUATION),
        (len(OBFUSCATED.findall(data)) + len(STRETCHED.findall(data))) / n,
    ]


class Trees:
    """Boosted trees of fixed depth for the logistic loss, on features cut at quantiles."""

    def __init__(self):
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BIN_COUNT + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-score))
            tree, leaf = self._tree(binned, cuts, y - prob, prob * (1 - prob))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _tree(self, binned, cuts, g, h):
        """``(features, thresholds, leaf values)`` in heap order, and the rows' leaves."""
        inner = 2**DEPTH - 1
        which, limit = np.zeros(inner, dtype=int), np.full(inner, np.inf)
        node = np.zeros(len(g), dtype=int)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                k = len(c) + 1
                code = (node - first) * k + binned[:, f]
                gs, hs, ns = (np.bincount(code, v, width * k).reshape(width, k).cumsum(axis=1) for v in (g, h, np.ones(len(g))))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(nl < LEAF) | (nt - nl < LEAF)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                for j in np.flatnonzero(value > best + 1e-9):
                    best[j], which[first + j], limit[first + j] = value[j], f, c[top[j]]
            cut = np.array([np.searchsorted(cuts[which[n]], limit[n], side="left") if np.isfinite(limit[n]) else 1 << 30 for n in range(first, first + width)])
            j = node - first
            node = 2 * node + 1 + (binned[np.arange(len(g)), which[node]] > cut[j])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return (which, limit, RATE * gs / (hs + 1)), leaf

    def decide(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for which, limit, value in self.trees:
            node = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, which[node]] > limit[node])
            score += value[node - (2**DEPTH - 1)]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone fit (pool adjacent violators); a step's level is smoothed by one row of each label over ten."""
    at, group, count = np.unique(score, return_inverse=True, return_counts=True)
    steps: list[list[float]] = []  # sum, count, first score, last score; equal scores are one from the start
    for s, v, n in zip(at.tolist(), np.bincount(group, y, len(at)).tolist(), count.tolist()):
        steps.append([v, n, s, s])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            last = steps.pop()
            steps[-1] = [steps[-1][0] + last[0], steps[-1][1] + last[1], steps[-1][2], last[3]]
    level = [(a + 0.1) / (n + 0.2) for a, n, *_ in steps]
    knots = [(s, v) for (_, _, a, b), v in zip(steps, np.maximum.accumulate(level)) for s in ((a, b) if b > a else (a,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    """A lexicon, trees and calibration; scores lists of texts."""

    def __init__(self, lexicon: Lexicon, trees: Trees | None, knots: tuple | None, prior: float):
        self.lexicon, self.trees, self.knots, self.prior = lexicon, trees, knots, prior

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        x = np.array([features(t, self.lexicon) for t in texts], dtype=float).reshape(len(texts), N_FEATURES)
        return np.clip(np.interp(self.trees.decide(x), *self.knots), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(text, y, fold)`` of the training sample, equal texts once."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y")).orderBy(F.md5(F.concat(F.lit("5|"), F.col("doc_id").cast("string"))), "doc_id").limit(rows)
    joined = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # SAMPLE_ROWS rows at most
    once = joined.withColumn("_sha", F.sha2("text", 256)).groupBy("_sha").agg(F.first("text").alias("text"), F.max("y").alias("y"))
    once = once.orderBy("_sha").limit(rows)  # ids that occur more than once may have brought more
    return once.select("text", "y", (F.conv(F.substring("_sha", 1, 4), 16, 10).cast("int") % 2).alias("fold"))


def _counted(wanted: frozenset | None):
    """Counts of texts with an entry by (entry, fold); all entries, or the wanted ones."""
    gate = None if wanted is None else {e.lstrip("=")[:4] for e in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys, values = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([f for _, f in keys], pa.int32()), pa.array(values, pa.int64())], names=["entry", "fold", "n"])

        for b in batches:
            for text, fold in zip(b.column("text").to_pylist(), b.column("fold").to_pylist()):
                words = {w for w in WORD.findall(text.lower()) if gate is None or w[:4] in gate}
                found = {e for w in words for e in entries(w)}
                counts.update((e, fold) for e in (found if wanted is None else found & wanted))
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    return run


def _lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> Lexicon:
    least = max(LEAST_TEXTS, LEAST_SHARE * n_toxic)
    weights = {}
    for e, a in toxic.items():
        if a >= least:
            b = clean.get(e, 0)
            weight = float(np.log((a + 0.5) / (n_toxic - a + 1)) - np.log((b + 0.5) / (n_clean - b + 1)))
            if weight >= LEAST_WEIGHT:
                weights[e] = weight
    return Lexicon(weights)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows outside ``held_out``."""
    sample = materialize(_sample(docs, labels, rows))
    size = {(r["y"], r["fold"]): r["count"] for r in sample.groupBy("y", "fold").count().collect()}
    total = {y: sum(size.get((y, f), 0) for f in (0, 1)) for y in (0, 1)}
    if min(total.values()) < 2 * LEAF:
        release(sample)
        share = total[1] / max(1, sum(total.values()))
        return Model(Lexicon({}), None, None, min(share, THRESHOLD - 0.01))
    schema = "entry string, fold int, n long"

    def counted(y: int, wanted: frozenset | None) -> DataFrame:
        return sample.filter(F.col("y") == y).mapInArrow(_counted(wanted), schema).groupBy("entry").agg(
            *(F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in (0, 1)))

    # what a lexicon of either fold or of both could take; the sample bounds it
    enough = F.greatest(*(F.col(f"n{f}") / max(LEAST_TEXTS, LEAST_SHARE * size.get((1, f), 0)) for f in (0, 1)), (F.col("n0") + F.col("n1")) / max(LEAST_TEXTS, LEAST_SHARE * total[1]))
    top = counted(1, None).filter(enough >= 1).collect()
    toxic = [{r["entry"]: r[f"n{f}"] for r in top} for f in (0, 1)]
    rest = counted(0, frozenset(toxic[0])).collect()
    clean = [{r["entry"]: r[f"n{f}"] for r in rest} for f in (0, 1)]
    by_fold = [_lexicon(toxic[f], clean[f], size.get((1, f), 0), size.get((0, f), 0)) for f in (0, 1)]
    whole = _lexicon(*({e: c[0].get(e, 0) + c[1].get(e, 0) for e in c[0] | c[1]} for c in (toxic, clean)), total[1], total[0])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t, by_fold[1 - f]) for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("fold"), pa.array(x, pa.list_(pa.float64()))], names=["y", "fold", "x"])

    got = sample.mapInArrow(vectors, "y int, fold int, x array<double>").toArrow()
    release(sample)
    x = np.array(got["x"].to_pylist(), dtype=float)
    y, fold = got["y"].to_numpy().astype(float), got["fold"].to_numpy()
    order = np.lexsort([*x.T, y, fold])  # the same model whatever the order in which rows arrive
    x, y, fold = x[order], y[order], fold[order]
    out_of_fold = np.zeros(len(y))
    for f in (0, 1):
        out_of_fold[fold == f] = Trees().fit(x[fold != f], y[fold != f]).decide(x[fold == f])
    return Model(whole, Trees().fit(x, y), isotonic(out_of_fold, y), total[1] / sum(total.values()))


def _scores(docs: DataFrame, model: Model, keep: list[str], name: str = "_score") -> DataFrame:
    source = fresh(docs, "_scored_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score(b.column(source).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got, pa.float64())], names=[*keep, name])

    given = docs.select(*keep, text_or_empty().alias(source))
    schema = docs.select(*keep).schema.add(name, "double")
    return given.mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    name = fresh(docs, "_score")
    return _scores(docs, model, docs.columns, name).filter(F.col(name) < THRESHOLD).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return _scores(docs, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
