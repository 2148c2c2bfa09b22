"""Operator 11: quality rules that hosts answer for.

Every text is measured once (``features``: words, code points in words, symbols, repeated lines, words in
repeated 3-word windows). Two base rules reject a document by itself; three soft rules are only
evidence, since good texts break them too. A host is what a document's ``source`` names.

Host level: failures of each rule, and of any, are summed by host (partial sums, so a host
with a third of all rows costs a row a task). Each rule's rates get a beta prior from all hosts by moments,

    m = sum f / sum n,   s = sum (f - n m)^2 / n / sum n,   strength = (m (1 - m) - s) / (s - m (1 - m) H / sum n)

for H hosts with f failures among n documents, and a host's rate is shrunk to (f + strength m) / (n + strength),
so a host with few documents is judged by what hosts are like. Where rates differ no more than
chance makes them, the strength is MOST_STRENGTH. A host is ``rejected`` if its shrunk rate of failing any rule is REJECT
or more; a soft rule ``binds`` at a host where its shrunk rate is BIND or more.
Verdicts are joined back: a document goes if it fails a base rule, if its host is rejected, or if it fails a soft rule that binds at its host.

Sums over hosts are of whole numbers (rates in millionths), so the verdicts don't depend on the
order of rows. The table of hosts is broadcast only if its measured bytes allow, else both sides are shuffled and AQE
splits a hot host.

Defined cases: a null text is the empty text, it fails for shortness; null hosts are the host ''; rows with null or
equal ``doc_id`` are judged row by row; one host alone has its own rate; an empty table gives
no rows; extra columns are carried along by ``judged``, and one named like an added column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, table, with_columns
from .terms import pieces

#: Base rules: the fewest words, and the largest share of words in repeated windows, in hundredths.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Soft rules: symbols a hundred words, hundredths of lines that repeat an earlier one, code points a word in tenths.
MOST_SYMBOLS, MOST_DUP_LINES, WORD_TENTHS = 10, 30, (25, 120)
#: Shrunk rates from which a soft rule binds at a host, and from which a host is rejected.
BIND, REJECT = 0.4, 0.8
#: Bounds of the prior's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1_000_000.0

BASE = ("short", "repeats")
SOFT = ("symbols", "dup_lines", "word_length")
RULES = (*BASE, *SOFT, "any")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
MILLION = 1_000_000

#: Bytes that aren't counted as code points of words: blanks, and all but the first byte of a character.
_NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """How many of the words, given by the numbers 0 to ``distinct`` - 1, lie in a 3-word window that occurs at least twice."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:  # the product with a third word would leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


def measured(data: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    seen: dict[bytes, int] = {}
    parts = [np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words)) for words in pieces(data)]
    ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(ids), len(data.translate(None, _NOT_COUNTED)), len(data) - len(data.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(ids, len(seen))


def features(docs: DataFrame, *keep: Column, text: str = "text") -> DataFrame:
    """The columns ``keep`` and COUNTS, one row a document; no shuffle."""
    given = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("_text"))
    names = given.columns[:-1]
    schema = given.drop("_text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(zip(*(measured(t.as_py()) for t in b.column("_text")))) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), *(pa.array(c, pa.int64()) for c in made)], names=[*names, *COUNTS])

    return given.mapInArrow(run, schema)


def failures() -> dict[str, Column]:
    """Whether a row of COUNTS fails each of RULES, in whole numbers."""
    c = F.col
    out = {
        "short": c("n_words") < LEAST_WORDS,
        "repeats": 100 * c("n_repeat_words") > MOST_REPEATED * c("n_words"),
        "symbols": 100 * c("n_symbols") > MOST_SYMBOLS * c("n_words"),
        "dup_lines": 100 * c("n_dup_lines") > MOST_DUP_LINES * c("n_lines"),
        "word_length": (10 * c("word_chars") < WORD_TENTHS[0] * c("n_words")) | (10 * c("word_chars") > WORD_TENTHS[1] * c("n_words")),
    }
    any_ = out["short"]
    for r in RULES[1:-1]:
        any_ = any_ | out[r]
    return out | {"any": any_}


def host_verdicts(rows: DataFrame, host: str) -> DataFrame:
    """``(host, n_docs, rate_<rule>, binds_<soft rule>, rejected)`` for each host of rows with COUNTS; rates are the shrunk ones.

    The priors are one row of numbers, which the driver reads.
    """
    fails = failures()
    hosts = materialize(rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(fails[r].cast("long")).alias(f"_f_{r}") for r in RULES)))
    total, moments = F.sum("n_docs"), []
    for r in RULES:
        moments += [F.sum(f"_f_{r}").alias(f"_s_{r}"), F.sum(F.expr(f"cast(n_docs as decimal(38,0)) * ({MILLION} * _f_{r} div n_docs) * ({MILLION} * _f_{r} div n_docs)").cast("decimal(38,0)")).cast("double").alias(f"_q_{r}")]
    prior = hosts.agg(total.cast("double").alias("_n"), F.count(F.lit(1)).cast("double").alias("_h"), *moments)
    for r in RULES:
        mean = F.col(f"_s_{r}") / F.col("_n")
        prior = prior.withColumn(f"_m_{r}", mean).withColumn(f"_v_{r}", F.greatest(F.lit(0.0), F.col(f"_q_{r}") / F.col("_n") / float(MILLION) / float(MILLION) - F.col(f"_m_{r}") * F.col(f"_m_{r}")))
        chance = F.col(f"_m_{r}") * (1.0 - F.col(f"_m_{r}"))
        excess = F.col(f"_v_{r}") - chance * F.col("_h") / F.col("_n")
        strength = F.when(excess > 0, F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), (chance - F.col(f"_v_{r}")) / excess))).otherwise(F.lit(MOST_STRENGTH))
        prior = prior.withColumn(f"_w_{r}", F.when(F.col("_h") > 1, strength).otherwise(0.0))
    got = prior.select(*(f"_{k}_{r}" for r in RULES for k in "mw")).first()
    rate = lambda r: (F.col(f"_f_{r}") + F.lit((got[f"_w_{r}"] or 0.0) * (got[f"_m_{r}"] or 0.0))) / (F.col("n_docs") + F.lit(got[f"_w_{r}"] or 0.0))
    return hosts.select("host", "n_docs", *(rate(r).alias(f"rate_{r}") for r in RULES), *((rate(r) >= BIND).alias(f"binds_{r}") for r in SOFT), (rate("any") >= REJECT).alias("rejected"))


def judged(docs: DataFrame, host: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Every document with COUNTS, ``host_rate`` (of failing any rule, shrunk), ``base_failed`` and ``kept``.

    ``carry``: the input's columns to keep, all if not given. Measures are written once and read twice,
    but where the text itself is carried they are taken twice rather than writing texts.
    """
    return _joined(docs, host, docs.columns if carry is None else carry, lambda d, added: with_columns("_row", d, added))


def accept(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that ``judged`` keeps, with their own columns."""
    return _joined(docs, host, docs.columns, lambda d, added: d.filter(added["kept"]).select("_row.*"))


def _joined(docs: DataFrame, host: str, carry: list[str], finish) -> DataFrame:
    rows = features(docs, F.struct(*carry).alias("_row"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"))
    if "text" not in (c.lower() for c in carry):
        rows = materialize(rows)
    fails = failures()
    verdicts = materialize(host_verdicts(rows, "_host").withColumnsRenamed({"host": "_host", "rate_any": "_rate"}).drop("n_docs"))
    both = rows.join(maybe_broadcast(verdicts), "_host")
    base, bound = fails["short"] | fails["repeats"], F.lit(False)
    for r in SOFT:
        bound = bound | fails[r] & F.col(f"binds_{r}")
    return finish(both, {c: F.col(c) for c in COUNTS} | {"host_rate": F.col("_rate"), "base_failed": base, "kept": ~base & ~F.col("rejected") & ~bound})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, with ``source`` and its rate in millionths."""
    out = judged(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source", F.floor(F.col("host_rate") * 1e6 + 0.5).cast("long").alias("host_rate"))


def _sql() -> str:
    per_rule = lambda f: ", ".join(f(r) for r in RULES)
    cases = {
        "short": f"n_words < {LEAST_WORDS}", "repeats": f"100 * n_repeat_words > {MOST_REPEATED} * n_words", "symbols": f"100 * n_symbols > {MOST_SYMBOLS} * n_words",
        "dup_lines": f"100 * n_dup_lines > {MOST_DUP_LINES} * n_lines", "word_length": f"10 * word_chars < {WORD_TENTHS[0]} * n_words OR 10 * word_chars > {WORD_TENTHS[1]} * n_words",
    }
    cases["any"] = " OR ".join(f"({c})" for c in cases.values())
    strength = lambda r: f"""CASE WHEN h <= 1 THEN 0 WHEN v_{r} - m_{r} * (1 - m_{r}) * h / n > 0
      THEN least({MOST_STRENGTH}::DOUBLE, greatest({LEAST_STRENGTH}::DOUBLE, (m_{r} * (1 - m_{r}) - v_{r}) / (v_{r} - m_{r} * (1 - m_{r}) * h / n))) ELSE {MOST_STRENGTH}::DOUBLE END AS w_{r}"""  # noqa: E731
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT i, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d
), windows AS (SELECT i, j, w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] AS t FROM (SELECT i, w, unnest(range(1, len(w) - 1)) AS j FROM parts)
), twice AS (SELECT i, j FROM windows QUALIFY count(*) OVER (PARTITION BY i, t) > 1
), covered AS (SELECT i, count(DISTINCT j + k) AS n FROM twice, range(3) x(k) GROUP BY i
), f AS (
  SELECT p.i, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM parts p JOIN d ON d.i = p.i LEFT JOIN covered c ON c.i = p.i
), r AS (SELECT *, {", ".join(f"({c}) AS x_{r}" for r, c in cases.items())} FROM f
), hosts AS (SELECT source, count(*) AS n_docs, {per_rule(lambda r: f"count(*) FILTER (WHERE x_{r}) AS f_{r}")} FROM r GROUP BY source
), sums AS (SELECT sum(n_docs)::DOUBLE AS n, count(*)::DOUBLE AS h, {per_rule(lambda r: f"sum(f_{r})::DOUBLE AS s_{r}, sum(n_docs::HUGEINT * ({MILLION} * f_{r} // n_docs) * ({MILLION} * f_{r} // n_docs))::DOUBLE AS q_{r}")} FROM hosts
), means AS (SELECT *, {per_rule(lambda r: f"s_{r} / n AS m_{r}, greatest(0.0::DOUBLE, q_{r} / n / {MILLION}::DOUBLE / {MILLION}::DOUBLE - (s_{r} / n) * (s_{r} / n)) AS v_{r}")} FROM sums
), prior AS (SELECT *, {per_rule(strength)} FROM means
), verdicts AS (SELECT source, {per_rule(lambda r: f"(f_{r} + w_{r} * m_{r}) / (n_docs + w_{r}) AS rate_{r}")} FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (x_short OR x_repeats) AS base_failed,
  NOT (x_short OR x_repeats OR rate_any >= {REJECT} OR {" OR ".join(f"(x_{r} AND rate_{r} >= {BIND})" for r in SOFT)}) AS kept, r.source, floor(rate_any * 1e6 + 0.5)::BIGINT AS host_rate
FROM r JOIN verdicts v ON v.source = r.source
"""


#: The same in SQL.
SQL = _sql()
