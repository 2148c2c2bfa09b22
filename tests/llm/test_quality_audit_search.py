"""Operators 11 to 13 against plain Python over the same rows, and their defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fixtures import AWKWARD, documents, words
from terraspan.llm import op11_quality, op12_divergence, op13_lexical, terms

BLANK, LETTERS, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(text):
    w = re.findall(BLANK, text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    "", " \n\t ", "a", "a a a a", "a b c a b c", "a b\x85c d e", "x\ny\nx\n\nx \n", "# $ % & <b> | *", "é ß 漢字 é ß 漢字 é", "a b c d a b c e a b d", "A B C a b c", "w\x0bv\x0cu\rt",
    words(400, 1, 6), words(3000, 2, 40), "\n".join(words(5, s % 4) for s in range(50)),
]


def test_counts_of_a_text():
    for t in TEXTS:
        assert op11_quality.measured(t.encode()) == plain_counts(t), t


def test_counts_where_three_words_leave_64_bits():
    ids = np.array([5, 6, 7, 5, 6, 7, 1 << 21, 3, 5, 6], dtype=np.int64)
    assert op11_quality.repeated_words(ids, 1 << 22) == 6


def test_pieces_cut_no_word(monkeypatch):
    text = words(500, 3).encode() + b"\n\n  " + b"x" * 300 + b" \t end "
    for size in (1, 7, 64, 1 << 20):
        assert [w for p in terms.pieces(text, size) for w in p] == text.split()
    monkeypatch.setattr(terms, "PIECE", 16)
    assert op11_quality.measured(text) == plain_counts(text.decode())


def plain_verdicts(rows):
    """``(doc_id, host, counts)`` rows to ``(base_failed, kept)``, rates by plain floats."""
    fails, hosts = [], {}
    for _, host, (n, chars, symbols, lines, dup, rep) in rows:
        f = {"short": n < 50, "repeats": 100 * rep > 50 * n, "symbols": 100 * symbols > 10 * n, "dup_lines": 100 * dup > 30 * lines, "word_length": 10 * chars < 25 * n or 10 * chars > 120 * n}
        f["any"] = any(f.values())
        fails.append(f)
        hosts.setdefault(host, []).append(f)
    rate = {}
    for r in op11_quality.RULES:
        n, h = len(rows), len(hosts)
        m = sum(f[r] for f in fails) / n
        s = sum(len(x) * (sum(f[r] for f in x) / len(x) - m) ** 2 for x in hosts.values()) / n
        excess = s - m * (1 - m) * h / n
        strength = 0 if h == 1 else min(1e6, max(2, (m * (1 - m) - s) / excess)) if excess > 1e-9 else 1e6
        for host, x in hosts.items():
            rate[host, r] = (sum(f[r] for f in x) + strength * m) / (len(x) + strength)
    out = []
    for (_, host, _), f in zip(rows, fails):
        base = f["short"] or f["repeats"]
        out.append((base, not base and rate[host, "any"] < 0.8 and not any(f[r] and rate[host, r] >= 0.4 for r in op11_quality.SOFT)))
    return out


def test_hosts_against_plain_verdicts(spark):
    """A host of junk is rejected, its few sound documents too; a soft rule binds where most of a host breaks it; one odd document at a sound host stays."""
    docs, at = [], iter(range(10_000))
    symbols = lambda s: " ".join(f"# {w}" for w in words(60, s).split())
    for s in range(120):
        docs.append((next(at), words(80, s), "sound"))
        docs.append((next(at), words(5, s) if s % 12 else words(80, s), "junk"))
        docs.append((next(at), symbols(s) if s % 2 else words(80, s), "symbols"))
    docs += [(next(at), symbols(999), "sound"), (next(at), words(5, 1), "small"), (next(at), None, None), (next(at), words(70, 5), None)]
    got = {r.doc_id: r for r in op11_quality.judged(documents(spark, docs, clash=True)).collect()}
    want = plain_verdicts([(i, s, plain_counts(t or "")) for i, t, s in docs])
    assert [(got[i].base_failed, got[i].kept) for i, _, _ in docs] == want
    kept = Counter((s, got[i].kept) for i, _, s in docs)
    assert not kept["junk", True] and kept["symbols", False] == 60 and kept["sound", True] == 121
    accepted = op11_quality.accept(documents(spark, docs, clash=True))
    assert accepted.columns == documents(spark, docs, clash=True).columns and {r.doc_id for r in accepted.collect()} == {i for i, r in got.items() if r.kept}


def test_one_host_has_its_own_rate(spark):
    docs = documents(spark, [(k, words(5 if k % 4 else 80, k), "only") for k in range(40)])
    assert {round(r.host_rate, 6) for r in op11_quality.judged(docs).collect()} == {0.75}


def plain_audit(rows, least, top):
    groups, within, out = {}, {}, set()
    for lang, source, text in rows:
        w = re.findall(LETTERS, (text or "").translate(LOWER))
        groups.setdefault((lang or "", source or ""), Counter()).update(w)
        within.setdefault(lang or "", Counter()).update(set(w))
    for lang in within:
        kept = sorted(t for t, d in within[lang].items() if d >= least)
        of = {s: c for (g, s), c in groups.items() if g == lang}
        all_ = sum(of.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in of.items()}, share(all_)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in of:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in of if o != s)
            named = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if of[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)} | {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(named)}
    return out


def audited(spark, rows):
    df = spark.createDataFrame([(k, t, g, s, 0) for k, (g, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return [tuple(r) for r in op12_divergence.audit(df).collect()]


@pytest.mark.parametrize("slice_, block, wave, held", [(1 << 18, 8, 16, 1 << 18), (40, 2, 2, 5), (7, 1, 3, 1)])
def test_audit_against_brute_force(spark, monkeypatch, slice_, block, wave, held):
    """Also cut into many slices, blocks and waves, and with a language that keeps no term, a single source and nulls."""
    for name, value in (("SLICE", slice_), ("BLOCK", block), ("WAVE", wave), ("HELD", held)):
        monkeypatch.setattr(op12_divergence, name, value)
    r = random.Random(3)
    rows = [("en", f"s{r.randrange(9)}", words(60, k, 50) + (" É Ünter ßß" if k % 3 else "")) for k in range(150)]
    rows += [("fr", "only", words(30, k, 20)) for k in range(12)] + [("xx", s, "few words") for s in "abc"] + [(None, None, None), ("en", None, ""), ("en", "empty", None)] + rows[:5] * 3
    rows = [(g, s, t and re.sub("[0-9]", lambda m: "abcdefghij"[int(m[0])], t)) for g, s, t in rows]
    got = audited(spark, rows)
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, op12_divergence.LEAST_DOCS, op12_divergence.TOP)


@pytest.mark.parametrize("blocks", range(1, 10))
def test_tournament_meets_each_pair_once(spark, blocks):
    from pyspark.sql import functions as F

    made = spark.range(blocks).select(F.col("id").cast("int").alias("b")).select("b", F.explode(op12_divergence.meetings(F.lit(blocks), F.col("b"), 0, 99)).alias("m")).collect()
    met = [(tuple(sorted((r.b, r.m.home))), r.m.round) for r in made if r.m.round >= 0]
    assert len(met) == blocks * (blocks - 1) // 2 == len({p for p, _ in met})
    for turn in {t for _, t in met}:  # a block meets one other in a round
        busy = [x for p, t in met if t == turn for x in p]
        assert len(busy) == len(set(busy))
    hosts = Counter(r.m.home for r in made if r.m.round >= 0)
    assert max(hosts.values(), default=0) <= blocks // 2 + 1


def plain_search(docs, items, top):
    held = [(i, Counter(re.findall(ALNUM, (t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        asked, found = re.findall(ALNUM, (text or "").translate(LOWER)), []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment, window, items_, vocabulary", [(1 << 14, 1 << 12, 1024, 1 << 23), (50, 64, 2, 0), (200, 64, 3, 1 << 23)])
def test_search_against_brute_force(spark, monkeypatch, segment, window, items_, vocabulary):
    """Also in small segments, windows and blocks of items, and with all terms indexed; ties, copies, null ids and repeated terms."""
    for name, value in (("SEGMENT", segment), ("WINDOW", window), ("ITEMS", items_)):
        monkeypatch.setattr(op13_lexical, name, value)
    docs = [(k * 7 % 400, words(20 + k % 50, k % 150, 80) + (" Été" if k % 5 == 0 else "")) for k in range(400)] + AWKWARD + [(None, words(30, 2))]
    items = [(k, words(8, k + 500, 80)) for k in range(6)] + [(2, words(8, 502, 80)), (3, "w1 w1 w1 W2, été"), (7, None), (8, "nowhere"), (9, "w1-w2"), (10, "one two")]
    found = op13_lexical.search(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), vocabulary_bytes=vocabulary)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(docs, items, 10)


def test_search_survives_large_norms():
    p = op13_lexical._Postings([1, 2], np.array([1 << 40, 5]), 1 << 30, 1 << 50)
    assert p.norm.tolist() == [25 + 75 * (1 << 40) * (1 << 30) // (1 << 50), 25 + 75 * 5 * (1 << 30) // (1 << 50)]


def test_shares_of_huge_counts(spark):
    from pyspark.sql import functions as F

    n, total, kept = 4 * 10**15, 9 * 10**15, 10**8
    got = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").select(op12_divergence._share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
