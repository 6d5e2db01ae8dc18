"""The audit against plain counting, its rounds, and exact shares."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import divergence

TERM, LOW = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top=50):
    counts, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOW))
        langs[lang].add(source)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found)) if part == "pair" or i < top]
    return sorted(out)


def documents(seed=2):
    r = random.Random(seed)
    words = ["alpha", "Beta", "γάμμα", "delta", "É", "é", "x", "日本"]
    say = lambda: " ".join(r.choice(words) + r.choice(["", "", chr(97 + r.randrange(26))]) for _ in range(r.randint(0, 30)))
    rows = [(say(), r.choice(["en", "fr", None]), f"s{r.randrange(11)}") for _ in range(400)]
    rows += [("hot words of one source " * 3, "en", "s0")] * 200
    rows += [(None, "en", "silent"), ("", "", "empty"), ("1 2 3", "de", "digits"), ("rare", "de", None), ("word " * 5000, "fr", "long"), (None, None, None)]
    return rows


@pytest.mark.parametrize(("least", "cells"), [(30, 8), (1, 2), (5, 4), (10_000, 8)])
def test_audit(spark, least, cells):
    rows = documents()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, block string").repartition(6)
    got = [tuple(r) for r in divergence.audit(df, least, cells).collect()]
    assert sorted(got) == brute(rows, least)


def test_small_flushes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "BLOCK", 7)
    rows = documents(3)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(df, 2).collect()) == brute(rows, 2)
    assert divergence.audit(df.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [2, 4, 8, 14])
def test_every_two_cells_meet_once(cells):
    met = Counter(frozenset(p) for pairs in divergence.rounds(cells) for p in pairs)
    assert len(met) == cells * (cells - 1) // 2 and set(met.values()) == {1}
    assert all(len({x for p in pairs for x in p}) == cells for pairs in divergence.rounds(cells))


def test_residents_are_exchanged_once(spark):
    rows = [("en", b, f"s{c}", 1, 1, 1, divergence._packed(np.array([0]), np.array([1])), None, 1, 1, c) for b in range(3) for c in range(4)]
    kind = divergence.VECTOR + ", total long, v long, cell int"
    placed = spark.createDataFrame(rows, kind).repartition(3).select("*")
    words = len(b"w").to_bytes(8, "little") + __import__("pyarrow").compress(b"w", codec="zstd", asbytes=True)
    whole = spark.createDataFrame([("en", b, None, 1, 1, 4, divergence._packed(np.array([0]), np.array([4])), words, 4, 1) for b in range(3)], divergence.VECTOR + ", total long, v long")
    met = divergence.meetings(placed, whole, 4)
    assert len(met.collect()) == 3 * 12  # all pairs, both ways, on three blocks; no term leads
    assert met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("ReusedExchange") >= 3


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randrange(1, 10 ** r.randint(1, 15))
        count, terms = r.randrange(0, total + 1), r.randrange(1, 10**6)
        assert divergence.shares(np.array([count]), total, terms)[0] == 1 + 10**9 * (count + 5) // (total + 5 * terms)
    with pytest.raises(OverflowError):
        divergence.shares(np.array([1]), 10**16, 1)
