"""Features, weights and the exact draw against plain counting and sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tallyspark.llm import resample

WORD, LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return w, [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def order(row):
    return tuple((x is None, x or 0) for x in row)


def brute(docs, target, percent=25, least=20):
    s, t, own = Counter(), Counter(), []
    for d, text in docs:
        w, b = features(text)
        s.update(b)
        own.append((d, len(w), b))
    for text in target:
        t.update(features(text)[1])
    total, wanted = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * wanted))) for b in s}
    out = []
    for d, n, b in own:
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=order)


def test_features():
    r = random.Random(3)
    texts = ["", None] + ["".join(r.choice(["a", "B", "é", "日本", "1", " ", "  ", "_", "`", "x" * 60, "Q" * 49, "k" * 48, "k" * 47, "İ"]) for _ in range(r.randint(0, 25))) for _ in range(300)]
    bucket, text, n = resample.features(pa.array(texts).fill_null("").slice(1, 280))
    for i, t in enumerate(texts[1:281]):
        words, expected = features(t)
        assert n[i] == len(words) and sorted(bucket[text == i].tolist()) == sorted(expected)
    assert [len(x) for x in resample.features(pa.array([], pa.string()))] == [0, 0, 0]


def test_documents(spark, corpus, empty):
    rows, df = corpus
    target = spark.createDataFrame([("alpha beta gamma delta of the",), (None,), ("zeta eta " * 30,)], "text string")
    texts = [r[0] for r in target.collect()]
    for percent, least in ((25, 20), (100, 1), (0, 1), (40, 0)):
        got = sorted((tuple(r) for r in resample.resample(df, target, percent, least).collect()), key=order)
        assert got == brute(rows, texts, percent, least), (percent, least)
    assert resample.resample(empty, target).count() == 0
    assert resample.resample(df, target.limit(0)).count() == len(rows)


def test_a_hot_repeated_row_and_narrow_ranges(spark, monkeypatch):
    """A third of the rows are one row; ranges hold few rows, blocks fewer."""
    monkeypatch.setattr(resample, "BLOCK", 3)
    rows = [(i % 400, f"w{i % 400} " * 21) for i in range(800)] + [(5, "same words over " * 9)] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([("same words",)], "text string")
    got = sorted((tuple(r) for r in resample.resample(df, target).collect()), key=order)
    assert got == brute(rows, ["same words"])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 301))


def test_tournament_merges_blocks_as_they_come():
    r = random.Random(6)
    runs = [sorted(r.randrange(50) for _ in range(r.randint(1, 30))) for _ in range(20)]
    blocks = sorted((run[i : i + 4] for run in runs for i in range(0, len(run), 4)), key=lambda b: b[0])
    got = [k for k, _ in resample.merged(iter([(b, b) for b in blocks]))]
    assert got == sorted(x for run in runs for x in run)
    assert list(resample.merged(iter([]))) == []


@pytest.mark.parametrize(("take", "size", "expected"), [(5, 100, [(7, 9, 0)]), (3, 1, [(9, 9, 0), (8, 8, 2)]), (0, 5, []), (99, 2, [(9, 9, 0), (8, 8, 2), (7, 7, 4)])])
def test_ranges_of_scores(take, size, expected):
    assert resample._ranges([(9, 2), (8, 2), (7, 3)], take, size) == expected
