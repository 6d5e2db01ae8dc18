"""Substring, suffix-array, SimHash and line dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import graph, lines, simhash, substring, suffix

LAST = (1 << 63) - 1


def order(d):
    return LAST if d is None else d


def found(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_substring_matches_brute_force(corpus):
    rows, df = corpus
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, LAST), order(d))
    expected = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < order(d):
                gone.update(range(k, k + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert found(substring.deduplicate(df), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(expected, key=repr)


def test_suffix_matches_brute_force(corpus):
    rows, df = corpus
    at = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 99):
            at.setdefault(b[k : k + 100], set()).add((order(d), t, k))
    expected = []
    for d, t in rows:
        b, gone = (t or "").encode(), np.zeros(0, bool)
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 99):
            if any(o < order(d) or (o == order(d) and u == t and j < k) for o, u, j in at[b[k : k + 100]]):
                gone[k : k + 100] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        expected.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    for hot in (suffix.HOT, 2):  # few occurrences already send an anchor's windows by their own hash
        assert found(suffix.deduplicate(df, hot=hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)


def test_merged_transforms_equal_one_sort():
    r = np.random.default_rng(3)
    rows = r.integers(97, 99, (60, 144)).astype(np.uint8)
    rows[30:] = rows[:30]
    rows[40:, 10] ^= 3
    lo, hi = np.zeros(60, np.int64), np.full(60, 144)
    row, offset, interval = suffix.repeated_windows(rows, lo, hi, np.arange(60) % 4)
    got = {}
    for i, o, k in zip(row.tolist(), offset.tolist(), interval.tolist()):
        got.setdefault(k, set()).add((i, o))
    expected = {}
    for i in range(60):
        for o in range(45):
            expected.setdefault(rows[i, o : o + 100].tobytes(), set()).add((i, o))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def test_common_prefixes_are_exact():
    r = np.random.default_rng(5)
    rows = r.integers(97, 99, (24, 144)).astype(np.uint8)
    rows[12:, :] = rows[:12]
    rows[12:, 60] ^= 1
    orders, transforms = [], []
    for s in range(3):
        own = np.arange(24)[np.arange(24) % 3 == s]
        o = suffix.sort_rotations(rows[own], suffix.DEPTH)
        transforms.append(suffix.transform(o, rows[own]))
        orders.append(own[o // 144] * 144 + o % 144)
    interleave, parted = suffix.merge_transforms(transforms, suffix.DEPTH)
    merged = np.empty(24 * 144, np.int64)
    merged[suffix.dealt(interleave)] = np.concatenate(orders)
    got = suffix.common_prefixes(rows, merged // 144, merged % 144, parted, suffix.DEPTH)
    turned = [np.roll(rows[m // 144], -(m % 144)).tobytes()[: suffix.DEPTH] for m in merged.tolist()]
    assert turned == sorted(turned)
    for i in range(1, len(turned)):
        a, b = turned[i - 1], turned[i]
        assert got[i] == next((k for k in range(len(a)) if a[k] != b[k]), len(a))


def test_dealing_by_digits():
    r = np.random.default_rng(6)
    x = r.integers(0, 1 << 20, 5000).astype(np.uint32)
    assert suffix.dealt(x).tolist() == np.argsort(x, kind="stable").tolist()


def test_one_anchor_with_many_surroundings(spark):
    """A heading before 100,000 different texts: no task holds all its surroundings."""
    head = "A fixed heading of well over one hundred bytes that stands before each and every document of this small collection here. "
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(head), F.md5(F.col("id").cast("string")), F.md5((F.col("id") + 7).cast("string"))).alias("text"))
    got = suffix.deduplicate(df.repartition(4)).groupBy("n_removed", "n_spans").count().collect()
    assert sorted((r["n_removed"], r["n_spans"], r["count"]) for r in got)[0] == (0, 0, 1)
    # Chance lets a few texts share the first byte or two after the heading as well.
    assert all(r["n_removed"] == 0 or len(head) <= r["n_removed"] <= len(head) + 8 for r in got) and sum(r["count"] for r in got) == 100_000


def test_long_text_of_one_letter(spark):
    """Four megabytes, nearly every byte an anchor, in bounded memory."""
    import resource

    data = suffix.Bytes(["A" * 4_000_000])
    h, at, doc = data.anchors()
    assert len(h) > 3_000_000
    df = spark.createDataFrame([(1, "A" * 4_000_000), (2, "A" * 1_000_000 + "B"), (3, "C" * 99)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.deduplicate(df).collect()}
    assert got == {1: (3_999_999, 1), 2: (1_000_000, 1), 3: (0, 0)}
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 3_000_000


def slow_print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_is_xxh64_majority(spark):
    for t in (None, "", "One", "two Words", "A b c D e f", "ÄÖ x y " * 9):
        assert simhash.fingerprint(t) == slow_print(t)
    native = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def closure(prints):
    root = {p: p for p in prints}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash_components(corpus):
    rows, df = corpus
    prints = {t: slow_print(t) for _, t in rows}
    root = closure(set(prints.values()))
    low = {}
    for d, t in rows:
        r = root[prints[t]]
        low[r] = min(low.get(r, LAST), order(d))
    expected = sorted(((d, f"{prints[t]:016x}", None if low[root[prints[t]]] == LAST else low[root[prints[t]]]) for d, t in rows), key=repr)
    assert found(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == expected


def test_keep_one_keeps_columns_and_one_row_of_each(corpus):
    rows, df = corpus
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    prints = [slow_print(r["text"]) for r in kept.collect()]
    root = closure({slow_print(t) for _, t in rows})
    assert len(prints) == len(set(root.values())) == len({root[p] for p in prints})


def test_covering_code_finds_every_link():
    r = random.Random(5)
    x = np.array([r.getrandbits(64) for _ in range(400)], np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for _ in range(i % 3):
            y[i] ^= np.uint64(1 << r.randrange(64))
    home, _, _ = simhash.anchors(x)
    _, place, own = simhash.anchors(y)
    assert all(home[i] in place[own == i] for i in range(len(x)))


@pytest.mark.parametrize("shape", ["chain", "star", "none"])
def test_components(spark, shape):
    edges = {"chain": [(i, i + 1) for i in range(30)], "star": [(99, i) for i in range(30)], "none": []}[shape]
    got = {r["vertex"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    vertices = {x for e in edges for x in e}
    assert got == {v: min(vertices) for v in vertices if v != min(vertices)}


def test_line_dedup(spark):
    block = "this line has words\nand this one also"
    rows = [(1, f"first head line here\n{block}\ntail one is here"), (2, f"second head line here\n{block}\ntail two is here"), (3, f"{block}"), (4, "a b\nunlike any other line"), (5, "a b\nagain an own line"), (6, None), (7, ""), (2, f"second head line here\n{block}\ntail two is here")]
    df = spark.createDataFrame([(d, t, -1, "x") for d, t in rows], "doc_id long, text string, n_chars long, key string").repartition(3)
    kept = {(d, t): t for d, t in rows}
    kept[rows[1]], kept[rows[2]] = "second head line here\ntail two is here", ""
    got = found(lines.rewrite(df), "doc_id", "text")
    assert got == sorted(((d, kept[d, t]) for d, t in rows), key=repr)
    assert lines.rewrite(df).columns == df.columns
    counts = {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in lines.deduplicate(df).collect()}
    assert (2, 4, 2) in counts and (3, 2, 2) in counts and (4, 2, 0) in counts and (6, 0, 0) in counts


def test_copies_in_any_number_lose_their_lines(spark):
    text = "\n".join(f"line number {i} of the text" for i in range(5))
    df = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string")
    assert sorted((r["doc_id"] == 0, r["n_removed"]) for r in lines.deduplicate(df).collect()) == [(False, 5)] * 59 + [(True, 0)]


def test_empty_tables(empty):
    for df in (substring.deduplicate(empty), suffix.deduplicate(empty), simhash.near_duplicates(empty), simhash.keep_one(empty), lines.deduplicate(empty), lines.rewrite(empty)):
        assert df.count() == 0


def test_very_long_texts(spark):
    r = random.Random(31)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(600_000))
    rows = [(1, long), (2, long[:100_000] + " own end"), (3, None), (4, "x " * 200_000), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring.deduplicate(df).collect()}
    head = len(long[:100_000].rsplit(" ", 1)[0].split())
    assert got[1] == (600_000, 0) and got[5] == (600_000, 600_000) and got[3] == (0, 0) and got[4] == (200_000, 0)
    assert head <= got[2][1] <= head + 1
    marked = {x["doc_id"]: x for x in simhash.near_duplicates(df).collect()}
    assert marked[1]["component_id"] == marked[5]["component_id"] == 1
    assert marked[4]["fingerprint"] == f"{slow_print('x ' * 5):016x}"
