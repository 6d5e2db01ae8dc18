"""The pipeline's near-duplicate stage against brute force."""

import random

import pytest

import corpus_pipeline as cp
from tallyspark.llm import graph, simhash, similar

LAST = (1 << 63) - 1


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    """Rows that stay: least (id, text) by id of each component of pairs at 0.8."""
    texts = sorted({t for _, t in rows}, key=repr)
    sets, root = {t: grams(t) for t in texts}, {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, t in enumerate(texts):
        for u in texts[:i]:
            a, b = sets[t], sets[u]
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(t)] = find(u)
    low = {}
    for d, t in rows:
        r = find(t)
        low[r] = min(low.get(r, LAST), LAST if d is None else d)
    return sorted(low.values())


def kept(df):
    return sorted(LAST if r["doc_id"] is None else r["doc_id"] for r in cp.dedup_documents(df.sparkSession, df, "").collect())


def test_corpus(corpus):
    rows, df = corpus
    assert kept(df) == expected(rows)
    assert cp.dedup_documents(df.sparkSession, df, "").columns == df.columns


@pytest.mark.parametrize("edits", [(0, 12), (2, 5)])
def test_edited_copies(spark, edits):
    """Copies of 200 words with single words replaced: similarities around 0.8."""
    r = random.Random(11)
    base = [[f"w{r.randint(0, 400)}" for _ in range(200)] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(base[i % len(base)])
        for _ in range(r.randint(*edits)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w[: len(w) - r.randint(0, 30)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert kept(df) == expected(rows)


def test_empty_table(empty):
    assert cp.dedup_documents(empty.sparkSession, empty, "").count() == 0


def edited(seed=3):
    """Long texts in versions of a few changed words, near in their fingerprints."""
    r = random.Random(seed)
    rows = []
    for k in range(8):
        w = [f"w{r.randint(0, 5000)}" for _ in range(1500)]
        for v in range(5):
            rows.append((10 * k + v, " ".join(w)))
            w[r.randrange(len(w))] = f"e{v}"
    return [*rows, (90, None), (91, ""), (92, "one"), (93, "one"), (94, "two")]


def test_fingerprint_pairs(spark):
    rows = edited()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ties = {r["doc_id"]: r["tie"] for r in simhash.fingerprints(df).collect()}
    roots = {r["vertex"]: r["root"] for r in graph.components(similar.fingerprint_pairs(df)[0]).collect()}
    prints = {ties[d]: simhash.fingerprint(t) for d, t in rows}
    root = {t: t for t in prints}
    for t in prints:
        for u in prints:
            if (prints[t] ^ prints[u]).bit_count() <= 2 and root[t] != root[u]:
                low, high = sorted((root[t], root[u]))
                root = {x: low if y == high else y for x, y in root.items()}
    assert {t: roots.get(t, t) for t in prints} == root


def test_simhash_links_without_prefixes(spark, monkeypatch):
    """Copies within two bits are linked by their fingerprints, before any prefix."""
    rows = edited()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(similar, "candidates", lambda heads, first: spark.createDataFrame([], "u long, v long"))
    left = kept(df)
    prints = {d: simhash.fingerprint(t) for d, t in rows}
    assert any((prints[10 * k] ^ prints[10 * k + v]).bit_count() in (1, 2) for k in range(8) for v in range(1, 5))
    for k in range(8):
        near = [10 * k + v for v in range(1, 5) if (prints[10 * k] ^ prints[10 * k + v]).bit_count() <= 2]
        assert 10 * k in left and not set(near) & set(left)
    assert {92, 94} <= set(left) and 93 not in left


def test_simhash_links_most_copies_at_the_similarity(spark, monkeypatch):
    """Copies just above 0.8, many bits apart, are linked by SimHash without any prefix."""
    r = random.Random(5)
    rows = []
    for k in range(60):
        w = [f"w{r.randint(0, 5000)}" for _ in range(300)]
        rows.append((2 * k, " ".join(w)))
        for at in range(20, 300, 50):
            w[at] = f"e{k}"
        rows.append((2 * k + 1, " ".join(w)))
    for k in range(60):
        a, b = grams(rows[2 * k][1]), grams(rows[2 * k + 1][1])
        assert 0.8 <= len(a & b) / len(a | b) < 0.83
    assert sum((simhash.fingerprint(rows[2 * k][1]) ^ simhash.fingerprint(rows[2 * k + 1][1])).bit_count() <= 2 for k in range(60)) < 10
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(similar, "candidates", lambda heads, first: spark.createDataFrame([], "u long, v long"))
    left = kept(df)
    assert {2 * k for k in range(60)} <= set(left) and len(left) - 60 <= 3


def test_wide_fingerprint():
    """Bits by majority over more than one sum of bytes; none without shingles."""
    import numpy as np

    from tallyspark.llm.words import M1, mix

    for n in (1, 254, 255, 256, 70_000):
        h = mix(np.arange(n, dtype=np.uint64))
        with np.errstate(over="ignore"):
            bits = np.hstack([np.unpackbits(mix(h + M1 * np.uint64(k)).view(np.uint8).reshape(n, 8), axis=1, bitorder="little") for k in range(1, 5)])
        assert np.array_equal(np.unpackbits(simhash.wide_fingerprint(h).view(np.uint8), bitorder="little"), bits.sum(axis=0, dtype=int) * 2 > n)
    assert not simhash.wide_fingerprint(np.empty(0, np.uint64)).any()


def test_wide_anchors():
    """Texts meet at an anchor of covering codes, not by equal bits: any error of up to 3
    bits in its 23-bit part and of one bit in a short part leaves the code word; a part
    covers all words by such balls, each once."""
    import numpy as np

    assert np.array_equal(np.unique(simhash._home(np.arange(1 << 23)), return_counts=True)[1], np.full(1 << 12, 1 << 11))
    short, counts = np.unique(simhash._short(), return_counts=True)
    assert len(short) == 16 and set(counts) == {8} and max(int(w ^ c).bit_count() for w, c in enumerate(simhash._short().tolist())) == 1
    # Zero is a code word in all parts: one flipped bit meets it at all anchors.
    bits = np.zeros((257, 256), np.uint8)
    bits[np.arange(256), np.arange(256)] = 1
    wide = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    for short in range(4):
        keys = simhash.wide_anchors(wide, short)
        assert keys.shape == (simhash.TABLES, 257) and (keys == keys[:, -1:]).all()
        assert len(np.unique(keys[:, 0])) == simhash.TABLES
    flipped = np.ones((1, 256), np.uint8)
    assert not (simhash.wide_anchors(np.packbits(flipped, axis=1, bitorder="little").view("<u8") & np.uint64(0x5555555555555555), 3) == keys[:, -1:]).any()
    assert [simhash.short_parts(n) for n in (0, 1 << 14, (1 << 14) + 1, 1 << 18, (1 << 18) + 1, 1 << 60)] == [0, 0, 1, 1, 2, 5]


def test_components_plans_stay_small(spark, monkeypatch):
    """No plan of the components or of the stage reads its edges a dozen times: large plans
    fill the driver's memory."""
    from tallyspark.llm import storage

    plans, write = [], storage.stage

    def stage(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().collectLeaves().size()))
        return write(df, name)

    monkeypatch.setattr(storage, "stage", stage)
    rows = edited()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert kept(df) == expected(rows)
    sizes = [n for name, n in plans if name == "components"]
    assert len(sizes) > 6 and max(sizes) <= 16


def test_wide_places():
    """Homes against replicas: in every table a fingerprint is replicated to the home of any
    other that differs from it in one of the table's bits, and to no anchor twice."""
    import numpy as np

    r = np.random.default_rng(3)
    bits = r.integers(0, 2, (12, 256)).astype(np.uint8)
    pack = lambda b: np.packbits(b, axis=1, bitorder="little").view("<u8")
    for short in (0, 1, 2):
        key, own, home = simhash.wide_places(pack(bits), short)
        tables = simhash.COVERED[short]
        assert np.bincount(own[home]).tolist() == [tables] * len(bits)
        held = [set(key[own == i].tolist()) for i in range(len(bits))]
        assert [len(h) for h in held] == np.bincount(own).tolist()
        for flip in range(0, 256, 5):
            moved = bits.copy()
            moved[:, flip] ^= 1
            k, o, at_home = simhash.wide_places(pack(moved), short)
            assert all(set(k[at_home & (o == i)].tolist()) <= held[i] for i in range(len(bits)))


@pytest.mark.parametrize("short", [1, 2])
def test_anchors_carry_the_links_at_larger_sizes(spark, monkeypatch, short):
    """At the anchors of 262,145 texts and of 4 million, copies just above 0.8 are linked
    without any prefix."""
    r = random.Random(9)
    rows = []
    for k in range(100):
        w = [f"w{r.randint(0, 5000)}" for _ in range(300)]
        rows.append((2 * k, " ".join(w)))
        for at in range(20, 300, 50):
            w[at] = f"e{k}"
        rows.append((2 * k + 1, " ".join(w)))
    for k in range(100):
        a, b = grams(rows[2 * k][1]), grams(rows[2 * k + 1][1])
        assert 0.8 <= len(a & b) / len(a | b) < 0.83
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(similar, "candidates", lambda heads, first: spark.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(simhash, "short_parts", lambda n: short)
    left = kept(df)
    assert {2 * k for k in range(100)} <= set(left) and len(left) - 100 <= 1


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_crowds_at_anchors(spark, monkeypatch, few):
    """Copies around 0.8, all near to each other in their fingerprints: as crowds and as pairs
    anchors give the same links, and crowds leave no row for each pair."""
    from tallyspark.llm import storage

    r = random.Random(21)
    base, rows, met, write = [f"w{r.randint(0, 5000)}" for _ in range(200)], [], [], storage.stage
    for i in range(150):
        w = list(base)
        for at in range(5 + r.randint(0, 9), 200, 34):
            w[at] = f"e{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))

    def stage(df, name):
        out = write(df, name)
        if name == "replica-meetings":
            met.append((out[0].where("anchor is null").count(), out[0].where("anchor is not null").count()))
        return out

    monkeypatch.setattr(storage, "stage", stage)
    monkeypatch.setattr(similar, "candidates", lambda heads, buckets: spark.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(similar, "FEW", few)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = kept(df)
    monkeypatch.undo()
    assert left == expected(rows) and len(left) > 1
    (pairs, members), each = met[0], simhash.COVERED[0] * 6
    assert (pairs == 0 and 0 < members <= len(rows) * each) if few == 0 else (members == 0 and pairs > 0)
