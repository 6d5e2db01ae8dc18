"""Tokenization, token files and packing: exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import packing, tokenbin, words
from tallyspark.llm.queries import vocabulary
from tallyspark.llm.words import Encoder


def ids_of(name, text, end):
    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_encode_like_whole_texts(name, spaced):
    r = random.Random(3)
    parts = ["a", "Bé", " ", "\n", "\t", "0", "10", "'s", "　", "!", "́", "\x1c", "<|endoftext|>", "\x00", "Σ", "don't"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    whole = Tokenizer.from_file(vocabulary(name))
    whole.encode_special_tokens = True
    known = [e.ids + [5] for e in whole.encode_batch(texts, add_special_tokens=False)]
    for limit in (10**6, 50):
        encoder = Encoder(vocabulary(name), spaced, limit)
        for at in range(0, len(texts), 700):  # later parts meet known, forgotten and new units
            got = encoder.encode(pa.array(texts[at : at + 700], pa.string()), 5)
            assert [g.tolist() for g in got] == known[at : at + 700]


def test_token_files(corpus):
    rows, df = corpus
    got = [tuple(r) for r in tokenbin.token_records(df, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_crc32", "start").collect()]
    ids = [(d, ids_of("byte_bpe_50k.json", t, 0)) for d, t in rows]
    assert sorted((g[:3] for g in got), key=repr) == sorted(((d, len(i), crc(i)) for d, i in ids), key=repr)
    got.sort(key=lambda g: g[3])
    assert [g[3] for g in got] == np.cumsum([0] + [g[1] for g in got])[:-1].tolist()
    assert [g[0] for g in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))


def test_packing(corpus):
    rows, df = corpus
    got = packing.pack(df, vocabulary("word_bpe_49k.json"), capacity=64, grain=8, keep_ids=True).collect()
    assert sum(r["length"] for r in got) == sum(len(ids_of("word_bpe_49k.json", t, 1)) for _, t in rows)
    expected = sorted((str(d), k, crc(i[k : k + 64]), len(i)) for d, i in ((d, ids_of("word_bpe_49k.json", t, 1)) for d, t in rows) for k in range(0, len(i), 64))
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == expected
    of = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        of.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in of.values():
        places.sort()
        assert places[0][0] == 0 and sum(n for _, n in places) <= 64
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    filled = sum(r["length"] for r in got) / (64 * len(of))
    assert filled > 0.85


@pytest.mark.parametrize(("lengths", "slack"), [("long tail", 1.002), ("uniform", 1.06)])
def test_plan_meets_demand_near_the_bound(lengths, slack):
    """Uniform lengths up to the capacity leave the program far from converged; they
    bound what stopping early may cost."""
    r = random.Random(1)
    need = {}
    for _ in range(5000):
        n = r.randint(1, 2000) if lengths == "uniform" else int(r.lognormvariate(5.9, 1)) % 2048 + 1
        s = -(-n // 8) * 8
        need[s] = need.get(s, 0) + 1
    plan = packing.plan(need, 2048)
    made = {}
    for n, pattern in plan:
        assert sum(s * k for s, k in pattern.items()) <= 2048
        for s, k in pattern.items():
            made[s] = made.get(s, 0) + n * k
    assert made == need
    assert sum(n for n, _ in plan) <= slack * sum(s * n for s, n in need.items()) / 2048 + 2


def test_very_long_texts(spark):
    r = random.Random(11)
    long = " ".join("".join(r.choices("abcdé,", k=r.randint(1, 9))) for _ in range(750_000))
    rows = [(1, long), (2, "short"), (3, "x" * 30_000), (4, long[:5000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in tokenbin.token_records(df, vocabulary("byte_bpe_50k.json")).collect()}
    assert got == {d: (len(i), crc(i)) for d, i in ((d, ids_of("byte_bpe_50k.json", t, 0)) for d, t in rows)}
    packed = packing.pack(df, vocabulary("word_bpe_49k.json")).collect()
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packed} == {(d, k): crc(i[k : k + 2048]) for d, i in ((d, ids_of("word_bpe_49k.json", t, 1)) for d, t in rows) for k in range(0, len(i), 2048)}
    full = [r["sequence_id"] for r in packed if r["length"] == 2048]
    assert len(set(full)) == len(full) and not set(full) & {r["sequence_id"] for r in packed if r["length"] < 2048}


def test_short_pieces_share_a_place(spark):
    df = spark.createDataFrame([(i, "" if i % 3 else "a b") for i in range(5000)], "doc_id long, text string")
    got = packing.pack(df, vocabulary("word_bpe_49k.json")).collect()
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= total / 2048 * 1.4 + 1


def test_empty_tables(empty):
    assert tokenbin.token_records(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    assert packing.pack(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_rest_after_a_stem():
    """What follows a unit's stem is cut in one step, in slices and for any characters."""
    texts = ["", "word,", "\u00fcber!!", "x", "caf\u00e9...", "\u6f22\u5b57?"]
    size = [0, 4, 5, 1, 5, 6]
    expected = [t.encode()[n:].decode() for t, n in zip(texts, size)]
    whole = pa.array(texts, pa.string())
    for a in range(len(texts) + 1):
        assert words._after(whole.slice(a), np.array(size[a:], np.int64)).to_pylist() == expected[a:]
