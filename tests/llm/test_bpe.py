"""The transducer against the library, its lookahead, streams in any parts, decoding."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import bpe
from tallyspark.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
ODD = ["a", "b", "e", "th", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "　", "'s", "'", "'LL", "'re", "1", "23", "²", "Ⅻ", "é", "日本", "😀", "-", "=", "_", "<|endoftext|>", "<|endoftext", "՘", "\U0001e030", "\U00032000", "̀", "İ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(text):
    return np.frombuffer(b"".join(bpe.codec(PATH).encode(text)), "<u4").tolist()


def test_random_texts(library):
    r = random.Random(4)
    for _ in range(4000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 25)))
        got = ids(text)
        assert got == library.encode(text, add_special_tokens=False).ids, text
        back = bpe.Decoder(bpe.codec(PATH).table)
        assert back.push(got[:3]) + back.push(got[3:]) + back.finish() == library.decode(got, skip_special_tokens=False)


def test_letters_and_numbers_are_the_librarys(library):
    r = random.Random(1)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    codes = [c for c in codes if c < 0x3000 or unicodedata.category(chr(c)) == "Cn" and r.random() < 0.01 or r.random() < 0.01]
    text = "".join(f"\n.a{chr(c)} 1{chr(c)} !{chr(c)}" for c in codes)
    expected = [a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str(text)]
    assert [m.start() for m in bpe.codec(PATH).pattern.finditer(text)] == expected
    plain = [c for c in map(chr, codes) if c not in bpe._odd()]
    text = "".join(f"\n.a{c} 1{c} !{c}" for c in plain)
    assert [m.span() for m in bpe.PLAIN.finditer(text)] == [m.span() for m in bpe.codec(PATH).pattern.finditer(text)]


@pytest.mark.parametrize("text", ["a" * 90_000, " " * 70_001 + "x", "日本語" * 30_000, "=-" * 40_000, "x" * 66_000 + "<|endoftext|>" + "12" * 40_000 + " end", "ab cd " * 30_000])
def test_long_texts(library, text):
    assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_streams_in_any_parts(library):
    t, r = bpe.codec(PATH).transducer, random.Random(2)
    data = "".join(r.choice("abcdefgh") for _ in range(30_000))
    expected = library.encode(data, add_special_tokens=False).ids
    for part in (1000, 7001, 30_000):
        stream, out, most = bpe.Stream(t), [], 0
        for i in range(0, len(data), part):
            out += stream.push(data[i : i + part].encode())
            most = max(most, len(stream.data))
        assert out + stream.finish() == expected
        assert most <= 3 * stream.most + 4096  # constant memory


def merge(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        found = [(ranks[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in ranks]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_lookahead_of_small_merge_lists():
    """Tokens that end further from the end than the lookahead never change, whatever follows;
    the transducer gives what merging in list order gives."""
    r = random.Random(5)
    for _ in range(60):
        tokens, pairs = [b"a", b"b", b"c"], []
        for _ in range(12):
            a, b = r.choice(tokens), r.choice(tokens)
            if a + b not in tokens:
                pairs.append((a, b))
                tokens.append(a + b)
        ranks = {p: i for i, p in enumerate(pairs)}
        t = bpe.Transducer(pairs, {x: i for i, x in enumerate(tokens)})
        for _ in range(60):
            text = bytes(r.choice(b"abc") for _ in range(r.randint(1, 60)))
            more = bytes(r.choice(b"abc") for _ in range(r.randint(1, 20)))
            whole, longer = merge(text, ranks), merge(text + more, ranks)
            assert [tokens[i] for i in t.piece(text)] == whole
            stream = bpe.Stream(t)
            assert [tokens[i] for i in [*stream.push(text), *stream._settle(), *stream.finish()]] == whole
            at, final = 0, len(text) - t.lookahead
            for x, y in zip(whole, longer):
                at += len(x)
                if at > final:
                    break
                assert x == y


def test_rows(spark, corpus, empty, library):
    rows, df = corpus
    got = sorted(map(repr, (tuple(r) for r in bpe.digests(df, PATH).collect())))
    want = []
    for doc_id, text in rows:
        own = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want.append((doc_id, len(own), digest(np.array(own, "<u4").tobytes()), digest(library.decode(own, skip_special_tokens=False).encode())))
    assert got == sorted(map(repr, want))
    assert bpe.digests(empty, PATH).count() == 0


def test_parts_and_back(spark, corpus):
    rows, df = corpus
    long = spark.createDataFrame([(1, "many words " * 30_000)], "doc_id long, text string")
    parts = sorted((r["part"], r["ids"]) for r in bpe.encode(long, PATH, most=8).collect())
    assert [p for p, _ in parts] == list(range(6)) and sum((i for _, i in parts), []) == ids("many words " * 30_000)
    assert sorted(t or "" for _, t in rows) == sorted(r["text"] for r in bpe.decode(bpe.encode(df, PATH), PATH).collect())


def test_malformed_bytes_are_replaced(library):
    r, table = random.Random(3), bpe.codec(PATH).table
    for _ in range(500):
        some = [r.randrange(256) for _ in range(r.randint(1, 12))]
        back = bpe.Decoder(table)
        assert "".join(back.push([i]) for i in some) + back.finish() == library.decode(some, skip_special_tokens=False)


def test_merge_lists_must_be_proper():
    with pytest.raises(ValueError, match="merge"):
        bpe.Transducer([(b"ab", b"c")], {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"abc": 4})
