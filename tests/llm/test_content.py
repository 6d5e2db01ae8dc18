"""Toxicity, chat, media and decontamination."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import chat, decontaminate, media, toxicity


def say(r, n):
    return " ".join(r.choice("abcdefgh") + r.choice("klmnop") + r.choice("rstuv") + str(r.randint(0, 9)) for _ in range(n))


def test_block_max_search_is_exact():
    r = np.random.default_rng(4)
    index = toxicity.Index({}, r.random(40) + 1, np.arange(300), np.zeros(300, np.int64), 0.1, 0.1)
    vectors = [index.vector({int(t): int(c) for t, c in zip(r.choice(40, 5, False), r.integers(1, 6, 5))}) for _ in range(300)]
    index.build(vectors)
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for _ in range(50):
        t, w = index.vector({int(t): 1 for t in r.choice(40, 3, False)})
        scores = np.round(dense[:, t] @ w, 12)
        best = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if s > 0))[:7]
        got = index.nearest(t, w, 7)
        assert [i for _, i in got] == [i for _, i in best]


def toxic_rows(n=400):
    r = random.Random(6)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        rows.append((i, say(r, 30) + (f" {r.choice(['vile', 'nasty', 'horrid'])} {r.choice(['vile', 'nasty'])}!" if toxic else ""), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (9999, "", "x")], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(3, 0, None), (None, 0, 1), (0, 0, 0)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, labels)
    assert all(zlib.crc32(str(i).encode()) % 5 for i in index.ids.tolist())
    got = toxicity.score(docs, index).collect()
    assert len(got) == len(rows) + 2
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] in truth:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["predicted"] == truth[r["doc_id"]]
    kept = toxicity.keep_clean(docs, index)
    assert kept.columns == docs.columns and kept.count() == 300 + 2


def test_both_ways_of_the_search_agree():
    """Visited blocks, all postings, and a dense product give the same neighbours."""
    r = np.random.default_rng(9)
    index = toxicity.Index({f"v{i}": i for i in range(10)}, r.random(400) + 1, np.arange(500), np.zeros(500, np.int64), 0.1, 0.1)
    vectors = [index.vector({int(t): int(c) for t, c in zip(r.choice(400, 30, False), r.integers(1, 6, 30))}) for _ in range(500)]
    index.build(vectors)
    dense = np.zeros((500, 400))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for low in (0, 10):
        for size in (1, 3, 40):
            t, w = index.vector({int(t): 1 for t in r.choice(np.arange(low, 400), size, False)})
            scores = np.round(dense[:, t] @ w, 12)
            best = sorted(((-s, i) for i, s in enumerate(scores.tolist()) if s > 0))[:7]
            assert [i for _, i in index.nearest(t, w, 7)] == [i for _, i in best] == [i for _, i in index._all(t, w, 7)]
    assert index.nearest(np.empty(0, np.int64), np.empty(0), 7) == []


def test_words_below_the_gate_still_have_neighbours(spark):
    """Rude words of four examples each go with no label by the ratio, yet their holders
    are compared, and copies of an example find it first."""
    r = random.Random(3)
    rude = [f"zq{c}x" for c in "abcdefgh"]
    rows = [(i, say(r, 12) + (f" {rude[i % 8]}" * 3 if i < 32 else ""), int(i < 32)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs, labels)
    found = {x["doc_id"]: x for x in toxicity.score(docs, index).collect()}
    assert all(x["evidence"] for x in found.values())
    for i in index.ids.tolist():
        assert found[1000 + i]["evidence"][0]["similarity"] > 1 - 1e-9 and found[i]["score"] == found[1000 + i]["score"]
    assert not any(w in index.vocabulary for w in rude)
    mean = lambda ids: sum(found[i]["score"] for i in ids) / len(ids)
    assert mean(range(32)) > 2 * mean(range(32, 300))


def test_toxicity_without_labels(spark, empty):
    docs = spark.createDataFrame([(1, "vile text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0]
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def test_chat_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "")]
    rows = [(c, t, role, text) for c, n in ((1, 4), (2, 2), (3, 4), (4, 1)) for t, (role, text) in enumerate(talk[:n])]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (None, 0, "user", "alone"), (6, None, "user", "x"), (6, 0, "user", "x"), (7, 0, "user", "hi"), (7, 1, "assistant", "hello"), (7, 2, "user", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, pos string").repartition(3)
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.collapse(df).collect()}
    assert set(got) == {1, 5, 6, 7, None}
    assert got[1][:2] == (4, 2)
    assert got[1][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert chat.collapse(df.limit(0)).count() == 0


def test_long_conversation_is_rendered_in_parts(spark):
    df = spark.range(1000).selectExpr("1L as conv_id", "id as turn", "'user' as role", "cast(id as string) as text")
    got = sorted((r["part"], r["rendered"].count("<|im_start|>")) for r in chat.collapse(df, 300).collect())
    assert got == [(0, 300), (1, 300), (2, 300), (3, 100)]


def test_media_round_trip(corpus):
    rows, df = corpus
    expected = []
    for d, t in rows:
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192), b" ")
        expected.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    got = media.document_media(df).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=repr) == sorted(expected, key=repr)
    features = {}
    for r in got:
        assert features.setdefault((r["payload_sha256"], r["n_bytes"]), (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
        assert r["caption"] == f"raster of {r['n_bytes']} bytes"
    assert media.unraster(media.raster(b"\0" * 384)) == b"\0" * 384


def test_sequences_stay_aligned(spark):
    html = '<p>Intro &amp; more</p><figure><img src="sha256:aa" alt="A"><figcaption>First <b>one</b></figcaption></figure>text<img src="sha256:zz" alt="gone"><script>x()</script><p>end'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    store = spark.createDataFrame([("aa", 5)], "digest string, n_bytes long")
    got = sorted((r["position"], r["kind"], r["text"], r["caption"], r["n_bytes"]) for r in media.resolve(media.sequences(pages), "page_id", store).collect())
    assert got == [(0, "text", "Intro & more", None, None), (1, "img", None, "First one", 5), (2, "text", "text", None, None), (3, "img", None, "gone", None), (4, "text", "end", None, None)]


def brute_matches(docs, items):
    norm = lambda t: decontaminate._WORD.findall((t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    out = {}
    for d, t in docs:
        w = norm(t)
        for i, x in items:
            v = norm(x)
            if len(v) < 5:
                continue
            g, n = grams(v), min(len(v), len(w))
            best = max((decontaminate.weighted_jaccard(grams(w[p : p + n]), g) for p in range(len(w) - n + 1) if n >= 5), default=0)
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_decontamination_matches_brute_force(spark):
    r = random.Random(8)
    items = [(i, say(r, r.randint(14, 50))) for i in range(30)] + [(30, "only three words"), (31, None), (32, "")]
    docs = []
    for d in range(60):
        body = items[d % 30][1].split()
        if d % 3 == 0:
            body = body[: len(body) - d % 4]  # truncated passages
        if d % 5 == 0:
            body[-2] = "changed"
        docs.append((d, f"{say(r, 20)} {' '.join(body).upper() if d % 2 else ' '.join(body)}, {say(r, 10)}" if d < 50 else say(r, 60)))
    docs += [(100, items[0][1]), (101, None), (102, ""), (103, "so only three words here"), (104, " ".join(items[1][1].split()[:-1]))]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_matches(docs, items) | {(103, 30): 1.0}
    assert expected
    for chunk in (4096, 7):
        got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.find(df, bench, chunk=chunk).collect()}
        assert got == expected
    clean = decontaminate.keep_clean(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in expected}
    assert decontaminate.find(df, bench.limit(0)).count() == 0 and decontaminate.find(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("distance", [0, 7, 20])
def test_multi_index_reaches_the_whole_radius(distance):
    r = random.Random(distance)
    index = decontaminate.ItemIndex([(i, say(r, 20)) for i in range(50)])
    for i, fp in enumerate(index.prints.tolist()):
        for b in r.sample(range(64), distance):
            fp ^= 1 << b
        assert (i, distance) in index.near(fp)


def flat(source):
    return [(e["position"], e["kind"], e["text"] or e["digest"], e["caption"]) for e in media.parse(source)]


def test_omitted_end_tags_keep_text():
    assert flat("<![foo[ x ]]><p>hi") == [(0, "text", "hi", None)]
    assert flat("<html><head><meta charset=utf8><body><p>hello world") == [(0, "text", "hello world", None)]
    assert flat("<head><title>T<body><p>still here")[0][2].endswith("still here")
    assert flat("<title>T</title><script>if (a<b) x</script><p>body") == [(0, "text", "body", None)]
    assert flat("<figure><img src=a><figcaption>one<figure><img src=b><figcaption>two") == [(0, "img", "a", "one"), (1, "img", "b", "two")]
    assert flat(None) == flat("") == []


def test_broken_markup_never_fails():
    r = random.Random(8)
    bits = ["<", ">", "<!", "<![", "]]>", "<![CDATA[", "<!doctype", "<?x", "--", "<!--", "</", "<p", "<p>", "</p>", "<title>", "</title>", "<script>", "</script>", "<img src='a", "<img src=x alt=y>", "<figure>", "</figure>", "<figcaption>", "</figcaption>", "&amp", "&#x", "&#99999999;", "'", '"', "=", "/", "word ", "é", "\x00", "<head>", "<body>"]
    for _ in range(5000):
        source = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        found = media.parse(source)
        assert [e["position"] for e in found] == list(range(len(found)))


def test_page_sequences_stay_aligned(spark):
    """Several images, captions and texts of a page, some payloads missing."""
    rows = [(p, "".join(f"<p>text {p}.{i}</p><figure><img src='sha256:{p % 3}{i}' alt='alt {i}'>" + (f"<figcaption>caption {p}.{i}</figcaption>" if i % 2 else "") + "</figure>" for i in range(p % 5))) for p in range(40)]
    pages = spark.createDataFrame(rows + [(99, None)], "page_id long, html string").repartition(3)
    store = spark.createDataFrame([(f"{a}{i}", 10 * a + i) for a in range(2) for i in range(5)], "digest string, n_bytes long")
    got = {}
    for r in media.page_media(pages, store).collect():
        got.setdefault(r["page_id"], []).append((r["position"], r["kind"], r["text"] or r["digest"], r["caption"], r["n_bytes"]))
    for p, _ in rows:
        expected = []
        for i in range(p % 5):
            expected.append((2 * i, "text", f"text {p}.{i}", None, None))
            expected.append((2 * i + 1, "img", f"{p % 3}{i}", f"caption {p}.{i}" if i % 2 else f"alt {i}", 10 * (p % 3) + i if p % 3 < 2 else None))
        assert sorted(got.get(p, [])) == expected
    assert 99 not in got


def test_items_in_many_chunks(spark):
    """More chunks than a worker holds at once; null ids and repeated rows on both sides."""
    r = random.Random(12)
    items = [(i, say(r, 30)) for i in range(60)]
    rows = [(d, f"{say(r, 20)} {items[d % 60][1]} {say(r, 15)}" if d % 3 == 0 else say(r, 60)) for d in range(90)]
    rows += [rows[0], rows[0], (None, items[5][1]), (None, None), (91, items[7][1] + " x" * 400_000)]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([*items, items[0], (None, "a b c"), (77, None)], "item_id long, text string")
    expected = sorted([(d, d % 60) for d in range(0, 90, 3)] + [(0, 0), (0, 0), (91, 7)] + [(-1, 5)])
    for chunk in (4096, 5):
        got = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["item_id"]) for x in decontaminate.find(docs, bench, chunk=chunk).collect())
        assert got == expected
    kept = decontaminate.keep_clean(docs, bench, chunk=5)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(expected)


def test_long_words_and_scripts_without_spaces():
    assert toxicity.words_of("今日は bad 天") == ["今日", "日は", "bad", "天"]
    x, y = toxicity.features("x" * 65), toxicity.features("x" * 66)
    assert x[0] != y[0] and x[1:] == y[1:]
    assert toxicity.features("x" * 65)[0] in toxicity.of_text({"x" * 65})


def test_scores_are_calibrated_on_held_out_rows(spark):
    """Words that go with a label half or nine tenths of the time, and noise: scores of
    held-out rows match the share of toxic ones."""
    r = random.Random(21)
    rates = {"plain": 0.05, "rude": 0.5, "vile": 0.9}
    rows = [(i, k, f"{say(r, 20)} {'' if k == 'plain' else k} {say(r, 10)}", int(r.random() < rates[k])) for i, k in enumerate(r.choices(list(rates), (6, 2, 2), k=4000))]
    docs = spark.createDataFrame([(i, t) for i, _, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 0, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    scored = {x["doc_id"]: x for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if x["held_out"]}
    for k, rate in rates.items():
        own = [(scored[i]["score"], y) for i, kind, _, y in rows if kind == k and i in scored]
        assert len(own) > 100
        mean, share = (sum(v) / len(own) for v in zip(*own))
        assert abs(mean - rate) < 0.12 and abs(mean - share) < 0.15
    best = next(x for i, kind, _, _ in rows if kind == "vile" and i in scored for x in [scored[i]])
    assert len(best["evidence"]) == toxicity.NEIGHBOURS
    votes = [(e["similarity"] ** toxicity.POWER, e["toxic"]) for e in best["evidence"]]
    assert 0 <= sum(v * y for v, y in votes) / sum(v for v, _ in votes) <= 1


def test_very_long_texts(spark):
    """Several megabytes in one text: stored, rendered and scored whole."""
    long = "é" * 1_500_000 + " tail"
    df = spark.createDataFrame([(1, long), (2, long), (3, None)], "doc_id long, text string")
    data = long.encode()
    payload = data + b" " * (-len(data) % 192)
    got = {x["doc_id"]: x for x in media.document_media(df).collect()}
    assert got[1]["n_bytes"] == len(data) and got[1]["payload_sha256"] == got[2]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "x"), (2, 0, "user", long)], "conv_id long, turn int, role string, text string")
    (row,) = chat.collapse(turns).collect()
    assert row["conv_id"] == 1 and long in row["rendered"]
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, "calm " * 400_000 + "vile nasty!"), (5000, "calm " * 400_000 + "vile nasty!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    scores = [x["score"] for x in toxicity.score(docs, toxicity.fit(docs, labels)).where("doc_id = 5000").collect()]
    assert len(scores) == 2 and scores[0] == scores[1] > 0.5


@pytest.mark.parametrize("page", ["<!--" * 1_000_000, "<a " * 1_300_000, '<a b="' * 600_000, "</" * 2_000_000, "<!--" * 1_000_000 + ">", '<a b="' * 600_001 + ">", "<a " * 1_300_000 + ">"])
def test_unclosed_markup_takes_linear_time(page):
    """4 MB of each: seconds, where it took hours when every mark was looked at to the end."""
    began = time.process_time()
    found = media.parse("before <p>" + page)
    assert time.process_time() - began < 30
    assert found[0]["text"].startswith("before")


def test_windows_at_once(monkeypatch):
    """Fingerprints and lookups of many windows equal those of single ones, and a passage
    with many windows takes no lookup of its own for each."""
    r = random.Random(12)
    items = [(i, " ".join(f"w{r.randint(0, 60)}" for _ in range(r.randint(5, 40)))) for i in range(80)]
    index = decontaminate.ItemIndex(items)
    g = np.array([r.getrandbits(64) for _ in range(9000)], np.uint64)
    first = np.sort(np.array([r.randrange(8000) for _ in range(6000)], np.int64))
    size = np.array([r.randint(1, 900) for _ in first], np.int64)
    prints = decontaminate.simhashes(g, first, size)
    assert prints.tolist() == [decontaminate.simhash(g[a : a + n]) for a, n in zip(first.tolist(), size.tolist())]
    near = np.concatenate([index.prints ^ np.uint64(sum(1 << b for b in r.sample(range(64), k))) for k in (0, 5, 18, 21)])
    sizes = np.tile(index.widths, 4)
    found = list(zip(*(x.tolist() for x in index.within(near, sizes))))
    assert found == [(w, i, d) for w, fp in enumerate(near.tolist()) for i, d in sorted(index.near(fp)) if index.sizes[i] == sizes[w]]
    calls = []
    monkeypatch.setattr(decontaminate, "simhash", lambda own: calls.append(1))
    text = " ".join(t for _, t in items)
    whole = index.matches(text)
    assert {m[0] for m in whole} == {i for i, _ in items} and not calls
    monkeypatch.setattr(decontaminate, "WINDOWS", 7)
    assert index.matches(text) == whole


def test_frequent_terms_as_rows():
    """Terms that many examples have are added up as rows of a matrix, which is not shipped;
    the neighbours are those of the whole postings."""
    r = np.random.default_rng(5)
    n, size = 300, 400
    index = toxicity.Index({}, np.ones(size), np.arange(n), r.integers(0, 2, n), 0.1, 0.1)
    share = np.where(np.arange(size) < 30, 0.6, 0.02)
    held = [np.union1d(np.flatnonzero(r.random(size) < share), [size - 1]) for _ in range(n)]
    index.build([index.unit(t, r.integers(1, 5, len(t))) for t in held])
    row, matrix = index.frequent
    assert 30 <= len(matrix) <= toxicity.DENSE and (row >= 0).sum() == len(matrix) and "frequent" not in index.__getstate__()
    for _ in range(40):
        t = np.union1d(np.flatnonzero(r.random(size) < 0.1), [3])
        t, w = index.unit(t, r.integers(1, 5, len(t)))
        whole = np.round(toxicity._sums(index.starts, index.postings, index.weights, t, w, n), 12)
        expected = sorted(((s, i) for i, s in enumerate(whole.tolist()) if s > 0), key=lambda x: (-x[0], x[1]))[:15]
        got = index.nearest(t, w, 15)
        assert np.allclose([s for s, _ in got], [s for s, _ in expected], atol=2e-12)
        clear = [i for k, (s, i) in enumerate(expected) if not any(abs(s - u) < 1e-10 for j, (u, _) in enumerate(expected) if j != k)]
        assert set(clear[:10]) <= {i for _, i in got}


def test_texts_are_read_for_their_terms_once(spark, monkeypatch):
    """Scores by the kept terms are those of the texts, which one stage reads."""
    rows = [(i, f"word{i % 7} {'vile' if i % 3 == 0 else 'kind'} tail{i} Ünï «quoted»\xa0naïve 東京") for i in range(90)] + [(None, None), (200, ""), (200, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    plain = toxicity.score(docs, toxicity.fit(docs, labels))
    assert sorted(map(str, toxicity.fit_score(docs, labels).collect())) == sorted(map(str, plain.collect()))
    assert toxicity.fit_score(docs, labels.limit(0)).count() == len(rows)
    seen = []
    monkeypatch.setattr(toxicity, "_scores", lambda rows, index, k: seen.append(rows.columns) or rows)
    toxicity.fit_score(docs, labels)
    assert seen == [["doc_id", "held_out", "terms", "counts"]]


def test_latin_words_and_likely_terms():
    every = " ".join(f"a{chr(i)}b" for i in range(256)) + " short x yy " + "z" * 70
    assert toxicity.words_of(every) == toxicity._WORD.findall(every.lower())
    terms = toxicity._Terms({"vil*": 0, "é": 1, "yy": 2, "kind": 3, "日本": 4})
    words = {w: 1 for w in ["vilest", "é", "yy", "kind", "kinder", "other", "z" * 70, "of"]}
    assert terms.among(words) == ["vilest", "é", "yy", "kind"]
    assert terms.among({**words, "日本": 1}) == ["vilest", "é", "yy", "kind", "日本"] and terms.among({}) == []
