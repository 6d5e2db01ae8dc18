"""The pipeline stage by stage on a small corpus with planted cases."""

import os
import random

import pytest

import corpus_pipeline as cp

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.5 * len(ids), name
        ids = left
    packed = cp.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == ids
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash", "decontaminate", "packing"]


def tables(spark, folder, rows):
    r = random.Random(4)
    bench = [(k, say(r, 40)) for k in range(3)]
    labels = [(d, 0, int(bool(t) and "vile" in t)) for d, t in rows if d is not None]
    made = {
        "documents": spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, removed string"),
        "benchmark": spark.createDataFrame(bench, "item_id long, text string"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    }
    for name, df in made.items():
        df.write.parquet(f"file://{folder}/{name}.parquet")
    return [t for _, t in bench]


def say(r, n):
    return " ".join(r.choice("abcdefgh") + r.choice("klmnop") + str(r.randint(0, 99)) for _ in range(n))


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, say(r, 60)) for i in range(120)]
    rows += [(200 + i, f"{say(r, 30)} vile nasty vile") for i in range(60)]
    block = "\n".join(say(r, 5) for _ in range(3))
    rows += [(300 + i, f"{say(r, 30)}\n{block}\n{say(r, 20)}") for i in range(10)]
    rows += [(400 + i, rows[i][1] + " one more word") for i in range(10)]  # near copies
    again = random.Random(4)
    items = [say(again, 40) for _ in range(3)]
    rows += [(500, f"{say(r, 20)} {items[1]} {say(r, 20)}"), (501, None), (502, ""), (503, None), (None, say(r, 40)), rows[3], rows[3], (504, say(r, 300_000))]
    assert tables(spark, tmp_path, rows) == items
    where = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    got = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, where)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        got[name] = docs.collect()
    ids = lambda name: [x["doc_id"] for x in got[name]]
    # Toxic documents go, all others stay.
    assert sorted(map(str, ids("toxicity"))) == sorted(str(d) for d, t in rows if "vile" not in (t or ""))
    # The shared block stays in its first document alone.
    texts = {x["doc_id"]: x["text"] for x in got["line_dedup"]}
    assert block in texts[300] and not any(line in texts[301 + i] for i in range(9) for line in block.split("\n"))
    assert texts[501] is None and texts[502] == ""
    # Near copies and repeated rows: the first stays; null, empty and copied texts are one.
    kept = ids("simhash")
    assert kept.count(3) == 1 and not {400 + i for i in range(10)} & set(kept) and set(range(120)) <= set(kept)
    assert len({501, 502, 503} & set(kept)) == 1 and None in kept and 504 in kept
    # The benchmark passage goes.
    assert set(kept) - set(ids("decontaminate")) == {500}
    # Every id of what is left is packed once.
    size = {}
    for x in got["packing"]:
        size[x["doc_id"]] = size.get(x["doc_id"], 0) + x["length"]
    tokens = {x["doc_id"]: x["doc_tokens"] for x in got["packing"]}
    assert size == tokens and set(size) == set(ids("decontaminate"))


def test_empty_documents(spark, tmp_path):
    tables(spark, tmp_path, [])
    assert cp.run(spark, f"file://{tmp_path}").count() == 0
