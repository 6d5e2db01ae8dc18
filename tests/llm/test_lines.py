"""Line dedup against all-pairs brute force."""

import random

import pytest

from tallyspark.llm import lines

LAST = (1 << 63) - 1


def stripped(text):
    return [s for x in (text or "").split("\n") if (s := x.strip())]


def removed(rows):
    """(doc_id, removed lines): every line of three words that an earlier document holds."""
    out = []
    for d, t in rows:
        earlier = {s for e, u in rows if e < d for s in stripped(u)}
        out.append((d, sum(s in earlier and len(s.split()) >= 3 for s in stripped(t))))
    return sorted(out)


def counts(df):
    return sorted((r["doc_id"], r["n_removed"]) for r in lines.deduplicate(df).collect())


@pytest.mark.parametrize("kinds", [6, 40])
def test_frequent_repeated_and_crossing_lines(spark, kinds):
    r = random.Random(kinds)
    rows = [(i, "\n".join(f"shared line number {r.randrange(kinds)}" if r.random() < 0.6 else f"an own line {r.random()}" for _ in range(r.randint(1, 14)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert counts(df) == removed(rows)


def in_runs(rows):
    """(doc_id, lines in runs of three words and more that an earlier document holds)."""
    texts = [(d, stripped(t)) for d, t in rows]
    out = []
    for d, x in texts:
        gone = set()
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1):
                if sum(len(s.split()) for s in x[i:j]) >= 3 and any(e < d and any(y[k : k + j - i] == x[i:j] for k in range(len(y))) for e, y in texts):
                    gone.update(range(i, j))
        out.append((d, len(gone)))
    return sorted(out)


def test_runs_of_short_lines(spark):
    r = random.Random(3)
    say = lambda: " ".join(r.choice("abcd") for _ in range(r.choice((1, 1, 1, 2, 2, 3))))
    rows = [(i, "\n".join(say() if r.random() < 0.7 else f"own {r.random()}" for _ in range(r.randint(1, 9)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert counts(df) == in_runs(rows)


def test_scripts_without_spaces(spark):
    rows = [(1, "今日は天気が良いです\n短い\nสวัสดีครับผมชื่อ"), (2, "別\n今日は天気が良いです"), (3, "短い\n他"), (4, "สวัสดีครับผมชื่อ\nunspacedlatin"), (5, "unspacedlatin")]
    assert counts(spark.createDataFrame(rows, "doc_id long, text string")) == [(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)]


@pytest.mark.parametrize("n", [2, 8, 9, 50])
def test_group_size_does_not_matter(spark, n):
    """Moved blocks: equal content loses equal lines, however many documents hold it."""
    say = lambda name: "\n".join(f"{name} line number {i}" for i in range(4)) + f"\nend\nof\n{name}"
    x, y, z = say("x"), say("y"), say("z")
    rows = [(1, f"{y}\nfiller one two three\n{x}\nmore filler in here\n{z}")]
    rows += [(2 + i, f"{x}\nown words of {i}\n{z}\n{y}\n{y}") for i in range(n)]
    got = counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == in_runs(rows)
    assert {c for d, c in got if d > 1} == {28}


def test_blocks_name_the_earlier_document(spark):
    rows = [(1, "a b c\nd e f\nx y z"), (5, "new new new\na b c\nd e f"), (7, None), (9, "x y z\n\na b c\nd e f")]
    got = {r["doc_id"]: r for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()}
    found = {d: [(x["other"], b["place"], b["other_place"], b["n_lines"]) for x in r["removed"] for b in x["blocks"]] for d, r in got.items()}
    assert found == {1: [], 5: [(1, 1, 0, 2)], 7: [], 9: [(1, 1, 0, 2), (1, 0, 2, 1)]}
    assert got[5]["kept"] == "new new new" and got[7]["kept"] is None and got[9]["kept"] == ""


def test_alignments_hold_every_match_once():
    r = random.Random(2)
    for _ in range(300):
        matches = sorted({(p, 1, r.randrange(9), r.random() < 0.5) for p in r.sample(range(40), r.randint(1, 20))})
        runs = lines.alignments(matches)
        assert sorted(m for run in runs for m in run) == matches
        assert all(a[0] < b[0] and a[2] < b[2] for run in runs for a, b in zip(run, run[1:]))


def test_very_long_texts(spark):
    long = "\n".join(f"line {i} of many" for i in range(300_000))
    back = "\n".join(f"line {i} of many" for i in range(20_000, 0, -1))
    rows = [(1, long), (2, back), (3, long + "\nand a last line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counts(df) == [(1, 0), (2, 20_000), (3, 300_000)]


def test_rewrite_keeps_rows_and_columns(spark):
    rows = [(1, "a b c\nd", "k", 7), (2, "a b c\nx", "k", 7), (2, "a b c\nx", "k", 7), (None, None, None, None), (None, "a b c", "k", 5), (3, "", "k", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string, n_chars int")
    got = sorted(map(repr, (tuple(r) for r in lines.rewrite(df).collect())))
    assert got == sorted(map(repr, [(1, "a b c\nd", "k", 7), (2, "x", "k", 1), (2, "x", "k", 1), (None, None, None, None), (None, "", "k", 0), (3, "", "k", 0)]))
