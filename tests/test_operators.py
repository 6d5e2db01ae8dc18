"""Operators against small tables with known results."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import controls, leaks, metrics, stats, training


def samples(spark):
    rows = [("base", None, c, p, i % 2 == 0) for c in "TE" for p in range(4) for i in range(6)]
    rows += [("rl", s, c, p, i % 3 != 0 if c == "T" else i % 2 == 0) for s in range(2) for c in "TE" for p in range(4) for i in range(6)]
    return spark.createDataFrame(rows, "model string, seed int, condition string, problem_id long, correct boolean")


def test_base_pairs_with_every_seed(spark):
    got = {(r["seed"], r["condition"]): (round(r["delta"], 6), r["n_problems"]) for r in metrics.deltas(samples(spark), [1]).collect()}
    assert got == {(s, c): (0.166667 if c == "T" else 0.0, 4) for s in range(2) for c in "TE"}


def test_did_and_repartitioning(spark):
    wide = metrics.problem_pivot(samples(spark).repartition(7), [1])
    assert {round(r["did"], 6) for r in wide.collect()} == {0.166667}


def test_intervals_cover_a_constant(spark):
    wide = metrics.problem_pivot(samples(spark), [1])
    for r in stats.intervals(wide, ["dt", "dp", "did"], 20).collect():
        assert abs(r["lo"] - r["point"]) < 1e-9 and abs(r["hi"] - r["point"]) < 1e-9 and r["n"] == 4


def test_no_problems_no_intervals(spark):
    assert stats.intervals(metrics.problem_pivot(samples(spark).limit(0), [1]), ["dt"], 5).count() == 0


def test_weight_diff(spark):
    rows = [("before", "a", "m", "1"), ("after", "a", "m", "1"), ("before", "b", "m", "1"), ("after", "b", "m", "2"), ("before", "c", "m", "1"), ("after", "d", "m", None)]
    m = spark.createDataFrame(rows, "phase string, param_key string, module string, digest string")
    assert {r["param_key"]: r["identical"] for r in controls.weight_diff(m).collect()} == {"a": True, "b": False, "c": False, "d": True}


def test_leaks_by_run_and_by_equality(spark):
    corpus = spark.createDataFrame([("x a b c d e f g h y",), ("Short Item",), (None,)], "text string")
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "short item"), (3, "a b c d e f g z"), (4, "other"), (5, None)], "item_id long, text string")
    assert {r[0] for r in leaks.leaked(items, corpus).collect()} == {1, 2}


def test_plateau_needs_two_flat_changes(spark):
    rows = [(0, 100, 0.1), (0, 200, 0.2), (0, 300, 0.205), (0, 400, 0.206)]
    got = training.plateau(spark.createDataFrame(rows, "seed int, step int, pass1 double")).orderBy("step").collect()
    assert [r["stop"] for r in got] == [False, False, False, True]


def test_equal_rewards_have_no_scaled_advantage(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.0)], "g int, reward double")
    got = sorted((r["g"], r["advantage"]) if r["advantage"] is not None else (r["g"], 9.0) for r in training.group_advantage(df, ["g"]).collect())
    assert got == [(1, 9.0), (1, 9.0), (2, -1.0), (2, 1.0)]


def test_stratified_sample_is_exact(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 3)
    got = training.stratified_sample(df, ["s"], 5, F.col("id").cast("string")).groupBy("s").count().collect()
    assert {r["count"] for r in got} == {5}


def leak_tables(spark):
    corpus = spark.createDataFrame([("x a b c d e f g h y",), ("Short Item",), ("no match in these nine words of this text",), (None,), ("",)], "text string")
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "short item"), (3, "a b c d e f g z"), (4, "other"), (5, None), (6, "A  B c d e f g h i j")], "item_id long, text string")
    return items, corpus


@pytest.mark.parametrize("words", [1, 2, 1 << 10])
def test_leaks_whatever_the_filter_lets_through(spark, words):
    """One word of bits lets nearly all runs through; the result does not change."""
    items, corpus = leak_tables(spark)
    assert {r[0] for r in leaks.leaked(items, corpus, filter_words=words).collect()} == {1, 2, 6}
    assert leaks.leaked(items.limit(0), corpus).count() == 0 and leaks.leaked(items, corpus.limit(0)).count() == 0


def test_only_survivors_of_the_filter_are_exchanged(spark):
    """The corpus has 20,000 runs; what leaves its tasks are those that the items may have."""
    corpus = spark.range(1000).select(F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), (F.col("id") * 31 + i).cast("string")) for i in range(27))).alias("text"))
    items = corpus.limit(3).select(F.lit(1).alias("item_id"), F.concat(F.lit("q "), "text").alias("text"))
    bits = leaks.run_filter(leaks.item_runs(items, 8))
    kept = leaks.survivors(corpus, bits, 8)
    assert 60 <= kept.count() < 400
    found = leaks.leaked(items, corpus)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_the_filter_is_bounded(spark):
    many = spark.range(5000).select(F.col("id").alias("item_id"), F.concat_ws(" ", *(F.md5((F.col("id") + i).cast("string")) for i in range(9))).alias("text"))
    own = leaks.item_runs(many, 8)
    assert len(leaks.run_filter(own)) == 4096 and len(leaks.run_filter(own, 64)) == 64
    assert leaks.leaked(many, many.select("text"), filter_words=64).count() == 5000


def test_item_runs_in_the_filter_are_never_lost(spark):
    texts = spark.range(300).select("id", F.concat_ws(" ", *(F.md5(F.concat(F.lit(f"{i}:"), F.col("id").cast("string"))) for i in range(12))).alias("text"))
    items = texts.select(F.col("id").alias("item_id"), "text")
    assert leaks.leaked(items, texts.select("text")).count() == 300


def test_numbering_over_ranges_of_ids(spark):
    ids = [-70_000, -3, 0, 5, 65_535, 65_536, 1 << 40]
    got = stats.numbered(spark.createDataFrame([(i,) for i in ids + ids + [None]], "problem_id long"))[0].collect()
    assert sorted((r["i"], r["problem_id"]) for r in got) == list(enumerate(ids)) and {r["n_problems"] for r in got} == {7}


def test_numbering_of_sparse_and_text_keys(spark):
    """1e5 hashed ids, and strings: as sorted order numbers them; the only window that is
    not within a range runs over a row a range."""
    hashed = spark.range(100_000).select(F.xxhash64("id").alias("key"))
    got, _ = stats.numbered(hashed.unionByName(hashed.limit(500)), "key", parts=16)
    assert got.selectExpr("count(*)", "min(i)", "max(i)", "min(n_problems)").first() == (100_000, 0, 99_999, 100_000)
    keys = [r["key"] for r in got.orderBy("i").collect()]
    assert keys == sorted(keys)
    own, _ = stats.ranged(hashed, "key", 16)
    sizes = [r["count"] for r in own.groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 100_000 / 16
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 2 and "rangepartitioning" not in plan  # over the ranges' sizes alone
    words = [f"p{i}" for i in range(50)] + ["é", ""]
    got = stats.numbered(spark.createDataFrame([(w,) for w in words], "key string"), "key")[0].collect()
    assert [r["key"] for r in sorted(got, key=lambda r: r["i"])] == sorted(words)
    assert stats.numbered(hashed.limit(0), "key")[0].count() == 0


def test_weights_are_opened_inside_the_sum(spark, tmp_path):
    """200 and 20 replicates exchange problem rows alike; weights agree with drawing one by one."""
    from hashlib import md5

    wide = spark.createDataFrame([(0, 1, i * i, float(i) if i % 7 else None) for i in range(40)], "seed int, k int, problem_id long, x double")
    rows, _ = stats.weighted(wide, 30)
    place = {i * i: i for i in range(40)}
    expected = {i: [] for i in range(40)}
    for b in range(30):
        for j in range(40):
            expected[int(md5(f"{b}:{j}".encode()).hexdigest()[:8], 16) % 40].append(b)
    assert {place[r["problem_id"]]: sorted(r["drawn"]) for r in rows.collect()} == {i: [-1, *sorted(d)] for i, d in expected.items()}
    means = {r["b"]: r["x"] for r in stats.replicate_means(wide, ["x"], 30).collect()}
    for b in range(30):
        drawn = [i for i, d in expected.items() for x in d if x == b and i % 7]
        assert abs(means[b] - sum(drawn) / len(drawn)) < 1e-9
    one = stats.intervals(wide, ["x"], 30).first()
    assert one["n"] == 34 and one["lo"] <= one["point"] <= one["hi"]


def test_bootstrap_leaves_no_large_table(spark):
    import glob

    from tallyspark.sources import readers

    root = readers.shared_path(spark, "x").removeprefix("file://").rsplit("/", 1)[0]
    before = set(glob.glob(f"{root}/*"))
    stats.intervals(metrics.problem_pivot(samples(spark), [1]), ["dt"], 10).collect()
    assert set(glob.glob(f"{root}/*")) == before


def test_bayes_interval_of_one_problem(spark):
    (r,) = [x for x in stats.bayes_intervals(samples(spark)).collect() if (x["seed"], x["condition"]) == (0, "T")]
    assert abs(r["point"] - (5 / 8 - 4 / 8)) < 1e-12 and r["lo"] < r["point"] < r["hi"] and r["n"] == 4


def test_extrapolation_recovers_the_sampled_k(spark):
    cells = spark.createDataFrame([("x", p, 100, c) for p, c in enumerate((0, 10, 50, 90, 100))], "g string, problem_id long, n long, c long")
    got = {r["k"]: r["pass_at_k"] for r in metrics.extrapolate(cells, ["g"], [1, 10, 500]).collect()}
    assert abs(got[1] - 0.5) < 1e-9 and got[1] < got[10] < got[500] < 1
    alike = spark.createDataFrame([("x", p, 10, 5) for p in range(4)], "g string, problem_id long, n long, c long")
    assert abs(metrics.extrapolate(alike, ["g"], [3]).first()["pass_at_k"] - 0.875) < 1e-9


def test_filters_reach_the_scan(spark):
    from tallyspark.plans.catalog import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for chosen in (t.chosen("rl"), t.chosen("base", "T"), t.chosen(conditions="DE")):
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan
