"""Every reader on written fixtures, in every format that can hold its schema."""

from decimal import Decimal

import pytest

from tallyspark.sources import images, readers, schemas

ROWS = {
    "problems": (schemas.PROBLEMS, [(1, "train", "a, b", None, Decimal("1.5000000000"), None, "{}", None, None), (2, "eval", None, None, None, 1, None, "x^2", "2.png")]),
    "samples": (schemas.SAMPLES, [("3B", "rl", 0, "T", Decimal("0.70"), 1, 0, "so #### 2", 12), ("3B", "base", None, "E", None, 2, 1, None, 0)]),
    "transcriptions": (schemas.TRANSCRIPTIONS, [("3B", "rl", 0, 1, 0, "heard \"x\""), ("3B", "rl", None, 2, 1, None)]),
    "rollouts": (schemas.ROLLOUTS, [(0, 1, 2, 3, 1.0, 5), (0, 1, 2, None, None, 5)]),
    "checkpoints": (schemas.CHECKPOINTS, [("3B", 0, 100, 0.25), ("3B", 1, 100, None)]),
    "reviews": (schemas.REVIEWS, [(1, "T", "sound"), (2, "E", None)]),
    "config": (schemas.CONFIG, [("r1", 0, {"k": "v"}), ("r2", 1, {})]),
}
CSV = {"samples", "transcriptions", "rollouts", "checkpoints", "reviews"}


def write(spark, tmp_path, name, kind):
    schema, rows = ROWS[name]
    path = f"file://{tmp_path}/{name}.{kind}"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    (df.write.option("header", True) if kind == "csv" else df.write).format(kind).save(path)
    return path, rows


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
@pytest.mark.parametrize("name", list(ROWS))
def test_reader(spark, tmp_path, name, kind):
    load = getattr(readers, f"load_{name}")
    if kind == "csv" and name not in CSV:
        with pytest.raises(ValueError, match="CSV"):
            load(spark, f"file://{tmp_path}/{name}.csv")
        return
    path, rows = write(spark, tmp_path, name, kind)
    df = load(spark, path, images=True).drop("typed") if name == "problems" else load(spark, path)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, rows))


def test_problems_without_images_and_by_split(spark, tmp_path):
    path, _ = write(spark, tmp_path, "problems", "parquet")
    df = readers.load_problems(spark, path, split="eval")
    assert "image" not in df.columns and [r["problem_id"] for r in df.collect()] == [2]


def test_weights_by_table_and_by_file(spark, tmp_path):
    rows = [(0, "before", "a", "m", "1")]
    spark.createDataFrame(rows, schemas.WEIGHTS).write.parquet(f"file://{tmp_path}/w.parquet")
    assert [tuple(r) for r in readers.weight_manifest(spark, f"file://{tmp_path}/w.parquet").collect()] == rows
    (tmp_path / "t").mkdir()
    for name, data in (("a.bin", b"x"), ("b.bin", b"y")):
        (tmp_path / "t" / name).write_bytes(data)
    got = readers.file_manifest(spark, f"file://{tmp_path}/t", "after").collect()
    assert {(r["phase"], r["param_key"]) for r in got} == {("after", "a.bin"), ("after", "b.bin")} and len({r["digest"] for r in got}) == 2


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_report(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.0)], "name string, value double")
    assert sorted(map(tuple, readers.write_report(df, f"file://{tmp_path}/r", fmt).collect())) == [("a", 1.5), ("b", 2.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pictures_are_read_only_when_asked_for(spark, tmp_path):
    (tmp_path / "p" / "a b").mkdir(parents=True)
    for name, data in (("1.png", b"one"), ("a b/2+3%.png", b"two"), ("unused.png", b"x")):
        (tmp_path / "p" / name).write_bytes(data)
    rows = [(1, "1.png"), (2, "a b/2+3%.png"), (3, "missing.png"), (4, None)]
    path = f"file://{tmp_path}/problems.parquet"
    spark.createDataFrame(rows, "problem_id long, image_path string").write.parquet(path)
    df = readers.load_problems(spark, path, images=f"file://{tmp_path}/p")
    assert {r["problem_id"]: (r["image_bytes"], r["image"] and bytes(r["image"])) for r in df.collect()} == {1: (3, b"one"), 2: (3, b"two"), 3: (None, None), 4: (None, None)}
    lengths = plan(df.select("problem_id", "image_bytes"))
    assert "content" not in lengths and "length" in lengths
    assert "content" in plan(df.select("image"))
    written = f"file://{tmp_path}/w"
    images.write(spark.createDataFrame([("x/y z.bin", b"data"), ("e.bin", None)], "image_path string, image binary"), written).collect()
    assert [(r["image_path"], bytes(r["image"])) for r in images.load(spark, written).where("image_bytes > 0").collect()] == [("x/y z.bin", b"data")]


def partitioned(spark, tmp_path):
    rows = [("3B", m, 0, c, Decimal("0.70"), p, 0, "#### 1", 9) for m in ("base", "rl") for c in "TDE" for p in range(20)]
    readers.write_samples(spark.createDataFrame(rows, schemas.SAMPLES), f"file://{tmp_path}/samples")
    return rows, readers.load_samples(spark, f"file://{tmp_path}/samples")


def test_samples_by_folder_prune_by_filters(spark, tmp_path):
    rows, df = partitioned(spark, tmp_path)
    assert sorted(map(tuple, df.select(*[f.name for f in spark.createDataFrame(rows[:1], schemas.SAMPLES).schema]).collect())) == sorted(rows)
    some = df.where("model = 'rl' AND condition IN ('T', 'E')")
    filters = plan(some).split("PartitionFilters: [")[1].split("]")[0]
    assert "model" in filters and "condition" in filters and some.count() == 40
    assert "DataFilters: []" in plan(some)  # no row is looked at to decide


def test_samples_by_folder_prune_by_a_join(spark, tmp_path):
    _, df = partitioned(spark, tmp_path)
    spark.createDataFrame([("T", "text"), ("D", "image"), ("E", "image")], "condition string, modality string").write.parquet(f"file://{tmp_path}/conditions")
    conditions = spark.read.parquet(f"file://{tmp_path}/conditions").where("modality = 'text'")
    joined = df.join(conditions, "condition")
    assert joined.count() == 40
    assert "dynamicpruning" in plan(joined).split("PartitionFilters: [")[1].split("\n")[0]


def test_answers_of_both_kinds(spark, tmp_path):
    rows = [(1, Decimal(5), None), (2, None, "\\\\dfrac{1}{2}"), (3, None, "1,000"), (4, None, None)]
    path = f"file://{tmp_path}/math.json"
    spark.createDataFrame(rows, "problem_id long, answer decimal(38,10), answer_text string").write.json(path)
    got = {r["problem_id"]: r["typed"] and (r["typed"]["number"], r["typed"]["text"]) for r in readers.load_problems(spark, path).collect()}
    assert got[1] == (Decimal(5), None) and got[3] == (Decimal(1000), None) and got[4] is None and "frac{1}{2}" in got[2][1]
