"""The written report against the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import catalog, report
from tallyspark.sources import readers

DATA = "/root/testdata/sf0.001"


def rows(df, columns):
    return sorted(repr(tuple(round(v, 3) if isinstance(v, float) else v for v in r)) for r in df.select(*columns).collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_report(spark, tmp_path):
    t = catalog.Tables(spark, DATA)
    heard = t.transcripts.select("problem", F.col("transcript").alias("heard"), (F.col("turn") % 4).alias("grp"))
    counts, _ = readers.staged_at(report.cells(t.chosen().withColumn("match", F.col("l_partkey") % 2 == 0)), "cells")
    made = report.tables(counts, heard, t.weights, t.correct_traces, t.reviews, True, ks=(1, 8), replicates=20)
    assert len(made) == 11 and set(made) == set(report.KEYS)
    got = report.write(made, f"file://{tmp_path}/r")
    for name, query in (("text_gain", "ag_delta_text"), ("pixel_gain", "ag_delta_pixel"), ("weights", "ag_manip"), ("truncation", "ag_trunc"), ("spurious", "ag_spurious"), ("seeds", "ag_seed"), ("perception", "ag_percep")):
        expected = catalog.QUERIES[query](spark, DATA)
        assert rows(got[name], expected.columns) == rows(expected, expected.columns), name
    back = report.read(spark, f"file://{tmp_path}/r")
    assert {n: df.count() for n, df in back.items()} == {n: df.count() for n, df in got.items()}
    assert set(report.tables(counts)) == {"text_gain", "pixel_gain", "curves", "intervals", "seeds", "truncation", "families"}
    # All count-based tables read the counts, none the samples.
    for name in ("text_gain", "curves", "seeds", "truncation", "families", "perception"):
        assert "lineitem" not in made[name]._jdf.queryExecution().executedPlan().toString(), name


def test_half_written_reports_are_not_read(spark, tmp_path):
    a = spark.createDataFrame([(0, "T", 1, 0.5)], "seed int, condition string, k int, delta double")
    bad = a.withColumn("delta", F.raise_error(F.lit("stopped")).cast("double"))
    folder = f"file://{tmp_path}/r"
    with pytest.raises(Exception, match="stopped"):
        report.write({"text_gain": a, "pixel_gain": bad}, folder)
    with pytest.raises(FileNotFoundError):
        report.read(spark, folder)
    report.write({"text_gain": a, "pixel_gain": a}, folder)
    assert len(report.read(spark, folder)) == 2
    with pytest.raises(Exception, match="stopped"):
        report.write({"text_gain": bad, "pixel_gain": a}, folder)  # an old list does not outlive its tables
    with pytest.raises(FileNotFoundError):
        report.read(spark, folder)
    report.write({"text_gain": a}, folder)
    a.unionByName(a).write.mode("overwrite").parquet(f"{folder}/text_gain")
    with pytest.raises(ValueError, match="other rows"):
        report.read(spark, folder)
