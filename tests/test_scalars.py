"""Scalar semantics: extraction table, exact pass@k, golden figures, verdicts."""

from decimal import Decimal
from math import comb

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as sc


@pytest.mark.parametrize(
    ("text", "answer", "number"),
    [
        ("no marker 12", None, None), ("#### 7", "7", Decimal(7)), ("#### 1 then #### 1,234.50 done", "1,234.50", Decimal("1234.5")),
        ("####-3.25", "-3.25", Decimal("-3.25")), ("#### 1,000", "1,000", Decimal(1000)), ("", None, None), (None, None, None), ("#### abc", None, None),
    ],
)
def test_extraction(spark, text, answer, number):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(sc.extract_answer(F.col("t")).alias("a"), sc.normalize_number(sc.extract_answer(F.col("t"))).alias("n")).first()
    assert got["a"] == answer and got["n"] == number


def test_pass_at_k_is_exact(spark):
    rows = [(n, c, k) for n in range(1, 41) for c in range(n + 1) for k in (1, 2, 8, 16)]
    df = spark.createDataFrame(rows, "n long, c long, k int").select("n", "c", "k", sc.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("p"))
    for n, c, k, p in df.collect():
        if n < k:
            assert p is None
        else:
            assert abs(p - (1 - comb(n - c, k) / comb(n, k))) < 1e-12


def test_missing_answers_are_wrong_and_truncation_needs_no_answer(spark):
    df = spark.createDataFrame([(Decimal(1), Decimal(1), 500), (None, Decimal(1), 500), (None, Decimal(1), 499)], "p decimal(38,10), t decimal(38,10), n int")
    got = df.select(sc.is_correct(F.col("p"), F.col("t")).alias("c"), sc.is_truncated(F.col("n"), F.col("p")).alias("x"), sc.reward(sc.is_correct(F.col("p"), F.col("t"))).alias("r")).collect()
    assert [tuple(r) for r in got] == [(True, False, 1), (False, True, 0), (False, False, 0)]


def test_published_deltas(spark):
    df = spark.createDataFrame([(12.30, 17.32, 32.91, 39.92)], "b1 double, r1 double, b2 double, r2 double")
    pixel, text = F.col("r1") - F.col("b1"), F.col("r2") - F.col("b2")
    row = df.select(F.round(pixel, 2), F.round(text, 2), F.round(sc.survival_ratio(pixel, text), 4)).first()
    assert tuple(row) == (5.02, 7.01, 0.7161)
    assert df.select(sc.survival_ratio(pixel, F.lit(0.0))).first()[0] is None


@pytest.mark.parametrize(
    ("bounds", "label"),
    [
        ((-1, 1, 0, 1, 0, 1), "no_reference_gain"), ((1, 2, -2, -1, 1, 2), "D"), ((1, 2, 0.5, 1, 0.1, 1), "C"),
        ((1, 2, 0.5, 1, -0.1, 1), "B"), ((1, 2, 2, 3, -2, -1), "exceeds"), ((1, 2, -1, 1, 0.1, 1), "A"), ((1, 2, -1, 1, -1, 1), "noise"),
    ],
)
def test_outcomes(spark, bounds, label):
    c = [F.lit(float(x)) for x in bounds]
    assert spark.range(1).select(sc.outcome((c[0], c[1]), (c[2], c[3]), (c[4], c[5]))).first()[0] == label


def test_normalization_keeps_numbers(spark):
    df = spark.createDataFrame([("  It's -3.5,  OR so! ", "its -3.5 or so"), (None, "x")], "a string, b string")
    got = df.select(*(c.alias(str(i)) for i, c in enumerate(sc.transcription_match(F.col("a"), F.col("b"))))).collect()
    assert [tuple(r) for r in got] == [(False, True), (False, False)]


@pytest.mark.parametrize(
    ("said", "truth", "matches"),
    [
        (r"so \boxed{\dfrac{1}{2}}.", r"$\frac{1}{2}$", True), (r"\boxed{x^{2}+\{1\}}", r"x^{2} + \{1\}", True), (r"\boxed{1,234.50}", "1234.5", True),
        (r"\boxed{3} then \boxed{\text{Evelyn}}", "Evelyn", True), (r"\boxed{\left( 3, \frac{\pi}{2} \right)}", r"(3,\frac{\pi}{2})", True),
        ("#### 7", "7.0", True), (r"\boxed{0.5}", r"\frac{1}{2}", False), (r"\boxed{evelyn}", "Evelyn", False), (r"\boxed{}", "1", False), ("no answer", "1", False),
        (None, "1", False), (r"\boxed{1}", None, False), (r"\boxed{12}", r"12^\circ", False),
    ],
)
def test_typed_answers(spark, said, truth, matches):
    df = spark.createDataFrame([(said, truth)], "s string, t string")
    assert df.select(sc.answers_match(sc.typed_answer(sc.extract_boxed(F.col("s"))), sc.typed_answer(F.col("t")))).first()[0] is matches
