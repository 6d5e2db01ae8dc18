"""Phase gates and the verdict: one-row frames built from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as sc
from tallyspark.operators import metrics, stats


def outcomes(wide: DataFrame, replicates: int) -> DataFrame:
    """(seed, k, bounds..., outcome) from the pivot of ``metrics.problem_pivot``."""
    ci = stats.intervals(wide, ["dt", "dp", "did"], replicates)
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
    bounds = ci.groupBy("seed", "k").agg(*(of(m, c) for m in ("dt", "dp", "did") for c in ("lo", "hi")))
    pair = lambda m: (F.col(f"{m}_lo"), F.col(f"{m}_hi"))
    return bounds.withColumn("outcome", sc.outcome(pair("dt"), pair("dp"), pair("did")))


def equivalence(wide: DataFrame, replicates: int, margin: float = 0.02) -> DataFrame:
    """Per condition's gain two separate flags: the interval holds 0; it lies inside the margin."""
    ci = stats.intervals(wide, ["dt", "dd", "dp"], replicates)
    zero = (F.col("lo") <= 0) & (F.col("hi") >= 0)
    inside = (F.col("lo") >= -margin) & (F.col("hi") <= margin)
    return ci.select("seed", "k", "metric", zero.alias("contains_zero"), inside.alias("inside_margin"))


def sharpening(wide: DataFrame, replicates: int, margin: float = 0.02) -> DataFrame:
    """Is text-mode pass@k the same after training?"""
    ci = stats.intervals(wide, ["dt"], replicates)
    inside = (F.col("lo") >= -margin) & (F.col("hi") <= margin)
    return ci.select("seed", "k", F.lit("sharpening").alias("gate"), F.greatest(F.abs("lo"), F.abs("hi")).alias("value"), F.lit(margin).alias("threshold"), inside.alias("passed"))


def truncation_asymmetry(samples: DataFrame, cap: int = 500, z: float = 1.96) -> DataFrame:
    """Does RL reach the cap more often than base beyond sampling error?"""
    x = (F.col("n_tokens") >= cap).cast("int")
    of = lambda m: F.when(F.col("model") == m, x)
    rates = samples.groupBy("condition").agg(F.avg(of("rl")).alias("rl"), F.avg(of("base")).alias("base"), F.count(of("rl")).alias("nr"), F.count(of("base")).alias("nb"))
    se = F.sqrt(F.try_divide(F.col("rl") * (1 - F.col("rl")), F.col("nr")) + F.try_divide(F.col("base") * (1 - F.col("base")), F.col("nb")))
    difference = F.col("rl") - F.col("base")
    return rates.select("condition", difference.alias("difference"), se.alias("se"), (difference - z * se > 0).alias("raise_cap"))


def phrase_rates(texts: DataFrame, phrase: str, by: list[str], short: int = 20) -> DataFrame:
    """How often a phrase occurs, and how many texts are near-empty."""
    rate = lambda c: F.avg(c.cast("int"))
    return texts.groupBy(*by).agg(rate(F.contains(F.lower("text"), F.lit(phrase))).alias("phrase_rate"), rate(F.length(F.trim("text")) < short).alias("near_empty"), F.count("*").alias("n"))


def headroom(samples: DataFrame, low_k: int = 1, high_k: int = 16, margin: float = 0.05, floor: float = 0.02) -> DataFrame:
    """Can sampling more often still find answers that the first try misses?"""
    cells = metrics.count_correct(samples.where("model = 'base'"), ["model_family", "problem_id"])
    p = lambda k: F.avg(sc.pass_at_k(F.col("n"), F.col("c"), k))
    rates = cells.groupBy("model_family").agg(p(low_k).alias("p1"), p(high_k).alias("p16"))
    gain = F.col("p16") - F.col("p1")
    return rates.select("model_family", gain.alias("headroom"), F.col("p16").alias("pass16"), ((gain > margin) & (F.col("p16") > floor)).alias("passed"))


def report(samples: DataFrame, weights: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The gates that must hold before results are read, a row each.  ``base``: the base
    model's samples, where the caller can filter them at the scan."""
    base = metrics.count_correct(samples.where("model = 'base'") if base is None else base, ["condition", "problem_id"])
    p = F.avg(F.col("c") / F.col("n"))
    row = lambda gate, df, value, threshold, passed: df.agg(F.lit(gate).alias("gate"), value.alias("value"), F.lit(float(threshold)).alias("threshold"), passed.alias("passed"), F.count("*").alias("evidence_n"))
    truncated = F.avg(((F.col("n_tokens") >= 500) & ~F.col("answered")).cast("int"))
    changed = F.count_if(~F.col("identical")).cast("double")
    return (
        row("calibration", base, p, 0.01, sc.calibration_ok(p))
        .unionByName(row("truncation", samples, truncated, 0.05, truncated < 0.05))
        .unionByName(row("manipulation", weights, changed, 0, F.bool_and("identical")))
    )
