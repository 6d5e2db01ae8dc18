"""pass@k metrics: counts first, estimates on the counts, pairs within a problem.

Samples are reduced to (n, c) per cell by one partial + final aggregation before any
estimate or k is expanded, so everything after it works on cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import extract_answer, is_correct, normalize_number, pass_at_k

CELL = ["model", "seed", "condition", "problem_id"]


def count_correct(samples: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """n samples and c correct ones per cell; of samples, or of finer cells (n, c)."""
    counts = (F.sum("n"), F.sum("c")) if {"n", "c"} <= set(samples.columns) else (F.count("*"), F.count_if("correct"))
    return samples.groupBy(*by, *more).agg(counts[0].alias("n"), counts[1].alias("c"))


def join_truth(samples: DataFrame, problems: DataFrame) -> DataFrame:
    """Samples with their problem's columns and ``correct``: the last number of the
    completion against the problem's ``truth``, exactly; without an answer it is wrong."""
    answer = normalize_number(extract_answer(F.col("completion")))
    return samples.join(problems, "problem_id").withColumn("correct", is_correct(answer, F.col("truth")))


def estimates(cells: DataFrame, ks: list[int]) -> DataFrame:
    """One row per cell and k with its pass@k (null where n < k)."""
    wide = cells.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return wide.withColumn("p", pass_at_k(F.col("n"), F.col("c"), F.col("k")))


def curve(samples: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """Mean pass@k over problems, with the number of problems that have one."""
    e = estimates(count_correct(samples, [*by, "problem_id"]), ks)
    return e.groupBy(*by, "k").agg(F.avg("p").alias("pass_at_k"), F.count("p").alias("n_problems"))


def model_pairs(samples: DataFrame, ks: list[int], by: list[str] | None = None) -> DataFrame:
    """RL against base within a problem and condition; base has no training seed, so it
    repeats for every seed of RL.  Columns: seed, condition, problem_id, k, p_rl, p_base, d."""
    own = [*(by or []), "condition", "problem_id"]
    rl = estimates(count_correct(samples.where("model = 'rl'"), [*own, "seed"]), ks)
    base = estimates(count_correct(samples.where("model = 'base'"), own), ks)
    joined = rl.select(*own, "seed", "k", F.col("p").alias("p_rl")).join(base.select(*own, "k", F.col("p").alias("p_base")), [*own, "k"])
    return joined.withColumn("d", F.col("p_rl") - F.col("p_base"))


def deltas(samples: DataFrame, ks: list[int], by: list[str] | None = None) -> DataFrame:
    """Mean paired difference per seed, condition and k."""
    d = model_pairs(samples, ks, by)
    return d.groupBy(*(by or []), "seed", "condition", "k").agg(F.avg("d").alias("delta"), F.count("d").alias("n_problems"))


#: Gains of a problem: text, transcribe-then-solve, pixels, and what text gains over either.
GAINS = ["dt", "dd", "dp", "did_d", "did"]


def problem_pivot(samples: DataFrame, ks: list[int]) -> DataFrame:
    """One row per seed, k and problem with the gains in conditions T, D and E, and the
    text gain less each of the other two; null where a side has too few samples."""
    d = model_pairs(samples, ks)
    of = lambda c: F.max(F.when(F.col("condition") == c, F.col("d")))
    wide = d.groupBy("seed", "k", "problem_id").agg(of("T").alias("dt"), of("D").alias("dd"), of("E").alias("dp"))
    return wide.withColumn("did_d", F.col("dt") - F.col("dd")).withColumn("did", F.col("dt") - F.col("dp"))


def agreement(per_group: DataFrame, value: str, by: list[str], digits: int = 9) -> DataFrame:
    """Do all groups' values have one sign?  Values are compared to ``digits`` places, so
    a sum's last bits decide nothing."""
    return per_group.groupBy(*by).agg((F.countDistinct(F.signum(F.round(value, digits))) == 1).alias("agree"))


def extrapolate(cells: DataFrame, by: list[str], ks: list[int]) -> DataFrame:
    """pass@k beyond the sample size (an extension: the plan names no formula).

    Problems' success rates are taken as Beta distributed, with the mean and the
    intraclass correlation of the observed counts (n, c) by moments; pass@k is one less
    the mean chance of k failures, prod (b+i)/(a+b+i).  Without dispersion beyond
    sampling noise: 1 - (1-mean)^k."""
    rate = F.col("c") / F.col("n")
    g = cells.where("n > 0").groupBy(*by).agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("w"), F.count("*").alias("n_problems"))
    g = g.withColumn("rho", F.try_divide(F.try_divide(F.col("v"), F.col("m") * (1 - F.col("m"))) - F.col("w"), 1 - F.col("w")))
    g = g.withColumn("size", F.when(F.col("rho") > 1e-9, 1 / F.col("rho") - 1)).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    fail = F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), F.lit(1.0), lambda x, i: x * ((1 - F.col("m")) * F.col("size") + i) / (F.col("size") + i))
    return g.select(*by, "k", F.when(F.col("size").isNull(), 1 - F.pow(1 - F.col("m"), F.col("k"))).otherwise(1 - fail).alias("pass_at_k"), "n_problems")


def condition_gap(samples: DataFrame, a: str, b: str, ks: list[int]) -> DataFrame:
    """Mean paired gap a - b per model, seed and k, by conditional aggregation."""
    cells = samples.where(F.col("condition").isin(a, b)).groupBy("model", "seed", "problem_id").agg(*(x for c in (a, b) for x in (F.count_if(F.col("condition") == c).alias(f"n_{c}"), F.count_if((F.col("condition") == c) & F.col("correct")).alias(f"c_{c}"))))
    wide = cells.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    p: dict[str, Column] = {c: pass_at_k(F.col(f"n_{c}"), F.col(f"c_{c}"), F.col("k")) for c in (a, b)}
    gap = wide.withColumn("gap", p[a] - p[b])
    return gap.groupBy("model", "seed", "k").agg(F.avg("gap").alias("gap"), F.count("gap").alias("n_problems"))
