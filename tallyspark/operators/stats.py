"""Deterministic paired cluster bootstrap, Bayesian intervals, summaries across seeds.

A draw is a pure function of (replicate, position), taken from md5, so results do not
depend on partitioning and can be repeated by any other engine.  Problems are drawn,
keeping everything a problem has together; all metrics share the draws.

A problem's weights in all replicates are one array: the replicates that drew it, each as
often as it did.  It is joined to the problem's rows once, and opened inside the task that
adds them up, so that partial sums are all that is exchanged, whatever the number of
replicates.  The points are replicate -1, which draws every problem once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.metrics import count_correct
from tallyspark.sources.readers import delete, staged_at

BY = ["seed", "k"]
#: Bits of monotonically_increasing_id that count rows within a partition.
ROW_BITS = 33


def ranged(rows: DataFrame, key: str, parts: int | None = None) -> tuple[DataFrame, str]:
    """(key, part, place): distinct keys of any type that has an order, in ranges, with the
    place within the range.  The ranges are staged, so that all readers see the same ones;
    the table and its path."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Keys are made distinct within the ranges: their copies meet there anyway.
    ordered = rows.select(key).dropna().repartitionByRange(parts, key).groupBy(key).agg(F.lit(1).alias("one")).sortWithinPartitions(key)
    at = F.monotonically_increasing_id()
    return staged_at(ordered.select(key, F.shiftright(at, ROW_BITS).cast("int").alias("part"), at.bitwiseAND((1 << ROW_BITS) - 1).alias("place")), "numbers")


def numbered(rows: DataFrame, key: str = "problem_id", parts: int | None = None) -> tuple[DataFrame, str]:
    """(key, i, n_<keys>): distinct keys numbered in order from 0, and their number; with the
    path of the table behind it.  Prefix sums run over the ranges' sizes, a row a range."""
    own, path = ranged(rows, key, parts)
    sizes = own.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("n_problems"))
    return own.join(F.broadcast(before), "part").select(key, (F.col("before") + F.col("place")).cast("long").alias("i"), "n_problems"), path


def draws(problems: DataFrame, replicates: int) -> DataFrame:
    """(i, drawn): the replicates that draw problem i of ``numbered`` problems, with
    repetition; problems that none draws have no row."""
    each = problems.select("i", "n_problems").select("n_problems", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    text = F.substring(F.md5(F.concat(F.col("b").cast("string"), F.lit(":"), F.col("j").cast("string"))), 1, 8)
    i = F.pmod(F.conv(text, 16, 10).cast("long"), F.col("n_problems"))
    return each.select(i.alias("i"), F.col("b").cast("short").alias("b")).groupBy("i").agg(F.collect_list("b").alias("drawn"))


def gains_at(wide: DataFrame) -> tuple[DataFrame, str]:
    """``wide`` staged for its readers, dealt out by problem: every row is opened to as many
    as there are replicates, so few rows are work for all cores."""
    parts = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged_at(wide.repartition(parts, "problem_id"), "gains")


def weighted(wide: DataFrame, replicates: int) -> tuple[DataFrame, list[str]]:
    """``wide`` with ``drawn``, its problem's replicates and -1, and the tables behind it."""
    problems, path = numbered(wide)
    lists = problems.select("problem_id", "i").join(draws(problems, replicates), "i", "left")
    every = F.concat(F.array(F.lit(-1).cast("short")), F.coalesce("drawn", F.array().cast("array<smallint>")))
    return wide.join(lists.select("problem_id", every.alias("drawn")), "problem_id"), [path]


def totals(wide: DataFrame, metrics: list[str], replicates: int, by: list[str]) -> tuple[DataFrame, list[str]]:
    """(by, b, mean and number of each metric): one partial and final aggregation over all
    replicates; b = -1 holds the points."""
    rows, paths = weighted(wide, replicates)
    each = rows.select(*by, *metrics, F.explode("drawn").alias("b"))
    sums = [x for m in metrics for x in (F.avg(m).alias(m), F.count(m).alias(f"n_{m}"))]
    return each.groupBy(*by, "b").agg(*sums), paths


def replicate_means(wide: DataFrame, metrics: list[str], replicates: int, by: list[str] | None = None) -> DataFrame:
    """Mean of each metric in each replicate, per ``by``.  The result, a row per replicate
    and group, is staged; the tables it was made from are deleted."""
    by, (wide, gains) = by or BY, gains_at(wide)
    means, paths = totals(wide, metrics, replicates, by)
    made, _ = staged_at(means.where("b >= 0").select(*by, "b", *metrics), "replicates")
    delete(wide.sparkSession, gains, *paths)
    return made


def intervals(wide: DataFrame, metrics: list[str], replicates: int = 200, level: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """(by, metric, point, lo, hi, se, n): percentile intervals of the metrics' means.

    ``wide`` is written once for its two readers and deleted, as are the numbers.  The
    result has a row per group and metric, whatever the problems and replicates; those rows
    go through the driver, so that nothing is left behind."""
    spark = wide.sparkSession
    by, (wide, gains) = by or BY, gains_at(wide)
    means, paths = totals(wide, metrics, replicates, by)
    a, value = (1 - level) / 2, {}
    for m in metrics:
        drawn, point = F.when(F.col("b") >= 0, F.col(m)), F.col("b") < 0
        value[m] = F.struct(F.lit(m).alias("metric"), F.max(F.when(point, F.col(m))).alias("point"), F.percentile(drawn, a).alias("lo"), F.percentile(drawn, 1 - a).alias("hi"), F.stddev_samp(drawn).alias("se"), F.max(F.when(point, F.col(f"n_{m}"))).alias("n"))
    found = means.groupBy(*by).agg(F.array(*value.values()).alias("x")).select(*by, F.inline("x"))
    rows = found.collect()
    delete(spark, gains, *paths)
    return spark.createDataFrame(rows, found.schema)


def bayes_intervals(samples: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """(seed, condition, point, lo, hi, n): Bayesian intervals of the mean pass@1 gain.

    Each cell's success rate has the Beta posterior of a uniform prior; a problem's gain
    is the difference of two of them.  The mean over problems sums many independent
    posteriors, so its interval is the normal one of their exact means and variances."""
    posterior = lambda df, keys, name: count_correct(df, keys).select(
        *keys, ((F.col("c") + 1) / (F.col("n") + 2)).alias(f"m_{name}"), ((F.col("c") + 1) * (F.col("n") - F.col("c") + 1) / ((F.col("n") + 2) * (F.col("n") + 2) * (F.col("n") + 3))).alias(f"v_{name}"))
    rl = posterior(samples.where("model = 'rl'"), ["condition", "problem_id", "seed"], "rl")
    base = posterior(samples.where("model = 'base'"), ["condition", "problem_id"], "base")
    g = rl.join(base, ["condition", "problem_id"]).groupBy("seed", "condition").agg(
        F.avg(F.col("m_rl") - F.col("m_base")).alias("point"), F.sum(F.col("v_rl") + F.col("v_base")).alias("v"), F.count("*").alias("n"))
    half = F.lit(z) * F.sqrt("v") / F.col("n")
    return g.select("seed", "condition", "point", (F.col("point") - half).alias("lo"), (F.col("point") + half).alias("hi"), "n")


def across_seeds(per_seed: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and spread of per-seed values; samples are never pooled over seeds."""
    v = F.col(value)
    return per_seed.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n_seeds"))
