"""Window operators over training records: advantages, plateau, selection, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.metrics import count_correct, estimates


def group_advantage(rollouts: DataFrame, group: list[str], by_std: bool = True) -> DataFrame:
    """Reward relative to its group's mean, divided by the population standard deviation
    (null where all rewards are equal) unless ``by_std`` is false."""
    w = Window.partitionBy(*group)
    centred = F.col("reward") - F.avg("reward").over(w)
    return rollouts.withColumn("advantage", F.try_divide(centred, F.stddev_pop("reward").over(w)) if by_std else centred)


def plateau(checkpoints: DataFrame, changes: int = 2, epsilon: float = 0.01) -> DataFrame:
    """``stop`` where the last ``changes`` steps each moved pass1 by less than epsilon."""
    ordered = Window.partitionBy("seed").orderBy("step")
    flat = F.coalesce(F.abs(F.col("pass1") - F.lag("pass1").over(ordered)) < epsilon, F.lit(False)).cast("int")
    marked = checkpoints.withColumn("flat", flat)
    recent = ordered.rowsBetween(1 - changes, 0)
    return marked.withColumn("stop", (F.min("flat").over(recent) == 1) & (F.count("*").over(recent) == changes))


def best_per_group(rows: DataFrame, group: list[str], value: str, ties: list[str]) -> DataFrame:
    """The row of the highest value in each group (planned as a group limit)."""
    w = Window.partitionBy(*group).orderBy(F.desc(value), *ties)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def stratified_sample(rows: DataFrame, strata: list[str], size: int, key: Column) -> DataFrame:
    """Exactly ``size`` rows of each stratum (or all it has), in md5 order of the key."""
    w = Window.partitionBy(*strata).orderBy(F.md5(key), key)
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= size).drop("__rank")


def best_temperature(samples: DataFrame, ks: list[int]) -> DataFrame:
    """(model, k, temperature, rate): per model and k the temperature of the best mean
    pass@k on samples of even index, reported on those of odd index."""
    halves = count_correct(samples, ["model", "temperature", "problem_id"], (F.col("sample_idx") % 2).alias("half"))
    rates = estimates(halves, ks).groupBy("model", "temperature", "half", "k").agg(F.round(F.avg("p"), 9).alias("rate")).where("rate is not null")
    best = best_per_group(rates.where("half = 0"), ["model", "k"], "rate", ["temperature"]).select("model", "k", "temperature")
    return rates.where("half = 1").join(best, ["model", "k", "temperature"]).select("model", "k", "temperature", "rate")


def subset(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``size`` rows in md5 order of the key, the same ones whatever the partitioning."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(size)


def ordered_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints in order, numbered within their seed."""
    place = F.row_number().over(Window.partitionBy("seed").orderBy("step")).cast("long")
    return checkpoints.withColumn("position", place).orderBy("seed", "step")
