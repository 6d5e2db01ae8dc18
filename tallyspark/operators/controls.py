"""Validity controls: weight identity, difficulty, perception, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as sc


def weight_diff(manifest: DataFrame, key: str = "param_key") -> DataFrame:
    """Full outer comparison of digests before and after; a missing key is a difference."""
    before = manifest.where("phase = 'before'").select(key, F.col("module").alias("module_b"), F.col("digest").alias("before"))
    after = manifest.where("phase = 'after'").select(key, F.col("module").alias("module_a"), F.col("digest").alias("after"))
    joined = before.join(after, key, "full_outer")
    return joined.select(key, F.coalesce("module_b", "module_a").alias("module"), F.col("before").eqNullSafe(F.col("after")).alias("identical"))


def half_rates(samples: DataFrame) -> DataFrame:
    """(problem_id, t, e): the base model's accuracy in text and image mode on samples of
    even index; null where a mode has none."""
    half = samples.where("model = 'base' AND sample_idx % 2 = 0")
    rate = lambda c: F.avg(F.when(F.col("condition") == c, F.col("correct").cast("double")))
    return half.groupBy("problem_id").agg(rate("T").alias("t"), rate("E").alias("e"))


def difficulty_matched(samples: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Problems whose base accuracy in text and image mode is alike; judged on samples of
    even index so that gains measured on the odd ones are not biased by the selection."""
    return half_rates(samples).where(F.abs(F.col("t") - F.col("e")) <= tolerance)


def truncation_rates(samples: DataFrame, by: list[str], cap: int = 500) -> DataFrame:
    """Share of samples at the cap without an answer, and at the cap at all."""
    at_cap = F.col("n_tokens") >= cap
    both = at_cap & ~F.col("answered")
    return samples.groupBy(*by).agg(F.avg(both.cast("double")).alias("truncated"), F.avg(at_cap.cast("double")).alias("at_cap"), F.count("*").alias("n"))


def perception_buckets(transcribed: DataFrame) -> DataFrame:
    """(model, problem_id, perceived): the majority of a problem's transcriptions; ties
    count as not perceived."""
    return transcribed.groupBy("model", "problem_id").agg((F.avg(F.col("match").cast("double")) > 0.5).alias("perceived"))


def numbered(samples: DataFrame) -> DataFrame:
    """sample_idx within (model, condition, problem), ordered by the rows' own keys."""
    w = Window.partitionBy("model", "condition", "problem_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "n_tokens", "temperature", "correct")
    return samples.withColumn("sample_idx", F.row_number().over(w) - 1)


def join_transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, problem, transcript): each user turn with the assistant's next one."""
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("problem"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("transcript"))
    return user.join(said, ["conv_id", "turn"])


def paired_rates(samples: DataFrame, a: str, b: str, by: list[str], names: tuple[str, str]) -> DataFrame:
    """Success rates of two conditions side by side, in one aggregation; null where a
    condition has no samples."""
    rate = lambda c, name: F.avg(F.when(F.col("condition") == c, F.col("correct").cast("int"))).alias(name)
    return samples.where(F.col("condition").isin(a, b)).groupBy(*by).agg(rate(a, names[0]), rate(b, names[1]))


def lengths(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, 95th percentile and number of the samples' token counts."""
    p = lambda q: F.expr(f"percentile(n_tokens, {q})")
    return samples.groupBy(*by).agg(F.avg("n_tokens").alias("mean"), p(0.5).alias("median"), p(0.95).alias("p95"), F.count("*").alias("n"))


def transcription_accuracy(heard: DataFrame, by: list[str]) -> DataFrame:
    """Share of exact and of normalised matches of ``heard`` against ``problem``."""
    exact, normalized = sc.transcription_match(F.col("heard"), F.col("problem"))
    return heard.groupBy(*by).agg(F.avg(exact.cast("int")).alias("exact"), F.avg(normalized.cast("int")).alias("normalized"), F.count("*").alias("n"))


def spurious_rates(traces: DataFrame, reviews: DataFrame, by: list[str]) -> DataFrame:
    """Share of reviewed correct traces whose reasoning was judged spurious."""
    return traces.join(reviews, "sample_id").groupBy(*by).agg(F.avg((F.col("verdict") == "spurious").cast("int")).alias("spurious"), F.count("*").alias("n_reviewed"))


def throughput(steps: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Rows per second of the summed time; null where no time passed."""
    return steps.groupBy(*by).agg(F.try_divide(F.count("*"), F.sum(seconds)).alias("per_second"))
