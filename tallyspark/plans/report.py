"""The plan's result tables 1 to 11 from one table of counts, and a report that is whole or
not there."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.operators import controls, metrics, stats
from tallyspark.sources import readers

CELL = ["model_family", "model", "seed", "condition", "problem_id"]
#: Result table -> the columns that name its rows; all others are its figures.
KEYS = {
    "text_gain": ["seed", "condition", "k"], "pixel_gain": ["seed", "condition", "k"], "curves": ["model", "condition", "k"],
    "intervals": ["seed", "k", "metric"], "seeds": ["condition", "k"], "truncation": ["model", "condition"], "families": ["model_family", "seed", "condition", "k"],
    "transcription": ["grp"], "weights": ["module"], "perception": ["seed", "condition", "perceived"], "spurious": ["condition"],
}


def cells(samples: DataFrame, cap: int = 500) -> DataFrame:
    """Counts per family, model, seed, condition and problem: samples (n), correct ones (c),
    truncated, at_cap, and right transcriptions (heard) where samples say ``match``.  One
    pass over the samples; every count-based table is a sum of these."""
    at_cap = F.col("n_tokens") >= cap
    heard = F.count_if("match") if "match" in samples.columns else F.lit(0).cast("long")
    return samples.groupBy(*CELL).agg(
        F.count("*").alias("n"), F.count_if("correct").alias("c"), F.count_if(at_cap & ~F.col("answered")).alias("truncated"), F.count_if(at_cap).alias("at_cap"), heard.alias("heard"))


def tables(
    counts: DataFrame,
    heard: DataFrame | None = None,
    weights: DataFrame | None = None,
    traces: DataFrame | None = None,
    reviews: DataFrame | None = None,
    transcribed: bool = False,
    ks: tuple[int, ...] = (1, 8, 64),
    replicates: int = 200,
) -> dict[str, DataFrame]:
    """Result tables by name, of ``cells``; those whose inputs are not given are left out.

    ``heard`` pairs what the model transcribed (heard) with the problem; ``transcribed``: the
    cells of condition D count right transcriptions."""
    ks_ = list(ks)
    gains = metrics.deltas(counts, [1])
    share = lambda c: (F.sum(c) / F.sum("n")).alias(c)
    out = {
        "text_gain": gains.where("condition = 'T'"),
        "pixel_gain": gains.where("condition IN ('D', 'E')"),
        "curves": metrics.curve(counts, ["model", "condition"], ks_),
        "intervals": stats.intervals(metrics.problem_pivot(counts, ks_), metrics.GAINS, replicates),
        "seeds": stats.across_seeds(metrics.deltas(counts, ks_), "delta", ["condition", "k"]),
        "truncation": counts.groupBy("model", "condition").agg(share("truncated"), share("at_cap"), F.sum("n").alias("n")),
        "families": metrics.deltas(counts, [1], ["model_family"]),
    }
    if heard is not None:
        out["transcription"] = controls.transcription_accuracy(heard, [c for c in heard.columns if c not in ("heard", "problem")])
    if weights is not None:
        compared = controls.weight_diff(weights)
        out["weights"] = compared.groupBy("module").agg(F.bool_and("identical").alias("frozen"), F.count_if(~F.col("identical")).alias("n_changed"), F.count("*").alias("n_params"))
    if transcribed:
        seen = counts.where("condition = 'D' AND model = 'rl'").groupBy("problem_id").agg((F.sum("heard") / F.sum("n") > 0.5).alias("perceived"))
        d = metrics.model_pairs(counts, [1]).join(seen, "problem_id")
        out["perception"] = d.groupBy("seed", "condition", "perceived").agg(F.avg("d").alias("delta"), F.count("d").alias("n_problems"))
    if traces is not None and reviews is not None:
        out["spurious"] = controls.spurious_rates(traces, reviews, ["condition"])
    return out


def figures(made: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_key, figure, value): all figures of all tables, one a row."""
    rows = None
    for name, df in made.items():
        keys = KEYS[name]
        key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in keys))
        each = F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in df.columns if c not in keys))
        own = df.select(F.lit(name).alias("table_name"), key.alias("row_key"), F.inline(each))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def write(made: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Every table in a folder of its own, then their list, as read back.  An old list goes
    first, so at no time does a list name tables that are not whole."""
    folder = folder.rstrip("/")
    spark = next(iter(made.values())).sparkSession
    readers.delete(spark, f"{folder}/manifest")
    out = {name: readers.write_report(df, f"{folder}/{name}", fmt) for name, df in made.items()}
    listed = [(name, fmt, df.schema.json(), df.count()) for name, df in out.items()]
    spark.createDataFrame(listed, "table_name string, format string, columns string, n_rows long").coalesce(1).write.parquet(f"{folder}/manifest")
    return out


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that a written report lists; an error while it has no list, or if a table
    has other rows than its list says."""
    folder = folder.rstrip("/")
    try:
        listed = spark.read.parquet(f"{folder}/manifest").collect()
    except AnalysisException as e:
        raise FileNotFoundError(f"{folder} holds no complete report") from e
    out = {}
    for r in listed:
        df = spark.read.schema(StructType.fromJson(json.loads(r["columns"]))).format(r["format"]).load(f"{folder}/{r['table_name']}")
        if df.count() != r["n_rows"]:
            raise ValueError(f"{folder}/{r['table_name']} has other rows than its list says")
        out[r["table_name"]] = df
    return out
