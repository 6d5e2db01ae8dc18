"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's result as Parquet in the shared folder and reads it again as the next one's
docs, so a lost executor repeats one stage's tasks at most.  All stages but the last
return the columns of ``documents``.

Null and empty texts are clean, have no lines, equal each other and pack as the end id.
Null doc_ids come after all others and stay.  Repeated rows and ties share every decision
until the near-duplicate stage keeps one of them.  Very long texts are read whole.  Extra
columns are kept, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import decontaminate, lines, packing, similar, storage, toxicity
from tallyspark.llm.queries import benchmark, documents, labels, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds go from the later one; every
    document stays, if need be with an empty text."""
    return lines.rewrite(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word similarity of 0.8 stays: SimHash
    finds the links at its anchors, homes against replicas, within 2 bits and, by wider
    fingerprints, in more; they are verified on whole sets, and an exact check follows."""
    return similar.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, benchmark(spark, sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in padded sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("decontaminate", drop_benchmark),
    ("packing", pack_sequences),
]

#: Token ids, nearest-neighbour votes and fingerprints have no SQL form.  Tests hold the
#: stages against brute force (lines, near-duplicates, benchmark passages, packed ids) and
#: toxicity against the exact scores of its own search.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, path = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, new = storage.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if path:
            storage.drop(spark, path)
        path = new
    return STAGES[-1][1](spark, docs, sf_dir)
