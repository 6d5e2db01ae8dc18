"""Readers and the report writer.  Schemas are fixed, so no pass infers them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scalars import typed_answer
from tallyspark.sources import images as pictures
from tallyspark.sources import schemas

_OWN: list[str] = []


def _load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet, or JSON, CSV (with a header) or ORC by the path's ending."""
    kind = next((k for k in ("json", "csv", "orc") if path.rstrip("/").endswith(f".{k}")), "parquet")
    if kind == "csv" and ("map<" in schema or " binary" in schema):
        raise ValueError("CSV holds neither maps nor binary columns; use JSON, Parquet or ORC")
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def load_problems(spark: SparkSession, path: str, images: bool | str = False, split: str | None = None) -> DataFrame:
    """Problems with their typed answer (``scalars.typed_answer``): ``answer_text`` where it
    is given, else the number ``answer``.

    ``images`` True: the pictures of the table's own binary column; a folder: the files that
    ``image_path`` names there; False: no picture is ever read."""
    df = _load(spark, path, schemas.PROBLEMS)
    df = df if images is True else df.drop("image")
    df = df.where(F.col("split") == split) if split else df
    df = df.withColumn("typed", typed_answer(F.coalesce("answer_text", F.col("answer").cast("string"))))
    return pictures.join(df, pictures.load(spark, images)) if isinstance(images, str) else df


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples in one table, or in the layout of ``write_samples``: there filters and joins
    on model and condition read the matching folders alone."""
    return _load(spark, path, schemas.SAMPLES)


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples in folders by model and condition.  Each folder's rows stay in as many files
    as tasks that have some, so a large condition is written by many tasks."""
    samples.write.partitionBy("model", "condition").parquet(path)


def load_transcriptions(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.TRANSCRIPTIONS)


def load_rollouts(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.ROLLOUTS)


def load_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.CHECKPOINTS)


def load_reviews(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.REVIEWS)


def load_config(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.CONFIG)


def weight_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.WEIGHTS)


def file_manifest(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """(phase, param_key, digest) of one file per tensor; Spark passes over empty files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.lit(phase).alias("phase"), F.element_at(F.split("path", "/"), -1).alias("param_key"), F.sha2("content", 256).alias("digest"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share;
    in a temporary folder where it is unset and the master is local (removed at exit)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tallyspark-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = f"file://{_OWN[0]}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder once, for plans that read it several times; as
    read back, with its path for ``delete``."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more (through Spark's file systems, so by the
    JVM of a classic session)."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_report(df: DataFrame, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Write a result table and return it as read back; without a path, in the shared folder."""
    spark = df.sparkSession
    path = path or shared_path(spark, "report")
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)
