"""Pictures as files beside the problems, joined by path.

Spark lists and reads them; a plan that does not ask for ``content`` reads no picture.  A
problem names its picture by the path below the folder.  Empty files count as missing,
since Spark's reader passes over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(image_path, image_bytes, image): every file below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.substring_index("path", f"{urlparse(folder).path.rstrip('/')}/", -1)
    return files.select(below.alias("image_path"), F.col("length").alias("image_bytes"), F.col("content").alias("image"))


def join(problems: DataFrame, images: DataFrame) -> DataFrame:
    """Problems (image_path) with their picture; without one its columns are null."""
    return problems.join(images, "image_path", "left")


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Files from rows (image_path, image), each by the task that holds its row; their
    paths.  A repeated task writes the same bytes to the same place."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        local = urlparse(folder).scheme in ("", "file")
        files, root = (fs.LocalFileSystem(), urlparse(folder).path) if local else fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for name, data in zip(batch.column("image_path").to_pylist(), batch.column("image")):
                at = f"{root.rstrip('/')}/{name}"
                if (up := at.rsplit("/", 1)[0]) not in made:
                    files.create_dir(up, recursive=True)
                    made.add(up)
                with files.open_output_stream(at) as f:
                    f.write(data.as_py() or b"")
            yield pa.RecordBatch.from_arrays([batch.column("image_path")], names=["image_path"])

    return rows.select("image_path", "image").mapInArrow(save, "image_path string")

