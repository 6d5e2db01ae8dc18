"""State dicts in one file: 64-bit header length, JSON header, tensors end to end.

The header names each tensor's type, shape and place; the places are relative to the end of
the header.  Files are listed by Spark without their content; a task per file reads the
header alone; tensors are dealt out by size, and each is digested by ranges of
``CHUNK`` bytes.  So a file's tensors are read by many tasks, none whole, and no tensor
bytes pass through the driver.  Files are opened through Arrow's file systems (local, HDFS,
S3 and the like), which a store known to Spark alone is not.

Tensors without elements have the digest of no bytes.  An entry ``__metadata__`` is no
tensor.  A header that does not fit its file is an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK, MOST_HEADER = 8 << 20, 100 << 20
ENTRIES = "path string, param_key string, dtype string, shape array<long>, begin long, size long"


def _opened(uri: str):
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):  # Spark shows paths as they are, not escaped
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", uri))
    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def header(uri: str) -> list[dict]:
    """The tensors of a file, from its header."""
    with _opened(uri) as f:
        total = f.size()
        if total < 8:
            raise ValueError(f"{uri}: no header")
        (length,) = struct.unpack("<Q", f.read_at(8, 0))
        if length > min(MOST_HEADER, total - 8):
            raise ValueError(f"{uri}: the header does not fit the file")
        entries = json.loads(f.read_at(length, 8))
    out = []
    for key, x in entries.items():
        if key != "__metadata__":
            a, b = x["data_offsets"]
            if not 0 <= a <= b <= total - 8 - length:
                raise ValueError(f"{uri}: {key} lies outside the file")
            out.append({"path": uri, "param_key": key, "dtype": x["dtype"], "shape": x["shape"], "begin": 8 + length + a, "size": b - a})
    return out


def entries(spark: SparkSession, path: str) -> DataFrame:
    """A row per tensor of all files under ``path``: where its bytes lie, none of them read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("param_key", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("begin", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_pylist(header(uri), schema=kind)

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(read, ENTRIES)


def digests(found: DataFrame) -> DataFrame:
    """``entries`` with the SHA-256 of each tensor's bytes, read by ranges in tasks that the
    tensors are dealt to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, at, f = [], None, None
            for uri, begin, size in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "size"))):
                if uri != at:
                    if f:
                        f.close()
                    at, f = uri, _opened(uri)
                own = hashlib.sha256()
                for i in range(begin, begin + size, CHUNK):
                    own.update(f.read_at(min(CHUNK, begin + size - i), i))
                made.append(own.hexdigest())
            if f:
                f.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "digest"])

    dealt = found.repartition(F.col("path"), F.col("param_key")).sortWithinPartitions("path", "begin")
    return dealt.mapInArrow(read, ENTRIES + ", digest string")


def manifest(spark: SparkSession, path: str, phase: str, seed: int | None = None) -> DataFrame:
    """The weights manifest (seed, phase, param_key, module, digest) of state dict files; the
    module is the parameter's name up to its last dot."""
    module = F.regexp_extract("param_key", r"^(.*)\.[^.]*$", 1)
    return digests(entries(spark, path)).select(F.lit(seed).cast("int").alias("seed"), F.lit(phase).alias("phase"), "param_key", module.alias("module"), "digest")


def write(rows: DataFrame, folder: str) -> DataFrame:
    """State dict files, one per value of ``file``, from rows (file, param_key, data); their
    paths.  A file's header comes first, so its names and sizes are gathered in one task;
    its bytes are those of one file."""

    def save(table: pa.Table) -> pa.Table:
        import os
        import uuid

        from pyarrow import fs

        table = table.sort_by("param_key")
        place, head = 0, {}
        for key, data in zip(table.column("param_key").to_pylist(), table.column("data")):
            n = len(data.as_py())
            head[key] = {"dtype": "U8", "shape": [n], "data_offsets": [place, place + n]}
            place += n
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        uri = f"{folder}/{table.column('file')[0].as_py()}-{uuid.uuid4().hex}.tensors"
        local = urlparse(uri).scheme in ("", "file")
        files, path = (fs.LocalFileSystem(), urlparse(uri).path) if local else fs.FileSystem.from_uri(uri)
        files.create_dir(os.path.dirname(path), recursive=True)
        with files.open_output_stream(path) as f:
            f.write(struct.pack("<Q", len(text)) + text)
            for data in table.column("data"):
                f.write(data.as_py())
        return pa.table({"path": [uri]})

    return rows.select("file", "param_key", "data").groupBy("file").applyInArrow(save, "path string")
