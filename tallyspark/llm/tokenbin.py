"""Token-ID / binary output: flat unsigned integer files with 64-bit offsets.

Layout of one shard, in the shared folder:

- ``NAME.bin``  ids of all its documents, little-endian uint16 (uint32 for
  vocabularies over 65,536), nothing else;
- ``NAME.idx``  int64: count+1 token offsets into the shard, then the doc_ids, then
  1 for each null doc_id, else 0.

Shards hold ascending doc_id ranges (null doc_ids first; equal doc_ids in the
order of their text's hash).  A shard's base (ids of all documents before it) is
the prefix sum of the shard counts, so a reader seeks to any document by base and
offset.  Every task writes a file of its own name and only the names that the
winning tasks report are used, so a lost executor or a speculative copy leaves no
trace in the result.

Null or empty text: the end id alone.  Very long texts: a part of their own, so a task
holds one of them at a time.  Empty table: no shard, no row.  Repeated rows keep a
record each.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import storage
from tallyspark.llm.words import encoder, whole_texts

MANIFEST = "part long, name string, n_docs long, n_ids long"
RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards; the manifest, one row per shard in order."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyspark import TaskContext

        enc, (files, root) = encoder(tokenizer, True), storage.files(folder)
        files.create_dir(root, recursive=True)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        lengths, ids, out = [], [], None
        for batch in batches:
            ids.append(batch.column("doc_id"))
            for _, _, texts in whole_texts(batch):
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}.bin")
                arrays = enc.encode(texts, end_id)
                lengths.extend(map(len, arrays))
                out.write(np.concatenate(arrays).tobytes())
        if out is None:
            return
        out.close()
        doc_id = pa.chunked_array(ids, pa.int64())
        with files.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype("<i8").tobytes())
            f.write(doc_id.fill_null(0).to_numpy().astype("<i8").tobytes())
            f.write(doc_id.is_null().to_numpy().astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": len(lengths), "n_ids": int(sum(lengths))}], schema=pa.schema([("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(shards or storage.partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest, _ = storage.stage(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")
    # One row per shard: as many as tasks, whatever the number of documents.
    bases = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")
    return manifest.withColumn("base", bases)


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str, dtype: str) -> DataFrame:
    """One record per document, computed from the files."""
    kind = np.dtype(dtype)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = storage.files(folder)
        local = type(files).__name__ == "LocalFileSystem"
        for batch in batches:
            for row in batch.to_pylist():
                name, n, base = row["name"], row["n_docs"], row["base"]
                with files.open_input_file(f"{root}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8")
                offsets, doc_id, null = index[: n + 1], index[n + 1 : 2 * n + 1], index[2 * n + 1 :]
                ids = np.memmap(f"{root}/{name}.bin", kind, "r") if local else None
                source = None if local else files.open_input_file(f"{root}/{name}.bin")
                for at in range(0, n, 5000):
                    to = min(n, at + 5000)
                    crc = []
                    for k in range(at, to):
                        a, b = int(offsets[k]), int(offsets[k + 1])
                        own = ids[a:b] if local else np.frombuffer(source.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)
                        crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_id[at:to], mask=null[at:to].astype(bool)), pa.array(offsets[at:to] + base), pa.array(np.diff(offsets[at : to + 1])), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # A shard to a task, whatever the manifest's own layout.
    return manifest.select("part", "name", "n_docs", "base").repartition(storage.partitions(spark), "part").mapInArrow(read, RECORD)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and read the records back from them."""
    spark = docs.sparkSession
    folder = folder or storage.new_path(spark, "tokens")
    kind = encoder(tokenizer, True).dtype.str.replace(">", "<")
    return read_shards(spark, write_shards(docs, tokenizer, folder, end_id), folder, kind)
