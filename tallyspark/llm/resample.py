"""Importance resampling towards a target distribution, by hashed n-gram weights.

Two passes over the texts.  The first counts features into ``BUCKETS`` buckets, one array a
task.  The second adds up the buckets' gains over each text, as arrays, and adds to this
weight a Gumbel variate that depends on the doc_id alone; the highest scores are a draw
without replacement with chances in proportion to exp(weight).

The draw.  Scored rows are staged with each task's eligible rows in order.  Equal scores
are counted (scores are whole numbers in a range that the gains bound, whatever the input),
which gives the cut and ranges of scores with about as many rows each.  Every task's order
is cut into blocks, its runs; a task per range reads their blocks in the order of their
first rows and merges them by a tournament tree, so it holds only blocks that overlap.  The
ranks of a range begin where those of the ranges above end.  At the draw count the merge
stops; what is left of that range, and all ranges below, go out without a rank.

Words are found, hashed and joined to pairs in whole buffers: the CRC of a pair comes from
those of its words, since CRCs of joined strings combine linearly.

Null text: no words.  Null doc_id: the variate of an empty id, after all others in ties.
Empty and very long texts: read whole; a text without words weighs 0.  Repeated rows: each
is drawn for itself; copies of a row travel as one with their number.  Extra columns are
ignored.  Empty documents: no row; an empty benchmark leaves all gains to the smoothing.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import storage
from tallyspark.llm.words import slices, tidy

BUCKETS = 10_000
#: Rows of a block, and of a range of scores at most (but for rows of one score).
BLOCK, RANGE = 4096, 1 << 20
SCORED = "doc_id long, n_features long, weight long, score long, n_words long"
COLUMNS = ["doc_id", "n_features", "weight", "score"]
#: Words up to this many bytes are hashed together.
SHORT = 48


@functools.cache
def _word_bytes() -> np.ndarray:
    """Each byte in lower case, 0 if it is no part of a word."""
    table = np.arange(256, dtype=np.uint8)
    upper = (table >= 0x41) & (table <= 0x5A)
    keep = upper | ((table >= 0x30) & (table <= 0x39)) | ((table >= 0x61) & (table <= 0x7A)) | (table >= 0x80)
    return np.where(keep, np.where(upper, table + 32, table), 0).astype(np.uint8)


@functools.cache
def _crc_byte() -> np.ndarray:
    """CRC register of each byte, from the polynomial that zlib uses."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


@functools.cache
def _appended() -> np.ndarray:
    """[n, i, b]: what byte i of a CRC register with the value b becomes after n zero bytes."""
    step = _crc_byte()
    out = np.empty((SHORT + 2, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(1, SHORT + 2):
        out[n] = step[out[n - 1] & 0xFF] ^ (out[n - 1] >> 8)
    return out


def features(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, text, n_words): the bucket and the text of every feature, words first, and
    the number of words of each text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets -= offsets[0]
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    low = _word_bytes()[raw]
    inside = low != 0
    # A word begins after another kind of byte or at the beginning of a text.
    fresh = np.zeros(len(low) + 1, bool)
    fresh[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:-1]
    first, size = np.flatnonzero(begins), None
    size = np.flatnonzero(ends) + 1 - first
    n_words = np.diff(np.searchsorted(first, offsets))
    text = np.repeat(np.arange(len(texts)), n_words)
    crc = np.empty(len(first), np.uint32)  # of the word
    spaced = np.empty(len(first), np.uint32)  # of a space and the word
    step = _crc_byte()
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    many = np.searchsorted(-size[order], -np.arange(1, SHORT + 2), side="right") if len(first) else []
    long = int(np.count_nonzero(size > SHORT))
    order_first = first[order]
    for out, start in ((crc, 0xFFFFFFFF), (spaced, int(step[(0xFFFFFFFF ^ 0x20) & 0xFF] ^ (0xFFFFFFFF >> 8)))):
        c = np.full(len(first), start, np.uint32)
        for k in range(SHORT):
            n = many[k] if len(first) else 0
            if n <= long:
                break
            part = slice(long, n)
            c[part] = step[(c[part] ^ low[order_first[part] + k]) & 0xFF] ^ (c[part] >> 8)
        out[order] = ~c
    for i in order[:long]:
        word = low[first[i] : first[i] + size[i]].tobytes()
        crc[i], spaced[i] = zlib.crc32(word), zlib.crc32(b" " + word)
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(text) > 1 else np.empty(0, np.int64)
    after = size[pair + 1] + 1
    zeros, c = _appended().ravel(), crc[pair]
    at = np.minimum(after, SHORT + 1) * 1024
    both = spaced[pair + 1].copy()
    for i in range(4):
        both ^= zeros[at + 256 * i + ((c >> np.uint32(8 * i)) & np.uint32(0xFF)).astype(np.int64)]
    for k in np.flatnonzero(after > SHORT + 1):
        b = first[pair[k] + 1]
        both[k] = zlib.crc32(b" " + low[b : b + after[k] - 1].tobytes(), int(c[k]))
    return np.concatenate((crc, both)).astype(np.int64) % BUCKETS, np.concatenate((text, text[pair])), n_words


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.StringArray]]:
    texts = batch.column("text").fill_null("")
    texts = pa.concat_arrays([texts]) if texts.type == pa.string() else texts.cast(pa.string())
    for a, b in slices(np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]).tolist()):
        yield a, b, texts.slice(a, b - a)
        tidy()


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket.  ``BUCKETS`` sums reach the driver, no more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, part in _parts(batch):
                total += np.bincount(features(part)[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    sums = storage.bounded(texts).select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight, n_words) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight, words = [], [], []
            for a, b, part in _parts(batch):
                bucket, text, n_words = features(part)
                count = np.bincount(text, minlength=b - a)
                order = np.argsort(text, kind="stable")
                total = np.concatenate(([0], np.cumsum(gain[bucket[order]])))
                at = np.concatenate(([0], np.cumsum(count)))
                n.append(count)
                weight.append((total[at[1:]] - total[at[:-1]]) // np.maximum(count, 1))
                words.append(n_words)
            if n:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (n, weight, words))], names=["doc_id", "n_features", "weight", "n_words"])

    return storage.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, weight long, n_words long")


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 7) -> DataFrame:
    """``weigh`` with the score: weight plus a variate of the seed and the doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    variate = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weigh(docs, gain).withColumn("score", F.col("weight") + variate)


def _ranges(counts: list[tuple[int, int]], take: int, size: int) -> list[tuple[int, int, int]]:
    """(lowest score, highest score, first rank - 1) of the ranges that the draw needs, from
    the rows of each score in falling order."""
    out, before, seen, high = [], 0, 0, None
    for score, n in counts:
        if seen >= take:
            break
        high = score if high is None else high
        seen += n
        if seen - before >= size or seen >= take:
            out.append((score, high, before))
            before, high = seen, None
    if high is not None:
        out.append((score, high, before))
    return out


class Tournament:
    """A tree of matches over a changing number of leaves: the least key wins."""

    def __init__(self):
        self.size, self.keys, self.tree, self.free = 1, [None], [0, 0], [0]

    def set(self, leaf: int, key) -> None:
        """Replay the matches of a leaf; None: it is out."""
        self.keys[leaf] = key
        keys, tree, at = self.keys, self.tree, (leaf + self.size) >> 1
        while at:
            a, b = (tree[2 * at], tree[2 * at + 1]) if at < self.size >> 1 else (2 * at - self.size, 2 * at + 1 - self.size)
            tree[at] = a if keys[b] is None or keys[a] is not None and keys[a] <= keys[b] else b
            at >>= 1

    def add(self, key) -> int:
        if not self.free:
            self.free = list(range(self.size, 2 * self.size))[::-1]
            self.keys += [None] * self.size
            self.size *= 2
            self.tree = [0] * self.size
            for leaf in range(0, self.size, 2):
                self.set(leaf, self.keys[leaf])
        leaf = self.free.pop()
        self.set(leaf, key)
        return leaf

    def out(self, leaf: int) -> None:
        self.set(leaf, None)
        self.free.append(leaf)

    def best(self) -> int | None:
        leaf = self.tree[1] if self.size > 1 else 0
        return None if self.keys[leaf] is None else leaf


def merged(blocks: Iterator[tuple[list, list]]) -> Iterator[tuple]:
    """(key, row) in the order of keys, from sorted blocks (keys, rows) that come in the
    order of their first keys: a block enters when its first key is due."""
    tree, open_, coming = Tournament(), {}, next(blocks, None)
    while True:
        leaf = tree.best()
        if coming is not None and (leaf is None or coming[0][0] < tree.keys[leaf]):
            open_[tree.add(coming[0][0])] = [*coming, 0]
            coming = next(blocks, None)
            continue
        if leaf is None:
            return
        block = open_[leaf]
        keys, rows, at = block
        yield keys[at], rows[at]
        if at + 1 < len(keys):
            block[2] = at + 1
            tree.set(leaf, keys[at + 1])
        else:
            tree.out(leaf)
            del open_[leaf]


_KIND = pa.schema([(c, pa.int64()) for c in (*COLUMNS, "copies")])
_BLOCK = "range int, first_score long, first_doc long, last_null boolean, rows binary"


def _key(row: tuple) -> tuple:
    """Order of a row (doc_id, n_features, weight, score, copies)."""
    return -row[3], row[0] is None, row[0] or 0, row[2], row[1]


def draw(rows: DataFrame, take: int, counts: list[tuple[int, int]], size: int | None = None) -> DataFrame:
    """The eligible ``rows`` (``SCORED``) with their rank among the ``take`` highest, null
    for the others.  ``counts``: rows of each score, in falling order of scores."""
    spark = rows.sparkSession
    parts = storage.partitions(spark)
    size = size or max(1, min(RANGE, take // (4 * parts)))
    ranges = _ranges(counts, take, size)
    undrawn = F.lit(None).cast("long")
    if not ranges:
        return rows.select(*COLUMNS, undrawn.alias("rank"))
    lowest = ranges[-1][0]
    lows = np.array([-low for low, _, _ in ranges])  # ascending

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a task's runs; where the order breaks, another run begins."""
        held, at, before = [], None, None

        def block():
            own = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_KIND)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _KIND, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(own)
            first = held[0]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([first[3]]), pa.array([first[0]], pa.int64()), pa.array([first[0] is None]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["range", "first_score", "first_doc", "last_null", "rows"])

        for batch in batches:
            where = np.searchsorted(lows, -batch.column("score").to_numpy())
            for row, to in zip(zip(*(c.to_pylist() for c in batch.columns)), where.tolist()):
                key = _key(row)
                if held and (to != at or len(held) >= BLOCK or key < before):
                    yield block()
                    held = []
                at, before = to, key
                if held and held[-1][:4] == row[:4]:
                    held[-1] = (*row[:4], held[-1][4] + row[4])
                else:
                    held.append(row)
        if held:
            yield block()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        blocks = ((r["range"], r["rows"]) for batch in batches for r in batch.to_pylist())

        def opened(own):
            for _, data in own:
                with pa.ipc.open_stream(data) as stream:
                    table = stream.read_all()
                held = list(zip(*(c.to_pylist() for c in table.columns)))
                yield list(map(_key, held)), held

        for to, own in groupby(blocks, lambda x: x[0]):
            at, out = ranges[to][2], []
            for _, row in merged(opened(own)):
                out.append((*row, at if at < take else None))
                at += row[4]
                if len(out) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[*_KIND.names, "before"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[*_KIND.names, "before"])

    high = rows.where(F.col("score") >= lowest)
    # The order that the rows were staged in, task by task, is kept by a plain scan.
    blocks = high.select(*COLUMNS, F.lit(1).cast("long").alias("copies")).mapInArrow(cut, _BLOCK)
    ordered = blocks.repartition(parts, "range").sortWithinPartitions("range", F.desc("first_score"), "last_null", "first_doc")
    ranked = ordered.select("range", "rows").mapInArrow(rank, ", ".join(f"{c} long" for c in (*_KIND.names, "before")))
    each = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    place = F.col("before") + F.col("copy")
    drawn = each.select(*COLUMNS, F.when(place <= take, place).alias("rank"))
    return drawn.unionByName(rows.where(F.col("score") < lowest).select(*COLUMNS, undrawn.alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """Every document (doc_id, n_features, weight, score, rank); ``percent`` of the
    documents with at least ``min_words`` words are drawn and have a rank."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    fit = F.col("n_words") >= min_words
    ordered = scored(docs, gain, seed).sortWithinPartitions(fit.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features")
    rows, _ = storage.stage(ordered, "scored")
    counts = rows.where(fit).groupBy("score").count().orderBy(F.desc("score")).collect()
    take = percent * sum(r["count"] for r in counts) // 100
    drawn = draw(rows.where(fit), take, [(r["score"], r["count"]) for r in counts])
    return drawn.unionByName(rows.where(~fit).select(*COLUMNS, F.lit(None).cast("long").alias("rank")))
