"""Substring dedup by difference-cover anchors.

Positions whose index modulo 7 lies in the difference cover {0, 1, 3} are anchors.
Whatever the offset between two places, some step below 7 brings both onto the cover,
so two equal windows of 13 words hold an equal anchor of 7 words at the same place.
Three sevenths of the positions are hashed; only windows that hold an anchor repeated
elsewhere are extended to their 13 words, hashed to 128 bits and compared.

Traffic goes through buckets of hashes as packed arrays.  A map slice settles what it
can see itself (an anchor in two of its documents, a window whose first holder in the
slice is known) and sends one record per hash, so a passage that a third of all
documents share costs a record per slice, not one per document.

Definitions: words ``[^\\x20\\x09-\\x0D]+``; a window belongs to one document; a word is
removed where a window covers it whose word sequence also starts in a document with a
smaller doc_id.  Rows with equal doc_id never remove each other's words; null doc_ids
come after all others.  Null, empty or short texts (under 13 words) lose nothing.
Very long texts are read whole, in a slice of their own.  Repeated rows and ties give
repeated, equal results.  Empty table: no rows.  Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import storage
from tallyspark.llm.words import M2, HashCache, gram_hashes, groups, hashes, slices

PERIOD, COVER = 7, (0, 1, 3)
LAST = (1 << 63) - 1
_CACHE = HashCache()


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, tie, text): key orders documents, (key, tie) tells texts apart."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.withColumn("key", F.coalesce("doc_id", F.lit(LAST))).withColumn("tie", F.xxhash64("text")).select("doc_id", "key", "tie", "text")


def bucket_count(docs: DataFrame) -> int:
    """Buckets in proportion to the input's size, from 2 MB up to 64 MB each, so one
    bucket's rows always fit a task.  Takes the plan's estimate and runs nothing."""
    size = storage.estimate(docs)
    return max(64, storage.partitions(docs.sparkSession), min(size >> 21, 1024), size >> 26)


class Slice:
    """Word hashes of some documents end to end, with each word's document and place."""

    def __init__(self, texts: list, window: int):
        words = [split(t) for t in texts]
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.h = np.concatenate([hashes(w, _CACHE) for w in words]) if words else np.empty(0, np.uint64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.h)) - self.start[self.doc]
        self.window = window

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index) of the anchors of documents that hold a window."""
        span = self.window - PERIOD + 1
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.place + span <= self.sizes[self.doc]) & (self.sizes[self.doc] >= self.window))
        return gram_hashes(self.h, span)[at], at

    def windows(self, anchor_at: np.ndarray) -> np.ndarray:
        """Indices of all windows that hold one of the anchors."""
        mask = np.zeros(len(self.h) + 1, bool)
        span = self.window - PERIOD + 1
        for back in range(self.window - span + 1):
            at = anchor_at - back
            at = at[self.place[anchor_at] >= back]
            mask[at] = True
        at = np.flatnonzero(mask)
        return at[self.place[at] + self.window <= self.sizes[self.doc[at]]]


def _per_doc(doc: np.ndarray, values: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> list[tuple]:
    """(key, tie, values as bytes) for each document index."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    cut = groups(doc)
    return [(int(keys[doc[a]]), int(ties[doc[a]]), values[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


PACK = "bucket int, kind int, key long, tie long, values binary, hash_a binary, hash_b binary, refs binary, keys binary, ties binary"
REPLY = "key long, tie long, values binary"
_ARROW = [("bucket", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("tie", pa.int64()), *((n, pa.binary()) for n in ("values", "hash_a", "hash_b", "refs", "keys", "ties"))]


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _ARROW)], names=[n for n, _ in _ARROW])


def _settled(rows: list[tuple], buckets: int) -> list[tuple]:
    """Replies that need no comparison travel with the buckets' own replies."""
    return [((k ^ t) % buckets, 1, k, t, v, None, None, None, None, None) for k, t, v in rows]


def _bucketed(bucket: np.ndarray, a: np.ndarray, b: np.ndarray | None, value: np.ndarray | None, doc: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> list[tuple]:
    """One row per bucket: hashes, values and the documents they belong to (-1: none)."""
    order = np.argsort(bucket, kind="stable")
    bucket, cut = bucket[order], None
    cut = groups(bucket)
    rows = []
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = order[x:y]
        used, refs = np.unique(doc[own], return_inverse=True)
        none = used < 0
        rows.append((int(bucket[x]), 0, None, None, value[own].astype(np.uint32).tobytes() if value is not None else None, a[own].tobytes(), b[own].tobytes() if b is not None else None, refs.astype(np.uint16 if len(used) <= 65536 else np.uint32).tobytes(), np.where(none, -1, keys[used]).tobytes(), np.where(none, -1, ties[used]).tobytes() + (b"\1" if none.any() else b"\0")))
    return rows


def _unpack(table: pa.Table) -> dict:
    """The bucket's records: hashes, values, and for each its (key, tie, has document)."""
    out = {n: [] for n in ("a", "b", "value", "key", "tie", "real")}
    for values, a, b, refs, keys, ties in zip(*(table.column(c).to_pylist() for c in ("values", "hash_a", "hash_b", "refs", "keys", "ties"))):
        a = np.frombuffer(a, np.uint64)
        keys, none, ties = np.frombuffer(keys, np.int64), ties[-1], np.frombuffer(ties[:-1], np.int64)
        refs = np.frombuffer(refs, np.uint16 if len(refs) == 2 * len(a) else np.uint32)
        out["a"].append(a)
        out["b"].append(np.frombuffer(b, np.uint64) if b is not None else np.zeros(len(a), np.uint64))
        out["value"].append(np.frombuffer(values, np.uint32) if values is not None else np.zeros(len(a), np.uint32))
        out["key"].append(keys[refs])
        out["tie"].append(ties[refs])
        out["real"].append(refs > 0 if none else np.ones(len(a), bool))
    return {n: np.concatenate(v) for n, v in out.items()}


def _replies(key: np.ndarray, tie: np.ndarray, value: np.ndarray) -> list[tuple]:
    order = np.lexsort((tie, key))
    key, tie, value = key[order], tie[order], value[order]
    if not len(key):
        return []
    cut = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (tie[1:] != tie[:-1])) + 1, [len(key)]))
    return [(int(key[a]), int(tie[a]), value[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _reply_table(passed: pa.Table, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 3
    kinds = (pa.int64(), pa.int64(), pa.binary())
    own = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "tie", "values"])
    return pa.concat_tables([passed.select(["key", "tie", "values"]), own])


def _split_kinds(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    kind = table.column("kind").to_numpy()
    return table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 0))


def repeated_anchors(rows: DataFrame, anchors_of: Callable[[list], tuple[np.ndarray, np.ndarray]], buckets: int, within: bool = False, hot: int | None = None) -> DataFrame:
    """(key, tie, values): for each document its anchor hashes that occur again in another
    row, or, if ``within``, anywhere.  ``anchors_of`` gives the hashes and the documents'
    indices of a list of texts.  With ``hot`` also a row (occurrences, hash, null) for each
    hash that occurs so often."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys_all, ties_all = (batch.column(c).to_numpy() for c in ("key", "tie"))
            texts = batch.column("text").to_pylist()
            for lo, hi in slices([len(t or "") for t in texts]):
                keys, ties = keys_all[lo:hi], ties_all[lo:hi]
                h, doc = anchors_of(texts[lo:hi])
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                times = np.diff(np.append(np.flatnonzero(keep), len(h)))
                h, doc = h[keep], doc[keep]
                cut = groups(h)
                many = np.diff(cut) > 1
                if within and len(h):
                    many |= np.maximum.reduceat(times, cut[:-1]) > 1
                inside = np.repeat(many, np.diff(cut))
                out = _settled(_per_doc(doc[inside], h[inside], keys, ties), buckets)
                first = cut[:-1]
                count = np.add.reduceat(times, first) if hot and len(first) else None
                out += _bucketed((h[first] >> np.uint64(20)) % np.uint64(buckets), h[first], None, count, np.where(many, -1, doc[first]), keys, ties)
                yield _pack(out)

    def meet(table: pa.Table) -> pa.Table:
        passed, own = _split_kinds(table)
        if not own.num_rows:
            return _reply_table(passed, [])
        r = _unpack(own)
        order = np.argsort(r["a"], kind="stable")
        a, real = r["a"][order], r["real"][order]
        cut = groups(a)
        hit = np.repeat(np.diff(cut) > 1, np.diff(cut)) & real
        own_at = order[hit]
        replies = _replies(r["key"][own_at], r["tie"][own_at], r["a"][own_at])
        if hot:
            count = np.add.reduceat(r["value"][order].astype(np.int64), cut[:-1])
            often = np.flatnonzero(count >= hot)
            replies += zip(count[often].tolist(), a[cut[often]].view(np.int64).tolist(), [None] * len(often))
        return _reply_table(passed, replies)

    return rows.select("key", "tie", "text").mapInArrow(emit, PACK).groupBy("bucket").applyInArrow(meet, REPLY)


def with_replies(rows: DataFrame, replies: DataFrame, how: str) -> DataFrame:
    listed = replies.groupBy("key", "tie").agg(F.collect_list("values").alias("replies"))
    return rows.join(listed, ["key", "tie"], how)


def repeated_windows(rows: DataFrame, anchors: DataFrame, window: int, buckets: int) -> DataFrame:
    """(key, tie, values): starts of the windows that a smaller key also has."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys_all, ties_all = (batch.column(c).to_numpy() for c in ("key", "tie"))
            texts, replies = batch.column("text").to_pylist(), batch.column("replies").to_pylist()
            for lo, hi in slices([len(t or "") for t in texts]):
                keys, ties = keys_all[lo:hi], ties_all[lo:hi]
                s = Slice(texts[lo:hi], window)
                h, at = s.anchors()
                known = np.unique(np.frombuffer(b"".join(x for r in replies[lo:hi] for x in r), np.uint64))
                starts = s.windows(at[np.isin(h, known)])
                if not len(starts):
                    continue
                a, b = gram_hashes(s.h, window)[starts], gram_hashes(s.h, window, M2)[starts]
                doc, place = s.doc[starts], s.place[starts]
                key = keys[doc]
                order = np.lexsort((key, b, a))
                a, b, doc, place, key = a[order], b[order], doc[order], place[order], key[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                lowest = key[np.flatnonzero(new)][np.cumsum(new) - 1]
                later = key > lowest
                out = _settled(_per_doc(doc[later], place[later].astype(np.uint32), keys, ties), buckets)
                f = ~later
                out += _bucketed((a[f] >> np.uint64(20)) % np.uint64(buckets), a[f], b[f], place[f], doc[f], keys, ties)
                yield _pack(out)

    def meet(table: pa.Table) -> pa.Table:
        passed, own = _split_kinds(table)
        if not own.num_rows:
            return _reply_table(passed, [])
        r = _unpack(own)
        order = np.lexsort((r["key"], r["b"], r["a"]))
        a, b, key = r["a"][order], r["b"][order], r["key"][order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lowest = key[np.flatnonzero(new)][np.cumsum(new) - 1]
        own_at = order[key > lowest]
        return _reply_table(passed, _replies(r["key"][own_at], r["tie"][own_at], r["value"][own_at]))

    joined = with_replies(rows, anchors, "inner").select("key", "tie", "text", "replies")
    return joined.mapInArrow(emit, PACK).groupBy("bucket").applyInArrow(meet, REPLY)


def deduplicate(docs: DataFrame, window: int = 13, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for every row of ``docs``."""
    if window < PERIOD:
        raise ValueError(f"windows have {PERIOD} words at least")
    rows, buckets = keyed(docs), bucket_count(docs)

    def anchors_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
        s = Slice(texts, window)
        h, at = s.anchors()
        return h, s.doc[at]

    anchors, a_path = storage.stage(repeated_anchors(rows, anchors_of, buckets), "anchors")
    starts, _ = storage.stage(repeated_windows(rows, anchors, window, buckets), "windows")
    storage.drop(docs.sparkSession, a_path)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, replies in zip(batch.column("text").to_pylist(), batch.column("replies").to_pylist()):
                words = split(text)
                n = len(words)
                if replies:
                    at = np.frombuffer(b"".join(replies), np.uint32).astype(np.int64)
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                found.append((n, n - len(words), hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if keep_text else ()))
            columns = list(zip(*found)) or [()] * (3 + keep_text)
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(arrays)])

    return with_replies(rows, starts, "left").select("doc_id", "text", "replies").mapInArrow(apply, schema)
