"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

Which bytes can repeat: every 100-byte window holds at least one anchor, a place whose
56-byte hash is the least of the window's 45.  Equal windows have equal anchors, so
only the surroundings of anchors that occur twice (144 bytes: all windows that hold the
anchor) can hold a repeated window.  These segments meet by anchor.  The segments of
each sender form a shard, whose rotations are sorted once and kept as the order and
its transform: the eight bytes before each rotation.  The shards' transforms are merged
without sorting rotations again: an interleave says which shard each merged row comes
from; a pass writes the transforms' symbols in interleave order, deals the rows stably
to their symbols by counting, and so refines the interleave by eight bytes.  The pass in
which two neighbouring rows part gives the length of their common prefix; after 13 passes
the runs of rows with common prefixes of 100 bytes are the repeated intervals.

Before that, equal texts of larger doc_id lose every byte (texts of 100 bytes or more)
and equal segments collapse to their first holder where they meet, so a passage that a
third of all documents share costs one segment per map slice.  An anchor with ``hot``
occurrences or more (a heading before ever new text) would still bring all its different
surroundings to one task: its windows go by their own 128-bit hash instead, spread over
all buckets and collapsed in each map slice.  Both ways find the same bytes.

A byte goes where a 100-byte string covers it that also starts earlier: in a smaller
doc_id, or earlier in the same document.  Rows of equal doc_id but different text do
not remove each other's bytes; null doc_ids come after all others.  Null, empty and
short texts (under 100 bytes) lose nothing.  Very long texts are read whole, in a slice
of their own; surroundings are built a part at a time, so a long text of few letters
holds no more of them than another.  Repeated rows and ties give repeated, equal
results.  Empty table: no rows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import storage
from tallyspark.llm.substring import bucket_count, keyed, repeated_anchors, with_replies
from tallyspark.llm.words import M1, M2, groups, mix, slices

WINDOW, GRAM, STEP = 100, 56, 8
DEPTH = -(-WINDOW // STEP) * STEP
LEFT, WIDTH = WINDOW - GRAM, 2 * WINDOW - GRAM
HOT, HOT_LISTED = 20_000, 100_000  # occurrences of an anchor that is spread; so many anchors at most


def _extreme(x: np.ndarray, w: int, of) -> np.ndarray:
    """Sliding minimum or maximum over w places, by doubling."""
    out, span = x, 1
    while span * 2 <= w:
        out, span = of(out[:-span], out[span:]), span * 2
    return of(out[: len(x) - w + 1], out[w - span : len(x) - span + 1]) if span < w else out


class Bytes:
    """The bytes of some documents end to end."""

    def __init__(self, texts: list):
        data = [(t or "").encode() for t in texts]
        self.sizes = np.fromiter(map(len, data), np.int64, len(data))
        self.ends = np.cumsum(self.sizes)
        self.start = self.ends - self.sizes
        self.padded = np.frombuffer(b"".join([bytes(LEFT), *data, bytes(WIDTH)]), np.uint8)
        self.raw = self.padded[LEFT:]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, place, document) of every anchor."""
        n, w = int(self.ends[-1]) if len(self.ends) else 0, WINDOW - GRAM + 1
        if n < WINDOW:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        word = np.ndarray((n + GRAM - 8,), "<u8", self.raw, strides=(1,))
        with np.errstate(over="ignore"):
            h = word[:n] * M1
            for k in range(8, GRAM, 8):
                h ^= h >> np.uint64(31)
                h += word[k : k + n]
                h *= M2 if k % 16 else M1
        h = mix(h)
        # Grams and windows that reach into the next document take no part.
        top = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)
        over = np.zeros(n, bool)
        for e, s in zip(self.ends.tolist(), self.start.tolist()):
            over[max(s, e - GRAM + 1) : e] = True
        top[over] = 0xFFFFFFFF
        low = _extreme(top, w, np.minimum)
        cut = np.zeros(n, bool)
        for e, s in zip(self.ends.tolist(), self.start.tolist()):
            cut[max(s, e - WINDOW + 1) : e] = True
        low[cut[: len(low)]] = 0
        padded = np.concatenate((np.zeros(w - 1, np.uint32), low, np.zeros(w - 1, np.uint32)))
        high = _extreme(padded, w, np.maximum)[:n]
        at = np.flatnonzero((high == top[: len(high)]) & ~over[: len(high)] & (high > 0))
        return h[at], at, np.searchsorted(self.ends, at, "right")

    def segments(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the bytes around anchors, zero outside the document, with the valid range."""
        lo = np.maximum(self.start[doc] - (at - LEFT), 0)
        hi = np.minimum(self.ends[doc] - (at - LEFT), WIDTH)
        rows = np.lib.stride_tricks.sliding_window_view(self.padded, WIDTH)[at]
        edge = np.flatnonzero((lo > 0) | (hi < WIDTH))
        columns = np.arange(WIDTH)[None, :]
        rows[edge] *= (columns >= lo[edge, None]) & (columns < hi[edge, None])
        return rows, lo, hi


def parts(n: int, size: int) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, at + size)


def digests(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each segment with its valid range."""
    words = np.ascontiguousarray(rows).view("<u8")
    out = []
    with np.errstate(over="ignore"):
        for m in (M1, M2):
            h = (lo * 1024 + hi).astype(np.uint64) * m
            for k in range(words.shape[1]):
                h = (h ^ words[:, k]) * m
                h ^= h >> np.uint64(29)
            out.append(mix(h))
    return out[0], out[1]


def sort_rotations(rows: np.ndarray, depth: int) -> np.ndarray:
    """Order of all rotations of equally long rows by their first ``depth`` bytes or more."""
    n, width = rows.shape
    flat = np.arange(n * width).reshape(n, width)
    rank = np.zeros((n, width), np.uint64)
    for k in range(STEP):
        rank = (rank << np.uint64(8)) | np.roll(rows, -k, axis=1)
    span = STEP
    rank = np.unique(rank.ravel(), return_inverse=True)[1].astype(np.int64)
    while span < depth:
        ahead = rank[np.roll(flat, -(span % width), axis=1).ravel()]
        rank = np.unique(rank * (n * width + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        span *= 2
    return np.argsort(rank, kind="stable")


def transform(order: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The eight bytes before each rotation, in rotation order."""
    n, width = rows.shape
    symbol = np.zeros((n, width), np.uint64)
    for k in range(STEP, 0, -1):
        symbol = (symbol << np.uint64(8)) | np.roll(rows, k, axis=1)
    return symbol.ravel()[order]


def dealt(symbols: np.ndarray) -> np.ndarray:
    """Order that deals rows stably to their symbols: counting by digits of up to 16 bits
    (numpy's stable sort of such values is a counting sort)."""
    order = np.argsort(symbols if symbols.dtype.itemsize == 1 else symbols.astype(np.uint16), kind="stable")
    if symbols.dtype.itemsize > 2:
        order = order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def merge_transforms(parts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shards' transforms: (interleave, parted).

    ``interleave[i]`` is the shard of merged row i (its rows come in their own order);
    ``parted[i]`` is the pass, from 1, in which rows i-1 and i were told apart, 0 if
    their first ``depth`` bytes are equal.  A place where rows part stays one, since
    later passes only refine the order."""
    symbols = np.concatenate(parts)
    n = len(symbols)
    kinds, symbols = np.unique(symbols, return_inverse=True)
    symbols = symbols.astype(np.uint16 if len(kinds) <= 1 << 16 else np.uint32)
    interleave = np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.uint8 if len(parts) <= 256 else np.uint16)
    block = np.zeros(n, np.int32 if n < 1 << 31 else np.int64)
    boundary, parted = np.zeros(n, bool), np.zeros(n, np.uint8)
    for step in range(1, depth // STEP + 1):
        own = np.empty_like(symbols)
        own[dealt(interleave)] = symbols
        order = dealt(own)
        own, block, interleave = own[order], block[order], interleave[order]
        boundary[0] = True
        np.not_equal(own[1:], own[:-1], out=boundary[1:])
        boundary[1:] |= block[1:] != block[:-1]
        block = np.cumsum(boundary, dtype=block.dtype)
        parted[boundary & (parted == 0)] = step
    return interleave, parted


def common_prefixes(rows: np.ndarray, row: np.ndarray, offset: np.ndarray, parted: np.ndarray, depth: int, least: int = 0) -> np.ndarray:
    """Length of the prefix, up to ``depth``, that each merged rotation shares with the one
    before it: whole passes, and the equal bytes of the symbols that told them apart.
    Lengths that cannot reach ``least`` stay at their whole passes."""
    length = np.where(parted == 0, depth, (parted.astype(np.int64) - 1) * STEP)
    open_ = np.flatnonzero(parted * np.int64(STEP) > least)
    open_ = open_[(parted[open_] > 0) & (open_ > 0)]  # the first row has none before it
    for _ in range(STEP - 1):
        at = length[open_]
        same = rows[row[open_], (offset[open_] + at) % rows.shape[1]] == rows[row[open_ - 1], (offset[open_ - 1] + at) % rows.shape[1]]
        open_ = open_[same]
        length[open_] += 1
    length[:1] = 0
    return length


def repeated_windows(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, interval) of every window of the segments whose 100 bytes occur twice."""
    n, width = rows.shape
    orders, transforms = [], []
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        order = sort_rotations(rows[own], DEPTH)
        transforms.append(transform(order, rows[own]))
        orders.append(own[order // width] * width + order % width)
    interleave, parted = merge_transforms(transforms, DEPTH)
    merged = np.empty(n * width, np.int64)
    merged[dealt(interleave)] = np.concatenate(orders)
    row, offset = merged // width, merged % width
    interval = np.cumsum(common_prefixes(rows, row, offset, parted, DEPTH, WINDOW) < WINDOW)
    real = (offset >= lo[row]) & (offset + WINDOW <= hi[row])
    row, offset, interval = row[real], offset[real], interval[real]
    count = np.bincount(interval, minlength=int(interval[-1]) + 1 if len(interval) else 0)
    many = count[interval] > 1
    return row[many], offset[many], interval[many]


def window_digests(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, two 64-bit hashes) of every window of the segments."""
    offsets = np.arange(WIDTH - WINDOW + 1)
    row, offset = np.nonzero((offsets >= lo[:, None]) & (offsets + WINDOW <= hi[:, None]))
    view = np.lib.stride_tricks.sliding_window_view(rows, WINDOW, axis=1)
    a, b = np.empty(len(row), np.uint64), np.empty(len(row), np.uint64)
    for p in parts(len(row), 100_000):
        own = np.zeros((len(row[p]), WINDOW + 4), np.uint8)
        own[:, :WINDOW] = view[row[p], offset[p]]
        a[p], b[p] = digests(own, np.zeros(len(own), np.int64), np.full(len(own), WINDOW))
    return row, offset, a, b


def _first_holders(group: tuple[np.ndarray, ...], key: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mask of the entries that no entry of their group precedes."""
    order = np.lexsort((start, tie, key, *group))
    new = np.ones(len(order), bool)
    for g in group:
        g = g[order]
        new[1:] &= g[1:] == g[:-1]
    new[1:] = ~new[1:]
    k, t, s = key[order], tie[order], start[order]
    lowest = k[np.flatnonzero(new)][np.cumsum(new) - 1]
    of_doc = new.copy()
    of_doc[1:] |= (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    earliest = s[np.flatnonzero(of_doc)][np.cumsum(of_doc) - 1] if len(s) else s
    first = np.empty(len(order), bool)
    first[order] = (k == lowest) & (s == earliest)
    return first


PACK = "bucket int, kind int, key long, tie long, values binary, hashes binary, rows binary, meta binary"
SPANS = "key long, tie long, values binary"
_ARROW = [("bucket", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("tie", pa.int64()), *((n, pa.binary()) for n in ("values", "hashes", "rows", "meta"))]


def _spans(key: np.ndarray, tie: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """(key, tie, packed uint32 [start, end) pairs), overlapping pairs joined."""
    if not len(key):
        return []
    order = np.lexsort((a, tie, key))
    key, tie, a, b = key[order], tie[order], a[order], b[order]
    doc = np.ones(len(key), bool)
    doc[1:] = (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])
    number = np.cumsum(doc)
    base = number * np.int64(1 << 33)  # documents apart, so one running maximum serves all
    reach = np.maximum.accumulate(base + b)
    new = doc.copy()
    new[1:] |= base[1:] + a[1:] > reach[:-1]
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(key)) - 1
    pairs = np.stack((a[at], reach[ends] - base[ends]), axis=1).astype(np.uint32)
    cut = np.append(np.flatnonzero(doc[at]), len(at))
    return [(int(key[at[x]]), int(tie[at[x]]), pairs[x:y].tobytes()) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _anchors_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    h, _, doc = Bytes(texts).anchors()
    return h, doc


def covered(rows: DataFrame, anchors: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """(key, tie, values): byte spans covered by windows that also start earlier; the
    anchors of ``hot`` (sorted) by the hashes of their windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys_all, ties_all = (batch.column(c).to_numpy() for c in ("key", "tie"))
            texts, replies = batch.column("text").to_pylist(), batch.column("replies").to_pylist()
            for x, y in slices([len(t or "") for t in texts]):
                data = Bytes(texts[x:y])
                h, at, doc = data.anchors()
                known = np.unique(np.frombuffer(b"".join(v for r in replies[x:y] for v in r), np.uint64))
                hit = np.isin(h, known)
                h, at, doc = h[hit], at[hit], doc[hit]
                if not len(h):
                    continue
                key, tie, start = keys_all[x:y][doc], ties_all[x:y][doc], at - LEFT - data.start[doc]
                lo, hi, d1, d2 = (np.empty(len(h), k) for k in (np.int64, np.int64, np.uint64, np.uint64))
                for p in parts(len(h), 50_000):
                    segments, lo[p], hi[p] = data.segments(at[p], doc[p])
                    d1[p], d2[p] = digests(segments, lo[p], hi[p])
                first = _first_holders((d1, d2, h), key, tie, start)
                gone = ~first
                spans = [(key[gone], tie[gone], (start + lo)[gone], (start + hi)[gone])]
                own = np.flatnonzero(first)
                warm = np.isin(h[own], hot)
                out = []
                for p in parts(int(warm.sum()), 20_000):
                    i = own[warm][p]
                    row, offset, w1, w2 = window_digests(*data.segments(at[i], doc[i]))
                    i, begin = i[row], start[i][row] + offset
                    new = _first_holders((w1, w2), key[i], tie[i], begin)
                    spans.append((key[i][~new], tie[i][~new], begin[~new], begin[~new] + WINDOW))
                    i, begin, w1, w2 = i[new], begin[new], w1[new], w2[new]
                    for b, k in _dealt_out(w1, buckets):
                        out.append((b, 2, None, None, None, w1[k].tobytes(), w2[k].tobytes(), np.stack((key[i[k]], tie[i[k]], begin[k]), axis=1).tobytes()))
                out += [((k ^ t) % buckets, 1, k, t, v, None, None, None) for k, t, v in _spans(*(np.concatenate(c) for c in zip(*spans)))]
                own = own[~warm]
                meta = np.stack((key, tie, start, lo, hi), axis=1)
                for b, k in _dealt_out(h[own], buckets):
                    i = own[k]
                    out.append((b, 0, None, None, None, h[i].tobytes(), data.segments(at[i], doc[i])[0].tobytes(), meta[i].tobytes()))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _ARROW)], names=[n for n, _ in _ARROW])

    def meet(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        passed = table.filter(pa.array(kind == 1)).select(["key", "tie", "values"])
        found = []
        for k, of in ((0, _meet), (2, _meet_windows)):
            sent = table.filter(pa.array(kind == k))
            if sent.num_rows:
                found += of(sent)
        columns = list(zip(*found)) or [()] * 3
        own = pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["key", "tie", "values"])
        return pa.concat_tables([passed, own])

    joined = with_replies(rows, anchors, "inner").select("key", "tie", "text", "replies")
    return joined.mapInArrow(emit, PACK).groupBy("bucket").applyInArrow(meet, SPANS)


def _dealt_out(hashes: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, indices) of the hashes."""
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = groups(bucket[order])
    return [(int(bucket[order[x]]), order[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _meet_windows(sent: pa.Table) -> list[tuple]:
    """Spans of the windows that an earlier place also has."""
    w1, w2 = (np.concatenate([np.frombuffer(x, np.uint64) for x in sent.column(c).to_pylist()]) for c in ("hashes", "rows"))
    key, tie, begin = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 3) for x in sent.column("meta").to_pylist()]).T
    later = ~_first_holders((w1, w2), key, tie, begin)
    return _spans(key[later], tie[later], begin[later], begin[later] + WINDOW)


def _meet(sent: pa.Table) -> list[tuple]:
    """Spans of the segments' windows that an earlier place also has."""
    hashes = [np.frombuffer(x, np.uint64) for x in sent.column("hashes").to_pylist()]
    shard = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
    h = np.concatenate(hashes)
    rows = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, WIDTH) for x in sent.column("rows").to_pylist()])
    key, tie, start, lo, hi = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 5) for x in sent.column("meta").to_pylist()]).T
    d1, d2 = digests(rows, lo, hi)
    first = _first_holders((d1, d2, h), key, tie, start)
    gone = np.flatnonzero(~first)
    out = [(key[gone], tie[gone], (start + lo)[gone], (start + hi)[gone])]
    # Anchors that still have several segments: their windows are merged.
    own = np.flatnonzero(first)
    own = own[np.argsort(h[own], kind="stable")]
    same = h[own][1:] == h[own][:-1]
    several = np.zeros(len(own), bool)
    several[1:] |= same
    several[:-1] |= same
    own = own[several]
    # Whole anchors at a time: under HOT + 10,000 segments, since hotter anchors go by
    # their windows (but for those beyond HOT_LISTED, of which one may be larger).
    edge = np.flatnonzero(np.append(True, h[own][1:] != h[own][:-1])) if len(own) else np.empty(0, np.int64)
    at = 0
    while at < len(own):
        k = np.searchsorted(edge, at + 10_000, "left")
        to = int(edge[k]) if k < len(edge) else len(own)
        part = own[at:to]
        _, part_shard = np.unique(shard[part], return_inverse=True)
        row, offset, interval = repeated_windows(rows[part], lo[part], hi[part], part_shard % 65536)
        row = part[row]
        begin = start[row] + offset
        later = ~_first_holders((interval,), key[row], tie[row], begin)
        out.append((key[row][later], tie[row][later], begin[later], begin[later] + WINDOW))
        at = to
    return _spans(*(np.concatenate(c) for c in zip(*out)))


def deduplicate(docs: DataFrame, keep_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``."""
    spark = docs.sparkSession
    rows, buckets = keyed(docs), bucket_count(docs)
    equal = rows.select("key", "tie", F.sha2("text", 256).alias("digest"))
    copies, t_path = storage.stage(equal.groupBy("digest").agg(F.min("key").alias("low")), "texts")  # a table, so the join can split a text of many copies
    copies, _ = storage.stage(equal.join(copies, "digest").where("key > low").select("key", "tie").distinct(), "copies")
    anchors, a_path = storage.stage(repeated_anchors(rows, _anchors_of, buckets, within=True, hot=hot), "byte-anchors")
    # Rows without values name hot anchors, with their occurrences: HOT_LISTED at most here.
    named = anchors.where("values IS NULL").orderBy(F.desc("key"), "tie").limit(HOT_LISTED).select("tie").collect()
    spread = np.sort(np.array([r["tie"] for r in named], np.int64).view(np.uint64))
    anchors = anchors.where("values IS NOT NULL").join(copies, ["key", "tie"], "left_anti")
    spans, _ = storage.stage(covered(rows, anchors, buckets, spread), "byte-spans")
    storage.drop(spark, a_path, t_path)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, replies, copy in zip(*(batch.column(c).to_pylist() for c in ("text", "replies", "copy"))):
                data = (text or "").encode()
                n, kept, pairs = len(data), data, []
                if copy and n >= WINDOW:
                    pairs = [(0, n)]
                elif replies:
                    pairs = []
                    for a, b in sorted(np.frombuffer(b"".join(replies), np.uint32).reshape(-1, 2).tolist()):
                        if pairs and a <= pairs[-1][1]:
                            pairs[-1] = (pairs[-1][0], max(b, pairs[-1][1]))
                        else:
                            pairs.append((a, b))
                if pairs:
                    edges = [0, *(x for p in pairs for x in p), n]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                found.append((n, n - len(kept), len(pairs), hashlib.sha256(kept).hexdigest()) + ((kept,) if keep_bytes else ()))
            columns = list(zip(*found)) or [()] * (4 + keep_bytes)
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays)])

    marked = with_replies(rows, spans, "left").join(copies.withColumn("copy", F.lit(True)), ["key", "tie"], "left")
    return marked.select("doc_id", "text", "replies", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(apply, schema)
