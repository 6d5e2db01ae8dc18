"""Benchmark decontamination by SimHash of item-sized windows.

Words are ``\\w+`` of the lower-cased text.  Every window of a document that has an
item's number of words is a candidate if enough of its five-word shingles occur in any
item: a weighted Jaccard similarity of ``similarity`` needs
2 * similarity / (1 + similarity) of the window's shingles to be an item's, so nothing
that could pass is left out.  A candidate's SimHash is looked up in a multi-index of the
items' fingerprints: eight 8-bit blocks, each probed within radius // 8 bits, which
reaches every fingerprint within ``radius`` bits (one of eight blocks must differ by at
most an eighth of it).  Items so found are verified by exact weighted Jaccard
similarity of the shingle multisets.

The radius of 20 bits lies over three standard deviations above the distance expected
at similarity 0.8, and the best-placed window of a passage is usually far closer; the
lookup is the method's one probabilistic step.

Items lie in the shared folder in chunks of about ``chunk`` rows.  One pass over the
documents meets all chunks: a Python worker holds the indexes of a few, reads the others
again for every 64 MB of text, and nothing of the benchmark is in the driver or a plan.
Items under five words match as a whole sequence.  Documents shorter than an item are one
window.  Null or empty texts and items without words match nothing; null item_ids take no
part, null doc_ids are matched like others.  Very long texts: every window, one text at a
time.  Of equally similar windows the first counts.  Repeated documents give repeated
rows; repeated items (same item_id) count as one row of the better similarity.  Empty
tables: no rows.  Extra columns are ignored here, whatever their names, and kept by
``keep_clean``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import storage
from tallyspark.llm.words import HashCache, gram_hashes, hashes, slices

SHINGLE, SIMILARITY, RADIUS, CHUNK = 5, 0.8, 20, 4096
BLOCKS, WIDTH = 8, 8
WINDOWS = 65_536  # fingerprinted at once
_WORD = re.compile(r"\w+")
_CACHE = HashCache()
MATCHES = "doc_id long, item_id long, similarity double, start_word long, n_words long, distance int"


def simhash(shingles: np.ndarray) -> int:
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(shingles), bitorder="little").view("<u8")[0])


def simhashes(g: np.ndarray, first: np.ndarray, size: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """``simhash`` of each stretch g[first : first + size], ``first`` ascending, by sums
    over the shingles before; stretches that begin within ``chunk`` share the sums."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        to = int(np.searchsorted(first, first[at] + chunk))
        lo, hi = int(first[at]), int((first[at:to] + size[at:to]).max())
        bits = np.unpackbits(g[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        before = np.zeros((hi - lo + 1, 64), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=before[1:])
        for a in range(at, to, chunk):
            own, n = first[a : min(a + chunk, to)] - lo, size[a : min(a + chunk, to)]
            ones = before[own + n] - before[own]
            out[a : a + len(own)] = np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        at = to
    return out


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both)


def split(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def runs(known: np.ndarray, n: int) -> np.ndarray:
    """Starts of the n-word stretches that hold known words only."""
    out = known[: len(known) - n + 1].copy() if len(known) >= n else known[:0]
    for i in range(1, n):
        out &= known[i : i + len(out)]
    return np.flatnonzero(out)


def grams_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """gram_hashes at some places only."""
    return gram_hashes(h[at[:, None] + np.arange(n)].ravel(), n)[::n] if len(at) else np.empty(0, np.uint64)


class ItemIndex:
    """Multi-index over one chunk of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.ids, self.shingles, prints, self.sizes = [], [], [], []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # words -> sequence hash -> items
        self.words: dict[str, int] = {}  # the items' words and their hashes
        for item_id, text in items:
            words = split(text)
            h = hashes(words, _CACHE)
            if not len(h):
                continue
            self.words.update(zip(words, h.tolist()))
            if len(h) < SHINGLE:
                self.short[len(h)][int(gram_hashes(h, len(h))[0])].append(item_id)
                continue
            g = gram_hashes(h, SHINGLE)
            self.ids.append(item_id)
            self.sizes.append(len(h))
            self.shingles.append(Counter(g.tolist()))
            prints.append(simhash(g))
        self.short = {n: dict(d) for n, d in self.short.items()}
        self.prints = np.array(prints, np.uint64)
        self.widths = np.array(self.sizes, np.int64)
        self.lengths = sorted(set(self.sizes))
        known = {s for c in self.shingles for s in c}
        self.known = np.array(sorted(known), np.uint64)
        self.filter_bits = max(16, int(len(known) * 16).bit_length())
        self.filter = np.zeros(1 << self.filter_bits, bool)
        self.filter[(self.known >> np.uint64(64 - self.filter_bits)).astype(np.int64)] = True
        # For each block and block value: the items within radius // BLOCKS bits.
        near = [v for v in range(1 << WIDTH) if v.bit_count() <= radius // BLOCKS]
        self.table: list[tuple[np.ndarray, np.ndarray]] = []
        for b in range(BLOCKS):
            value = ((self.prints >> np.uint64(b * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
            cell = (value[:, None] ^ np.array(near)[None, :]).ravel()
            item = np.repeat(np.arange(len(value)), len(near))
            order = np.argsort(cell, kind="stable")
            self.table.append((np.searchsorted(cell[order], np.arange((1 << WIDTH) + 1)), item[order]))

    def near(self, fp: int) -> list[tuple[int, int]]:
        """(item position, distance) of every item within the radius."""
        found = np.unique(np.concatenate([items[at[v] : at[v + 1]] for (at, items), v in zip(self.table, fp.to_bytes(8, "little"))]))
        distance = np.bitwise_count(self.prints[found] ^ np.uint64(fp))
        ok = distance <= self.radius
        return list(zip(found[ok].tolist(), distance[ok].tolist()))

    def within(self, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``near`` for many windows at once, items of ``sizes`` words only: (window, item
        position, distance), windows and items ascending."""
        found = [np.empty((0, 2), np.int64)]
        for b, (at, items) in enumerate(self.table):
            value = ((prints >> np.uint64(b * WIDTH)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
            lo, n = at[value], at[value + 1] - at[value]
            ends = np.cumsum(n)
            for x in slices(n, 1 << 18):
                own = np.repeat(np.arange(*x), n[slice(*x)])
                item = items[np.arange(len(own)) + np.repeat(lo[slice(*x)] - (ends[slice(*x)] - n[slice(*x)] - (ends[x[0]] - n[x[0]])), n[slice(*x)])]
                ok = np.flatnonzero(self.widths[item] == sizes[own])
                own, item = own[ok], item[ok]
                ok = np.bitwise_count(self.prints[item] ^ prints[own]) <= self.radius
                found.append(np.column_stack((own[ok], item[ok])))
        own, item = np.unique(np.concatenate(found), axis=0).T
        return own, item, np.bitwise_count(self.prints[item] ^ prints[own])

    def member(self, g: np.ndarray) -> np.ndarray:
        """Which shingles occur in any item."""
        maybe = self.filter[(g >> np.uint64(64 - self.filter_bits)).astype(np.int64)]
        at = np.flatnonzero(maybe)
        own = g[at]
        k = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        out = np.zeros(len(g), bool)
        out[at[self.known[k] == own]] = True
        return out

    def matches(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item_id, similarity, start, words, distance): each item's best window."""
        words = split(text)
        # Other words are 0 here: a shingle that holds one is no item's.
        h = np.fromiter(map(self.words.get, words, repeat(0)), np.uint64, len(words))
        known = h != 0
        best: dict[int, tuple] = {}

        def note(item_id: int, found: tuple) -> None:
            if item_id not in best or found[0] > best[item_id][0]:
                best[item_id] = found

        for n, sequences in self.short.items():
            at = runs(known, n)
            for p, s in zip(at.tolist(), grams_at(h, at, n).tolist()):
                for item_id in sequences.get(s, ()):
                    note(item_id, (1.0, p, n, 0))
        at = runs(known, SHINGLE)
        if len(at) and len(self.known):
            at = at[self.member(grams_at(h, at, SHINGLE))]
            if len(at):
                g = gram_hashes(hashes(words, _CACHE), SHINGLE)
                hit = np.zeros(len(g), bool)
                hit[at] = True
                count = np.concatenate(([0], np.cumsum(hit)))
                need = 2 * self.similarity / (1 + self.similarity)
                windows: list[np.ndarray] = []
                done, held = set(), 0
                for n in self.lengths:
                    m_item = n - SHINGLE + 1
                    m = min(m_item, len(g))
                    if (m, m_item) in done or m + m < need * (m + m_item):
                        continue
                    done.add((m, m_item))
                    starts = np.flatnonzero(count[m:] - count[:-m] >= need * (m + m_item) / 2 - 1e-9)
                    for at in range(0, len(starts), WINDOWS):
                        own = starts[at : at + WINDOWS]
                        windows.append(np.stack((own, np.full(len(own), m), np.full(len(own), n))))
                        held += len(own)
                        if held >= WINDOWS:
                            self._verify(g, np.concatenate(windows, axis=1), note)
                            windows, held = [], 0
                if held:
                    self._verify(g, np.concatenate(windows, axis=1), note)
        return [(i, *x) for i, x in sorted(best.items())]

    def _verify(self, g: np.ndarray, windows: np.ndarray, note: Callable[[int, tuple], None]) -> None:
        """Note the items that windows (start, shingles, the item's words) are similar to."""
        start, m, n = windows[:, np.argsort(windows[0], kind="stable")]
        own, items, distances = self.within(simhashes(g, start, m), n)
        memo: dict[tuple[bytes, int], float] = {}  # a repeated passage is verified once
        for p, size, item, distance in zip(start[own].tolist(), m[own].tolist(), items.tolist(), distances.tolist()):
            mark = g[p : p + size].tobytes(), item
            if mark not in memo:
                memo[mark] = weighted_jaccard(Counter(g[p : p + size].tolist()), self.shingles[item])
            if memo[mark] >= self.similarity:
                note(self.ids[item], (memo[mark], p, size + SHINGLE - 1, distance))


def item_table(benchmark: DataFrame, chunk: int = CHUNK) -> tuple[str, int]:
    """Write the items in chunks of about ``chunk`` rows: the folder, and how many."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    parts = -(-items.count() // chunk)
    path = storage.new_path(benchmark.sparkSession, "benchmark-items")
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1))).cast("int")
    items.withColumn("chunk", number).repartition("chunk").write.partitionBy("chunk").parquet(path)
    return path, parts


class Items:
    """The chunks' indexes in a Python worker, read from the shared folder; ``held`` of
    them at a time, and as many texts as make a pass over the others worth while."""

    def __init__(self, path: str, parts: int, similarity: float, radius: int, held: int = 4):
        self.path, self.parts, self.similarity, self.radius, self.held = path, parts, similarity, radius, held
        self.indexes: dict[int, ItemIndex] = {}

    def index(self, k: int) -> ItemIndex:
        if k not in self.indexes:
            files, root = storage.files(f"{self.path}/chunk={k}")
            info = files.get_file_info(root)
            table = pq.read_table(root, filesystem=files, columns=["item_id", "text"], partitioning=None) if info.type.name == "Directory" else None
            rows = sorted(zip(*(c.to_pylist() for c in table.columns)), key=repr) if table is not None else []
            if len(self.indexes) >= self.held:
                self.indexes.pop(next(reversed(self.indexes)))  # the pass is cyclic: the latest goes
            self.indexes[k] = ItemIndex(rows, self.similarity, self.radius)
        return self.indexes[k]

    def gather(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches as they come, or joined to 64 MB where chunks have to be read again."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if self.parts <= self.held or size > 64 << 20:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def matches(self, texts: list[str | None]) -> list[list[tuple]]:
        """The matches of each text with the items of all chunks."""
        found: list[list[tuple]] = [[] for _ in texts]
        for k in range(self.parts):
            index = self.index(k)
            for own, text in zip(found, texts):
                own.extend(index.matches(text))
        return found


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """One row per (document row, matching item) with the item's best window."""
    path, parts = item_table(benchmark, chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(path, parts, similarity, radius)
        for batch in items.gather(batches):
            found = [(d, *best) for d, own in zip(batch.column("doc_id").to_pylist(), items.matches(batch.column("text").to_pylist())) for best in _best(own)]
            columns = list(zip(*found)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "similarity", "start_word", "n_words", "distance"])

    rows = storage.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, MATCHES)


def _best(own: list[tuple]) -> list[tuple]:
    """One match for each item_id: the most similar, then the first."""
    best: dict[int, tuple] = {}
    for m in sorted(own, key=lambda m: (-m[1], m[2])):
        best.setdefault(m[0], m)
    return [best[i] for i in sorted(best)]


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``docs`` that match no item, with all their columns."""
    path, parts = item_table(benchmark, chunk)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(path, parts, similarity, radius)
        for batch in items.gather(batches):
            yield batch.filter(pa.array([not own for own in items.matches(batch.column(at).to_pylist())], pa.bool_()))

    return storage.bounded(docs).mapInArrow(run, docs.schema)
