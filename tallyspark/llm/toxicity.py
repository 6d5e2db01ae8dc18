"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index.

Examples are at most ``max_examples`` labelled rows, taken in hash order.  Every word of
the examples is a term; a word's weight is TF-IDF times its association with the label
(its likelihood ratio in the examples, saturating at ``min_ratio``), so no word is left
out, and words that say nothing of the label weigh little.  Word beginnings, and beginnings
shared by several distinct words, are terms too where they reach ``min_ratio``
(``max_terms`` at most; a word beyond these stays a term by itself).  Document frequencies
are counted over all documents.

The inverted index cuts each term's postings into blocks of examples and keeps the
largest weight of each block.  A query adds up its terms' block maxima, visits blocks
from the highest sum down and stops at the first that cannot reach its k-th best.  Where
more than ``VISITS`` blocks can reach it, or no term goes with the label by ``min_ratio``
(such bounds hardly differ), all postings of the query's terms are added up instead.
Either way the k nearest examples are exact.  Their labels vote with their cosine; the vote is
shrunk towards the rate of the examples (of those without a term that goes with the label,
where the document has none), which calibrates scores of documents with weak neighbours.
A document without any word of an example has no neighbour and scores the latter rate.  All voting neighbours are returned as the evidence.

What is broadcast are the distinct words of at most max_examples texts, as 64-bit hashes,
and their postings.

Null and empty texts: as documents without terms.  Very long texts count whole, and
very long words by their beginning and a hash.  No usable labels: score 0
everywhere.  A doc_id with several labels counts as toxic if any says so; of several
texts under one labelled doc_id the smallest is the example.  Ties between examples
go to the earlier index position, so equal texts score equal.  Null doc_ids are
scored and never learnt from.  Repeated rows: equal scores, a row each.  Empty table: no
rows.  Extra columns are ignored here, whatever their names, and kept by ``keep_clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import storage

MAX_EXAMPLES, MAX_TERMS, MIN_RATIO, MIN_DF = 4096, 2048, 24.0, 5
NEIGHBOURS, SHRINK, POWER, BLOCK, VISITS = 15, 0.5, 2.0, 32, 12
FLOOR, SLOPE = 0.02, 2.0  # association of a word that says nothing; steepness up to 1
DENSE = 256  # rows of 4,096 examples: 8 MB
PREFIXES, LEVELS = range(3, 8), (2, 3, 4, 6)
_WORD = re.compile(r"\w+")
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"  # scripts without spaces
_BREAKS = bytes(i if _WORD.match(chr(i)) else 32 for i in range(256))  # for Latin-1
_UNSPACED, _PIECES = re.compile(f"[{_DENSE}]"), re.compile(f"[{_DENSE}]+|[^{_DENSE}]+")
SCORES = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"


def words_of(text: str | None) -> list[str]:
    """Lower-case words; scripts written without spaces in pairs of characters."""
    text = (text or "").lower()
    try:
        return text.encode("latin-1").translate(_BREAKS).decode("latin-1").split()
    except UnicodeEncodeError:
        words = _WORD.findall(text)
    if not _UNSPACED.search(text):
        return words
    out = []
    for piece in (p for w in words for p in _PIECES.findall(w)):
        out += [piece[i : i + 2] for i in range(max(1, len(piece) - 1))] if _UNSPACED.match(piece) else [piece]
    return out


def features(word: str) -> list[str]:
    """The word itself (a very long one by its beginning and a hash) and its beginnings."""
    name = word if len(word) <= 64 else f"{word[:40]}#{xxhash.xxh3_64_hexdigest(word)}"
    return [name, *(f"{word[:n]}*" for n in PREFIXES if n < len(word))]


def of_text(words: set[str]) -> set[str]:
    """All features of a text: its words, their beginnings, and each beginning again
    for two, three ... distinct words that share it."""
    shared = Counter(f for w in words for f in features(w)[1:])
    found = {features(w)[0] for w in words} | set(shared)
    found.update(f"{f}{n}" for f, k in shared.items() if k > 1 for n in LEVELS if n <= k)
    return found


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text divisible by 5, or no id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


class _Terms(dict):
    """word -> its features that matter to the vocabulary; bounded."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        self.bases = set(vocabulary) | {f.partition("*")[0] + "*" for f in vocabulary if "*" in f}
        self.starts = {f[: PREFIXES[0]] for f in self.bases if f[-1] == "*"}
        latin = [f[:3].ljust(3).encode("latin-1") for f in {*self.starts, *self.bases} if f[:3].isascii() or ord(max(f[:3])) < 256]
        self.marks = np.zeros(4096, bool)  # of the first three characters of all of these
        self.marks[self._mark(*np.array([list(x) for x in latin], np.int64).reshape(-1, 3).T)] = True

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = tuple(f for f in features(word) if f in self.bases)
        return value

    @staticmethod
    def _mark(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (a * 961 + b * 31 + c) & 4095

    def likely(self, words: dict) -> list[str]:
        """``words`` without most of those that have no features here."""
        try:
            joined = f"{' '.join(words)}   ".encode("latin-1")
        except UnicodeEncodeError:
            return list(words)
        b = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(b[:-2] == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        size, wide = ends - starts, b.astype(np.int64)
        maybe = np.flatnonzero(self.marks[self._mark(wide[starts], wide[starts + 1], wide[starts + 2])] | (size < 3) | (size > 64))
        return [joined[x:y].decode("latin-1") for x, y in zip(starts[maybe].tolist(), ends[maybe].tolist())]

    def among(self, words: dict) -> list[str]:
        """Those of ``words`` that have features here."""
        bases, starts, n = self.bases, self.starts, PREFIXES[0]
        words = self.likely(words) if words else []
        return [w for w in words if (w[:n] in starts or w in bases or len(w) > 64) and self[w]]


class _Known:
    """A worker's terms: those of the vocabulary, and the places of the examples' other
    words, by their sorted hashes and where each beginning of 18 bits starts."""

    def __init__(self, terms: _Terms, words: np.ndarray):
        self.terms, self.n = terms, len(words)
        self.words = np.append(words, np.uint64((1 << 64) - 1))
        self.first = np.searchsorted(words, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        self.steps = int(np.diff(self.first, append=self.n).max())

    def places(self, times: dict) -> np.ndarray:
        """Each word's place, -1 for a word of no example."""
        own = hashes(times)
        at = self.first[(own >> np.uint64(46)).astype(np.int64)]
        for _ in range(self.steps):
            at += self.words[at] < own
        return np.where((self.words[at] == own) & (at < self.n), at, -1)


def associated(times: dict[str, int], terms: _Terms) -> dict[int, int]:
    """Vocabulary number -> occurrences; 1 for a beginning that several words share."""
    hit = terms.among(times)
    if not hit:
        return {}
    number = terms.vocabulary
    occurrences, distinct = Counter(), Counter()
    for w in hit:
        for f in terms[w]:
            occurrences[f] += times[w]
            distinct[f] += 1
    out = {number[f]: n for f, n in occurrences.items() if f in number}
    for f, k in distinct.items():
        if k > 1 and f[-1] == "*":
            out |= {number[g]: 1 for n in LEVELS if n <= k and (g := f"{f}{n}") in number}
    return out


def hashes(words: list[str] | dict) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def term_counts(text: str | None, known: _Known, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, ascending, and occurrences: the vocabulary's, then those of the
    examples' other words.  Not ``counted``: the numbers alone are right."""
    times = Counter(words_of(text)) if counted else dict.fromkeys(words_of(text), 1)
    some = associated(times, known.terms)
    first = sorted(some)
    t, n = np.array(first, np.int64), np.array([some[i] for i in first], np.int64)
    place = known.places(times)
    own = np.flatnonzero(place >= 0)
    own = own[np.argsort(place[own])]
    occurrences = np.fromiter(times.values(), np.int64, len(times))
    return np.concatenate([t, place[own] + len(known.terms.vocabulary)]), np.concatenate([n, occurrences[own]])


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Of words in ``b`` of n examples, ``a`` of them toxic, against the label."""
    out = np.zeros(len(b))
    for observed, share, total in ((a, b / n, n_toxic), (b - a, b / n, n - n_toxic), (n_toxic - a, 1 - b / n, n_toxic), (n - n_toxic - b + a, 1 - b / n, n - n_toxic)):
        some = (observed > 0) & (share > 0)
        out[some] += 2 * observed[some] * np.log(observed[some] / (share[some] * total))
    return np.maximum(out, 0)


def _sums(start: np.ndarray, place: np.ndarray, value: np.ndarray, t: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """Sum of w times the listed values of each t, by place."""
    if not len(t):
        return np.zeros(size)
    lo = start[t]
    n = start[t + 1] - lo
    at = np.repeat(lo - (n.cumsum() - n), n) + np.arange(n.sum())
    return np.bincount(place[at], value[at] * np.repeat(w, n), size)


@dataclass
class Index:
    """Unit TF-IDF vectors of the examples as block-max postings."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    base_rate: float
    bare_rate: float  # of examples without a term that goes with the label
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # hashes, numbered after the vocabulary
    association: np.ndarray | float = 1.0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of a term's postings
    postings: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    tops: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of a term's blocks
    blocks: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    maxima: np.ndarray = field(default_factory=lambda: np.empty(0))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of an example's terms
    terms: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.empty(0))

    def unit(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.idf[t] * (self.association[t] if isinstance(self.association, np.ndarray) else self.association)
        norm = np.sqrt((w * w).sum())
        return t, w / norm if norm else w

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(counts), np.int64)
        return self.unit(t, np.array([counts[i] for i in t.tolist()], float))

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        size, n_blocks = len(self.idf), -(-len(vectors) // BLOCK)
        lengths = np.array([len(t) for t, _ in vectors], np.int64)
        owner = np.repeat(np.arange(len(vectors)), lengths)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        self.values = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        self.terms, self.rows = term, np.concatenate([[0], lengths.cumsum()])
        order = np.lexsort((owner, term))
        self.postings, self.weights = owner[order], self.values[order]
        self.starts = np.searchsorted(term[order], np.arange(size + 1))
        cell = term[order] * n_blocks + self.postings // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.maxima = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0)
        self.blocks = cell[first] % max(1, n_blocks)
        self.tops = np.searchsorted(cell[first] // max(1, n_blocks), np.arange(size + 1))

    def _visit(self, b: int, query: np.ndarray) -> np.ndarray:
        """Cosines of a block's examples."""
        rows = self.rows[b * BLOCK : (b + 1) * BLOCK + 1]
        lo, hi = rows[0], rows[-1]
        return np.add.reduceat(query[self.terms[lo:hi]] * self.values[lo:hi], rows[:-1] - lo)  # no example is without terms

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "frequent"}

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Each term's row, or -1, in a matrix of the weights of those terms that an eighth
        of the examples have, ``DENSE`` at most; made in the worker that asks."""
        n, examples = np.diff(self.starts), len(self.rows) - 1
        chosen = np.argsort(-n, kind="stable")[:DENSE]
        chosen = chosen[n[chosen] * 8 >= max(1, examples)]
        row, matrix = np.full(len(n), -1), np.zeros((len(chosen), examples))
        row[chosen] = np.arange(len(chosen))
        for r, t in enumerate(chosen.tolist()):
            own = slice(self.starts[t], self.starts[t + 1])
            matrix[r, self.postings[own]] = self.weights[own]
        return row, matrix

    def _all(self, t: np.ndarray, w: np.ndarray, k: int) -> list[tuple[float, int]]:
        """``nearest`` by all postings of the terms."""
        place, matrix = self.frequent
        row = place[t]
        rare = row < 0
        score = np.round(w[~rare] @ matrix[row[~rare]] + _sums(self.starts, self.postings, self.weights, t[rare], w[rare], len(self.rows) - 1), 12)
        top = np.flatnonzero((score > 0) & (score >= (np.partition(score, -k)[-k] if len(score) > k else 0)))
        return sorted(zip(score[top].tolist(), top.tolist()), key=lambda x: (-x[0], x[1]))[:k]

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k examples of highest cosine (over 0), ties to the lower position."""
        if self.vocabulary and len(t) and t[0] >= len(self.vocabulary):
            return self._all(t, w, k)
        bound = _sums(self.tops, self.blocks, self.maxima, t, w, -(-(len(self.rows) - 1) // BLOCK))
        query = np.zeros(len(self.idf))
        query[t] = w
        best: list[tuple[float, int]] = []
        for visited, b in enumerate(np.argsort(-bound, kind="stable").tolist()):
            least = -best[-1][0] - 1e-9 if len(best) == k else 0.0
            if bound[b] <= 0 or bound[b] < least:
                break
            if visited == 2 and (bound >= least).sum() > VISITS:
                return self._all(t, w, k)
            score = np.round(self._visit(b, query), 12)
            best += [(-float(score[i]), b * BLOCK + i) for i in np.flatnonzero(score > 0).tolist()]
            best.sort()
            del best[k:]
        return [(-s, i) for s, i in best]

    def score(self, t: np.ndarray, n: np.ndarray, k: int = NEIGHBOURS) -> tuple[float, np.ndarray, np.ndarray]:
        """The score, and positions and cosines of the neighbours that voted."""
        near = self.nearest(*self.unit(t, n), k) if len(t) else []
        place, cosine = np.array([i for _, i in near], np.int64), np.array([s for s, _ in near], float)
        if not near:
            return self.bare_rate, place, cosine
        prior = self.base_rate if t[0] < len(self.vocabulary) else self.bare_rate
        votes = cosine**POWER
        return float((votes @ self.labels[place] + SHRINK * prior) / (votes.sum() + SHRINK)), place, cosine


def _examples(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The chosen ids are at most ``limit`` rows.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _select_terms(examples: DataFrame, n: int, n_toxic: int, min_ratio: float, max_terms: int) -> dict[str, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for y, c in enumerate(seen):
                names = list(c)
                for i in range(0, len(names), 50_000):
                    part = names[i : i + 50_000]
                    counts = [c[f] for f in part]
                    zero = [0] * len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts, pa.int64()), pa.array(counts if y else zero, pa.int64())], names=["term", "n", "n_toxic"])
                c.clear()

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[1 if toxic else 0].update(of_text(set(words_of(text))))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield from flush()
        yield from flush()

    counted = examples.select("text", "toxic").mapInArrow(count, "term string, n long, n_toxic long")
    a, b = F.sum("n_toxic").alias("a"), F.sum("n").alias("b")
    per_term = counted.groupBy("term").agg(a, b).where(F.col("b") >= MIN_DF)

    rate = F.col("b") / F.lit(float(n))
    cells = [(F.col("a"), n_toxic, True), (F.col("b") - F.col("a"), n - n_toxic, True), (n_toxic - F.col("a"), n_toxic, False), (n - n_toxic - F.col("b") + F.col("a"), n - n_toxic, False)]
    ratio = F.lit(0.0)
    for observed, total, present in cells:
        expected = (rate if present else 1 - rate) * F.lit(float(total))
        ratio = ratio + F.when((observed > 0) & (expected > 0), 2 * observed * F.log(observed / expected)).otherwise(0.0)
    best = per_term.withColumn("ratio", ratio).where(F.col("ratio") >= min_ratio).orderBy(F.desc("ratio"), "term").limit(max_terms).collect()
    return {r["term"]: i for i, r in enumerate(best)}


def _with_held_out(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))


def _with_terms(docs: DataFrame, vocabulary: dict[str, int], words: np.ndarray) -> DataFrame:
    """(doc_id, held_out, terms, counts): ``term_counts`` of every row, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(_Terms(vocabulary), words)
        for batch in batches:
            found = [term_counts(text, known) for text in batch.column("text").to_pylist()]
            packed = [pa.array([x[i].astype(np.int32).tobytes() for x in found], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *packed], names=["doc_id", "held_out", "terms", "counts"])

    return _with_held_out(docs).mapInArrow(run, "doc_id long, held_out boolean, terms binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS, min_ratio: float = MIN_RATIO) -> Index:
    """The index of the labelled examples with document frequencies over all ``docs``."""
    return _fit(docs, labels, max_examples, max_terms, min_ratio, False)[0]


def fit_score(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS, min_ratio: float = MIN_RATIO, k: int = NEIGHBOURS) -> DataFrame:
    """``score`` of ``docs`` by their own ``fit``; texts are read for their terms once, which
    wait in a stage table."""
    index, counted = _fit(docs, labels, max_examples, max_terms, min_ratio, True)
    return score(docs, index, k) if counted is None else _scores(counted.select("doc_id", "held_out", "terms", "counts"), index, k)


def _fit(docs: DataFrame, labels: DataFrame, max_examples: int, max_terms: int, min_ratio: float, keep: bool) -> tuple[Index, DataFrame | None]:
    """The index and, to ``keep``, a stage table of ``_with_terms`` (none without usable labels)."""
    examples, _ = storage.stage(_examples(docs, labels, max_examples), "toxic-examples")
    n, n_toxic = examples.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = n_toxic / (n + 1)
    if not n_toxic or n_toxic == n:
        return Index({}, np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), base, base), None
    vocabulary = _select_terms(examples, n, n_toxic, min_ratio, max_terms)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(vocabulary)
        for batch in batches:
            found, words, times = [], [], []
            for text in batch.column("text").to_pylist():
                seen = Counter(words_of(text))
                found.append(associated(seen, terms))
                rest = [w for w in seen if features(w)[0] not in vocabulary]
                words.append(hashes(rest).view(np.int64))
                times.append([seen[w] for w in rest])
            arrays = [batch.column("doc_id"), batch.column("toxic"), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "toxic", "terms", "counts", "words", "times"])

    # max_examples rows
    table = examples.select("doc_id", "toxic", "text").mapInArrow(read, "doc_id long, toxic int, terms array<int>, counts array<long>, words array<long>, times array<long>").toArrow().combine_chunks()
    ids, labelled = (table.column(c).to_numpy() for c in ("doc_id", "toxic"))

    def lists(name: str) -> list[np.ndarray]:
        column = table.column(name).combine_chunks()
        offsets = column.offsets.to_numpy()
        return np.split(column.values.to_numpy(), offsets[1:-1])

    own = lists("words")
    words, codes = np.unique(np.concatenate(own).view(np.uint64), return_inverse=True)
    ends = np.cumsum([0, *map(len, own)])
    toxic = np.repeat(labelled, np.diff(ends))
    ratio = likelihood_ratio(np.bincount(codes, toxic, len(words)), np.bincount(codes, minlength=len(words)), n, n_toxic)
    association = np.concatenate([np.ones(len(vocabulary)), FLOOR + (1 - FLOOR) * (ratio / (ratio + min_ratio)) ** SLOPE])
    size = len(association)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, rows = None if keep else _Known(_Terms(vocabulary), words), np.zeros(size, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for x in batch.column(0).to_pylist():
                df[np.frombuffer(x, np.int32) if keep else term_counts(x, known, counted=False)[0]] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(df[seen], rows), pa.int64())], names=["term", "n"])

    counted = storage.stage(_with_terms(docs, vocabulary, words), "toxic-terms")[0] if keep else None
    texts = docs.select("text") if counted is None else counted.select("terms")
    counts = texts.mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the examples
    df = np.zeros(size + 1)  # the last place holds the documents
    df[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1

    index = Index(vocabulary, idf, ids, labelled, base, base, words, association)
    vectors = []
    for t, c, h, m in zip(lists("terms"), lists("counts"), np.split(codes, ends[1:-1]), lists("times")):
        t, c = np.concatenate([t, h + len(vocabulary)]).astype(np.int64), np.concatenate([c, m])
        order = np.argsort(t)
        vectors.append(index.unit(t[order], c[order]))
    bare = [y for y, (t, _) in zip(labelled.tolist(), vectors) if not len(t) or t[0] >= len(vocabulary)]
    index.bare_rate = (sum(bare) + base) / (len(bare) + 1)
    chosen = [i for i, (t, _) in enumerate(vectors) if len(t)]
    chosen.sort(key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), ids[i]))  # alike examples share blocks
    index.ids, index.labels = ids[chosen], labelled[chosen]
    index.build([vectors[i] for i in chosen])
    return index, counted


class Scorer:
    """Scores term vectors; remembers a bounded number of them."""

    def __init__(self, index: Index, k: int = NEIGHBOURS):
        self.index, self.k, self.known = index, k, {}

    @cached_property
    def words(self) -> _Known:
        return _Known(_Terms(self.index.vocabulary), self.index.words)

    def __call__(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        return self.of(*term_counts(text, self.words))

    def of(self, t: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mark = xxhash.xxh3_128_digest(t.tobytes() + n.tobytes())
        if mark not in self.known:
            if len(self.known) > 5_000:
                self.known.clear()
            self.known[mark] = self.index.score(t, n, self.k)
        return self.known[mark]


def _scores(rows: DataFrame, index: Index, k: int) -> DataFrame:
    """Scores of rows of (doc_id, held_out, text) or of ``_with_terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(index, k)
        for batch in batches:
            if batch.num_columns == 3:
                found = [scorer(t) for t in batch.column("text").to_pylist()]
            else:
                found = [scorer.of(*(np.frombuffer(x, np.int32).astype(np.int64) for x in row)) for row in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist())]
            values = [s for s, _, _ in found]
            place = np.concatenate([np.empty(0, np.int64), *(p for _, p, _ in found)])
            cosine = np.concatenate([np.empty(0), *(c for _, _, c in found)])
            ends = np.cumsum([0, *(len(p) for _, p, _ in found)])
            near = pa.StructArray.from_arrays([pa.array(index.ids[place], pa.int64()), pa.array(cosine), pa.array(index.labels[place], pa.int32())], names=["doc_id", "similarity", "toxic"])
            evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64()), pa.array([int(s >= 0.5) for s in values], pa.int32()), evidence], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    return rows.mapInArrow(run, SCORES)


def score(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of ``docs``."""
    return _scores(_with_held_out(docs).select("doc_id", "held_out", "text"), index, k)


def keep_clean(docs: DataFrame, index: Index, limit: float = 0.5, k: int = NEIGHBOURS) -> DataFrame:
    """Rows of ``docs`` that score below ``limit``, with all their columns."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(index, k)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t)[0] < limit for t in batch.column(at).to_pylist()], pa.bool_()))

    return storage.bounded(docs).mapInArrow(run, docs.schema)
