"""Leak check: items that share a run of words with a corpus, or equal one of its texts.

A Bloom filter of the items' runs goes to the tasks that read the corpus.  There runs are
hashed in whole batches and probed; what the filter lets through is spelled out, exchanged
and compared by its words, so the result is exact and what is exchanged follows the matches
and not the corpus.  The filter is made by Spark (bits of equal words are or-ed together)
and has ``FILTER_WORDS`` words at most, whatever the items: a full filter lets more through
and loses nothing.  One plan serves items of any number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the filter at most (8 MB), and bits of it that a run sets.
FILTER_WORDS, SET_BITS = 1 << 20, 4
#: Bytes of text that are hashed together.
PART = 4_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _run_hashes(words: pa.StringArray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of n words that stays within its text; ``ends`` are
    where the texts end among the words."""
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy()]
    first = np.arange(max(0, len(h) - n + 1))
    text = np.searchsorted(ends, np.arange(len(h)), side="right")
    first = first[text[first] == text[first + n - 1]] if len(first) else first
    out = np.full(len(first), np.uint64(n))
    for i in range(n):
        out = _mixed(out ^ h[first + i])
    return first, out


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, length in enumerate(pc.fill_null(pc.binary_length(batch.column("low")), 0).to_pylist()):
        if size and size + length > PART:
            yield at, i
            at, size = i, 0
        size += length
    if at < batch.num_rows:
        yield at, batch.num_rows


def _hashed(low: pa.StringArray, n: int) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-case texts, each text's end among them, first words of runs, hashes of
    runs and of whole texts without spaces around them."""
    split = pc.ascii_split_whitespace(low.fill_null(""))
    owner, words = pc.list_parent_indices(split), split.flatten()
    filled = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(filled), owner.filter(filled)
    ends = np.searchsorted(owner.to_numpy(), np.arange(len(low)), side="right")
    first, h = _run_hashes(words, ends, n)
    whole = np.fromiter((xxhash.xxh3_64_intdigest(t.strip(" "), seed=1) for t in low.fill_null("").to_pylist()), np.uint64, len(low))
    return words, ends, first, h, whole


def _spelled(words: pa.StringArray, first: np.ndarray, n: int) -> list[str]:
    flat = words.take(pa.array((first[:, None] + np.arange(n)).ravel())).to_pylist()
    return [" ".join(flat[i : i + n]) for i in range(0, len(flat), n)]


def bit_mask(h: np.ndarray) -> np.ndarray:
    """The bits that a hash sets in its word."""
    out = np.zeros(len(h), np.uint64)
    for i in range(SET_BITS):
        out |= np.uint64(1) << ((h >> np.uint64(40 + 6 * i)) & np.uint64(63))
    return out


def _lowered(texts: DataFrame, *keys: str) -> DataFrame:
    return texts.where("text IS NOT NULL").select(*keys, F.lower("text").alias("low"))


def item_runs(items: DataFrame, n: int) -> DataFrame:
    """(item_id, whole, gram, h): every run of the items, and each whole text."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _parts(batch):
                low = batch.column("low").slice(a, b - a)
                words, ends, first, h, whole = _hashed(low, n)
                own = np.concatenate((np.searchsorted(ends, first, side="right"), np.arange(b - a)))
                grams = _spelled(words, first, n) + [t.strip(" ") for t in low.to_pylist()]
                is_whole = np.arange(len(grams)) >= len(first)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(a, b - a).take(pa.array(own)), pa.array(is_whole), pa.array(grams, pa.string()), pa.array(np.concatenate((h, whole)).view(np.int64))], names=["item_id", "whole", "gram", "h"])

    return _lowered(items, "item_id").mapInArrow(run, f"item_id {kind}, whole boolean, gram string, h long")


def run_filter(own: DataFrame, filter_words: int = FILTER_WORDS) -> np.ndarray:
    """The words of a Bloom filter of ``item_runs``: about 16 bits a run, up to
    ``filter_words``.  A row per word of the filter reaches the driver at most."""
    count, size = own.count(), 1
    while size < filter_words and size * 4 < count:
        size *= 2

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(size)).astype(np.int32)), pa.array(bit_mask(h).view(np.int64))], names=["word", "mask"])

    out = np.zeros(size, np.int64)
    for row in own.select("h").mapInArrow(masks, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():
        out[row["word"]] = row["mask"]
    return out.view(np.uint64)


def survivors(corpus: DataFrame, bits: np.ndarray, n: int) -> DataFrame:
    """(whole, gram): runs and whole texts of the corpus that the filter lets through; no
    others are spelled out."""
    shared = corpus.sparkSession.sparkContext.broadcast(bits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        passes = lambda h: (bits[h % np.uint64(len(bits))] & (mask := bit_mask(h))) == mask
        for batch in batches:
            for a, b in _parts(batch):
                low = batch.column("low").slice(a, b - a)
                words, _, first, h, whole = _hashed(low, n)
                runs = _spelled(words, first[passes(h)], n)
                texts = low.filter(pa.array(passes(whole))).to_pylist()
                grams = runs + [t.strip(" ") for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([False] * len(runs) + [True] * len(texts), pa.bool_()), pa.array(grams, pa.string())], names=["whole", "gram"])

    return _lowered(corpus).mapInArrow(probe, "whole boolean, gram string")


def leaked(items: DataFrame, corpus: DataFrame, n: int = 8, filter_words: int = FILTER_WORDS) -> DataFrame:
    """(item_id) of the items that share an n-word run with the corpus, case and white space
    aside, or equal one of its texts.  Null texts match nothing."""
    own = item_runs(items, n)
    found = survivors(corpus, run_filter(own, filter_words), n).distinct()
    return own.join(found, ["whole", "gram"], "left_semi").select("item_id").distinct()
