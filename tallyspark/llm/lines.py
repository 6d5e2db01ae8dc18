"""Line dedup by pairwise alignment.

Which lines go: those of a run of consecutive lines, ``min_words`` words or more
together, that a document with a smaller doc_id holds as a run too.  Lines are compared
stripped; blank lines take no part.

Such a run is found by its items: a line that has the words by itself, or the shortest
runs of shorter lines that reach them (from each line on, and up to each line).  Items
go by the hash of their lines.  Every item pairs each later holder with the item's first
holder, so pairs grow with the lines and never with the square of a group, and the
result does not depend on how many documents share a line.  A pair gets the matched
places alone, one for each line of the later document.  They are aligned by patience
diff: items that are rare (``rare`` occurrences at most) and unique anchor a longest
increasing run, the stretches between anchors are aligned in turn, and what crosses that
alignment (moved or repeated lines) is aligned again in as few further runs as possible.
Matches that are consecutive in both documents form a block; blocks are deleted from the
later document.  ``rare`` decides which blocks are reported, never which lines go: a cut
on frequency would miss lines.

In scripts written without spaces, two Han or kana characters or four of the South-East
Asian scripts count as a word.  Documents are ordered by doc_id, null doc_ids last.
Rows with equal doc_id are not paired.  Null and empty texts have no lines and stay as
they are.  Very long texts: lines are read a few megabytes of text at a time, one text
at least.  Repeated rows and ties give repeated, equal results.  Empty table: no rows.
Extra columns are ignored here, whatever their names, and kept by ``rewrite``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import storage
from tallyspark.llm.substring import keyed
from tallyspark.llm.words import whole_texts

MIN_WORDS, RARE = 3, 8
_HAN = re.compile("[\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_THAI = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")  # and Lao, Burmese, Khmer

Match = tuple[int, int, int, bool]  # place, lines, place in the earlier document, rare


def longest_run(matches: list[Match]) -> list[Match]:
    """A longest choice of matches whose places grow in both documents."""
    tops, owners, back = [], [], []
    for k, m in enumerate(matches):
        p = bisect_left(tops, m[2])
        back.append(owners[p - 1] if p else -1)
        tops[p : p + 1], owners[p : p + 1] = [m[2]], [k]
    out, k = [], owners[-1] if owners else -1
    while k >= 0:
        out.append(matches[k])
        k = back[k]
    return out[::-1]


def alignments(matches: list[Match]) -> list[list[Match]]:
    """Matches of one pair, in order of place, dealt to alignments: each grows in both
    documents, the first one by patience diff, and together they hold every match."""
    if all(a[2] < b[2] for a, b in zip(matches, matches[1:])):
        return [matches]
    times = Counter(m[2] for m in matches)
    first = longest_run([m for m in matches if m[3] and times[m[2]] == 1])
    starts, used = [m[0] for m in first], set(first)
    gaps = defaultdict(list)
    for m in matches:
        if m not in used:
            g = bisect_right(starts, m[0])
            if (g == 0 or first[g - 1][2] < m[2]) and (g == len(first) or m[2] < first[g][2]):
                gaps[g].append(m)
    for own in gaps.values():
        first += longest_run(own)
    used = set(first)
    tops, piles = [], []  # of the rest: each match on the pile with the highest top below it
    for m in matches:
        if m not in used:
            p = bisect_left(tops, m[2])
            if p:
                tops[p - 1] = m[2]
                piles[p - 1].append(m)
            else:
                tops.insert(0, m[2])
                piles.insert(0, [m])
    return [sorted(first), *piles] if first else piles


def blocks(matches: list[Match]) -> list[tuple[int, int, int]]:
    """(place, place in the earlier document, lines) of the aligned blocks of one pair."""
    out = []
    for run in alignments(matches):
        for place, span, other, _ in run:
            if out and out[-1][0] - out[-1][1] == place - other and out[-1][0] <= place <= out[-1][0] + out[-1][2]:
                out[-1] = (*out[-1][:2], max(out[-1][2], place + span - out[-1][0]))
            else:
                out.append((place, other, span))
    return out


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(index among all lines, stripped line) of the lines that are not blank."""
    return [(i, s) for i, line in enumerate((text or "").split("\n")) if (s := line.strip())]


def weight(line: str, most: int) -> int:
    """The words of a stripped line, counted up to ``most``."""
    n = min(most, len(line.split(None, most)))
    if n < most and not line.isascii():
        n = min(most, max(n, len(_HAN.findall(line)) // 2 + len(_THAI.findall(line)) // 4))
    return n


def windows(n: list[int], least: int) -> set[tuple[int, int]]:
    """Ranges of two lines and more that reach ``least`` words: the shortest from each
    line on and the shortest up to each line."""
    found = set()
    for i in range(len(n)):
        if n[i] >= least:
            continue
        j, size = i + 1, n[i]
        while size < least and j < len(n):
            size += n[j]
            j += 1
        if size >= least:
            found.add((i, j))
        j, size = i, n[i]
        while size < least and j > 0:
            j -= 1
            size += n[j]
        if size >= least:
            found.add((j, i + 1))
    return found


def item_rows(rows: DataFrame, min_words: int) -> DataFrame:
    """(hash, key, tie, pos, span): every line of ``min_words`` words, and every window of
    several lines by the hash of their hashes; pos counts lines that are not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in whole_texts(batch):
                found = [[s for _, s in lines_of(t)] for t in texts.to_pylist()]
                own, pos, span, out = [], [], [], []
                for d, held in enumerate(found, a):
                    h = [xxhash.xxh3_64_intdigest(s) for s in held]
                    size = [weight(s, min_words) for s in held]
                    items = [(i, i + 1) for i, n in enumerate(size) if n >= min_words]
                    for i, j in [*items, *windows(size, min_words)]:
                        own.append(d)
                        pos.append(i)
                        span.append(j - i)
                        out.append(h[i] if j == i + 1 else xxhash.xxh3_64_intdigest(np.array(h[i:j], np.uint64).tobytes(), j - i))
                keys, ties = (batch.column(c).take(pa.array(own, pa.int64())) for c in ("key", "tie"))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64)), keys, ties, pa.array(pos, pa.int32()), pa.array(span, pa.int32())], names=["hash", "key", "tie", "pos", "span"])

    return rows.select("key", "tie", "text").mapInArrow(run, "hash long, key long, tie long, pos int, span int")


def removed_blocks(rows: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """(key, tie, removed): for documents that lose lines, a list of (other, blocks): the
    earlier document and packed uint32 triples (place, place there, lines)."""
    items, i_path = storage.stage(item_rows(rows, min_words), "line-items")
    holders = items.groupBy("hash").agg(F.min(F.struct("key", "tie", "pos")).alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    holders = holders.where("first.key < last").select("hash", F.col("first.key").alias("other"), F.col("first.pos").alias("other_pos"), "n")
    # As tables, both sides of the next join are plain exchanges, so adaptive execution
    # can split a line that most documents hold.
    holders, h_path = storage.stage(holders, "line-holders")
    matches = items.join(holders, "hash").where("key > other")
    match = F.struct("pos", "span", "other_pos", (F.col("n") <= rare).alias("rare"))
    pairs = matches.groupBy("key", "tie", "other").agg(F.collect_set(match).alias("matches"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("matches")
            flat = listed.flatten()
            columns = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "span", "other_pos", "rare")]
            ends, out = listed.offsets.to_numpy() - listed.offsets[0].as_py(), []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = sorted(zip(*(c[a:b].tolist() for c in columns)))
                out.append(np.array(blocks(own), np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["key", "tie", "other", "blocks"])

    aligned = pairs.mapInArrow(align, "key long, tie long, other long, blocks binary")
    listed, _ = storage.stage(aligned.groupBy("key", "tie").agg(F.collect_list(F.struct("other", "blocks")).alias("removed")), "removed-lines")
    storage.drop(rows.sparkSession, i_path, h_path)
    return listed


def _without(text: str, removed: list[dict]) -> tuple[str, int]:
    """The text without its blocks' lines, and how many those are."""
    held, gone = lines_of(text), set()
    for x in removed:
        for place, _, n in np.frombuffer(x["blocks"], np.uint32).reshape(-1, 3).tolist():
            gone.update(range(place, place + n))
    drop = {held[k][0] for k in gone}
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop), len(drop)


def _rewritten(texts: pa.StringArray, removed: pa.ListArray) -> tuple[pa.StringArray, np.ndarray]:
    """The texts with blocks removed, and the number of lines each one lost."""
    lost, hit = np.zeros(len(texts), np.int64), pc.is_valid(removed)
    if pc.any(hit).as_py():
        new = [_without(t, r) for t, r in zip(texts.filter(hit).to_pylist(), removed.filter(hit).to_pylist())]
        lost[hit.to_numpy(zero_copy_only=False)] = [n for _, n in new]
        texts = pc.replace_with_mask(texts, hit, pa.array([t for t, _ in new], texts.type))
    return texts, lost


BLOCKS = "array<struct<other:long,blocks:array<struct<place:int,other_place:int,n_lines:int>>>>"


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256[, kept, removed]) for every row of ``docs``;
    n_lines counts the lines that are not blank; ``removed`` names the earlier document of
    each block, the block's place in both and its lines."""
    rows = keyed(docs)
    removed = removed_blocks(rows, min_words, rare)
    schema = "doc_id long, n_lines long, n_removed long, kept_sha256 string" + f", kept string, removed {BLOCKS}" * keep_text

    def unpacked(x: list[dict] | None) -> list[dict]:
        of = lambda b: [dict(zip(("place", "other_place", "n_lines"), t)) for t in np.frombuffer(b, np.uint32).reshape(-1, 3).tolist()]
        return [{"other": r["other"], "blocks": of(r["blocks"])} for r in x or []]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("other", pa.int64()), ("blocks", pa.list_(pa.struct([("place", pa.int32()), ("other_place", pa.int32()), ("n_lines", pa.int32())])))]))
        for batch in batches:
            texts, gone = batch.column("text"), batch.column("removed")
            kept, lost = _rewritten(texts, gone)
            n = [len(lines_of(t)) for t in texts.to_pylist()]
            sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in kept.to_pylist()]
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost), pa.array(sha, pa.string())]
            if keep_text:
                arrays += [kept, pa.array([unpacked(x) for x in gone.to_pylist()], kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_removed", "kept_sha256", "kept", "removed"][: len(arrays)])

    return rows.join(removed, ["key", "tie"], "left").select("doc_id", "text", "removed").mapInArrow(apply, schema)


def rewrite(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """``docs`` with its own columns, repeated blocks gone from ``text`` (and ``n_chars``
    set to the new length where text changed and the column exists)."""
    removed = removed_blocks(keyed(docs), min_words, rare)
    cut = removed.select(F.col("key").alias("__key"), F.col("tie").alias("__tie"), F.col("removed").alias("__removed"))
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("__removed")
            arrays = [batch.column(i) for i in range(len(names))]
            at = names.index("text")
            arrays[at], _ = _rewritten(arrays[at], gone)
            if "n_chars" in names:
                k = names.index("n_chars")
                arrays[k] = pc.if_else(pc.is_valid(gone), pc.utf8_length(arrays[at]).cast(arrays[k].type), arrays[k])
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    joined = docs.join(cut, (key == F.col("__key")) & (F.xxhash64("text") == F.col("__tie")), "left")
    return joined.select(*(F.col(f"`{c}`") for c in names), "__removed").mapInArrow(apply, docs.schema)
