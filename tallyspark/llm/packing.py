"""Packing by cutting-stock column generation.

Every document's ids are cut into full sequences and one remainder.  The
remainders' lengths form a histogram of width ``grain``; a linear program over
cutting patterns (which lengths share a sequence) is solved by column generation:
a knapsack dynamic program prices patterns against the dual values until none
improves.  The pattern counts are rounded, what rounding leaves is packed first-fit
decreasing over the histogram, and the patterns' slots are dealt to the documents
ranked within their length class.

Only the histogram (a row per class) reaches the driver, so the program's size does
not follow the input.  Full sequences take no part: each is numbered where it is cut.
Ranks of the others come from counts per (class, salt) plus a window inside one salt,
so a length shared by most rows is spread.

Null or empty text: a piece with the end id alone; such short pieces share the place of
one class.  Very long texts: cut in their map task, a text at a time.  Empty table: no
rows.  Repeated rows and ties get pieces of their own.  Null doc_ids rank first.  Extra
columns are ignored, whatever their names.  A remainder of a power-of-two length is
packed like any other; a sequence whose content is a power of two needs no padding.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import storage
from tallyspark.llm.words import encoder, whole_texts

CAPACITY, GRAIN, END = 2048, 8, 1
SALTS = 64


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern of total size <= room."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c], take[c] = best[c - 1], -1
        n = np.searchsorted(sizes, c, "right")
        if n:
            gain = values[:n] + best[c - sizes[:n]]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], take[c] = gain[k], k
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= sizes[take[c]]
    return best[room], pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Patterns and fractional counts of the LP  min sum x, A x >= demand.

    Revised simplex over generated columns; starts from a first-fit-decreasing plan.  Ends
    within ``gap``, or half a sequence, of the optimum, or after ``rounds`` columns
    (a feasible plan at any time, so stopping costs padding, never a piece).
    """
    m = len(sizes)
    # Start: each size with what smaller ones still fit, largest first (triangular).
    columns, x, left = np.zeros((m, m)), np.zeros(m), demand.astype(float)
    for i in range(m - 1, -1, -1):
        columns[i, i] = room // sizes[i]
        x[i] = left[i] / columns[i, i]
        space = room - int(columns[i, i]) * int(sizes[i])
        for j in range(min(i, int(np.searchsorted(sizes, space, "right"))) - 1, -1, -1):
            a = min(space // int(sizes[j]), int(left[j] / x[i])) if x[i] > 0 else 0
            if a > 0:
                columns[j, i] = a
                left[j] -= a * x[i]
                space -= a * int(sizes[j])
    cost = np.ones(m)  # 0 for a surplus column
    inverse = np.zeros((m, m))
    for i in range(m - 1, -1, -1):
        inverse[i] = -(columns[i, i + 1 :, None] * inverse[i + 1 :]).sum(axis=0)
        inverse[i, i] += 1
        inverse[i] /= columns[i, i]
    best, bound, pull = np.zeros(m), 0.0, 0.85
    for _ in range(rounds):
        dual = (cost[:, None] * inverse).sum(axis=0)
        entering = 1.0
        # Prices are drawn towards those of the best bound: plain duals swing.
        for weight in (pull, 0.0):
            prices = weight * best + (1 - weight) * np.maximum(dual, 0)
            value, pattern = price(prices, sizes, room)
            prices = prices / max(value, 1)
            if (demand * prices).sum() > bound:
                best, bound = prices, float((demand * prices).sum())
            if (dual * pattern).sum() > 1 + 1e-9:
                break
        else:
            over = int(dual.argmin())
            if dual[over] >= -1e-9:
                break
            pattern, entering = np.zeros(m, np.int64), 0.0  # meeting this demand exactly costs more
            pattern[over] = -1
        total = float((cost * x).sum())
        if total - bound < max(0.5, gap * total):
            break
        used = np.flatnonzero(pattern)
        direction = (inverse[:, used] * pattern[used]).sum(axis=1)
        ok = direction > 1e-9
        ratio = np.where(ok, x / np.where(ok, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * direction
        x[out] = step
        x = np.maximum(x, 0)
        columns[:, out], cost[out] = pattern, entering
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
    return [(columns[:, j].astype(np.int64), x[j]) for j in range(m) if x[j] > 1e-9 and cost[j]]


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """Integer plan: (how many sequences, {size: pieces in each}), demand met exactly."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    made: Counter = Counter()
    if not len(sizes):
        return []
    unit = int(np.gcd.reduce([*sizes, room]))
    for pattern, count in sorted(column_generation(sizes // unit, left.astype(float), room // unit), key=lambda p: -p[1]):
        n = int(count)
        if n:
            used = np.flatnonzero(pattern)
            n = min(n, int((left[used] // pattern[used]).min()))
        if n > 0:
            left -= n * pattern
            made[tuple(pattern.tolist())] += n
    # What rounding left: at most a few sequences for each class.
    while left.any():
        pattern, space = np.zeros(len(sizes), np.int64), room
        for k in range(len(sizes) - 1, -1, -1):
            n = min(int(left[k]), space // int(sizes[k]))
            pattern[k], space = n, space - n * int(sizes[k])
        used = np.flatnonzero(pattern)
        n = int((left[used] // pattern[used]).min())
        left -= n * pattern
        made[tuple(pattern.tolist())] += n
    return [(n, {int(sizes[k]): c for k, c in enumerate(p) if c}) for p, n in made.items()]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END, keep_ids: bool = False) -> DataFrame:
    """Cut every document: (doc_id, start, length, ids_crc32, doc_tokens, own[, ids]);
    ``own`` numbers the full pieces, uniquely."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, own long" + ", ids binary" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, full = encoder(tokenizer, False), TaskContext.get().partitionId() << 33
        for batch in batches:
            doc_id = batch.column("doc_id").to_pylist()
            for a, b, texts in whole_texts(batch):
                rows = []
                for d, ids in zip(doc_id[a:b], enc.encode(texts, end_id)):
                    data = ids.astype("<u4").tobytes()
                    for s in range(0, len(ids), capacity):
                        part = data[4 * s : 4 * (s + capacity)]
                        whole = len(part) == 4 * capacity
                        full += whole
                        rows.append((d, s, len(part) // 4, zlib.crc32(part), len(ids), full if whole else None) + ((part,) if keep_ids else ()))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.binary()) for c in columns[6:]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces with their place: sequence_id (unique, with gaps) and offset (gapless from 0)."""
    spark = docs.sparkSession
    cut, _ = storage.stage(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    full, rest = cut.where("own is not null"), cut.where("own is null").drop("own")
    # Classes: lengths rounded up to ``grain``; pieces of at most half a grain share one.
    size = F.least(F.ceil(F.col("length") / grain) * grain, F.lit(capacity)).cast("int")
    rest = rest.withColumn("kind", F.when(F.col("length") * 2 <= grain, F.col("length").cast("int")).otherwise(size))
    salts = max(SALTS, storage.partitions(spark))
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = rest.groupBy("kind", "salt").count()
    base = counts.select("kind", "salt", (F.sum("count").over(Window.partitionBy("kind").orderBy("salt")) - F.col("count")).alias("base"))
    total = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("count").alias("n")).collect()}  # a row per class
    need: Counter = Counter()
    classes = []  # (kind, size, first slot of the kind in its size, pieces in a slot)
    for kind, n in sorted(total.items()):
        each = grain // kind if kind * 2 <= grain else 1
        of = grain if kind * 2 <= grain else kind
        classes.append((kind, of, need[of], each))
        need[of] += -(-n // each)
    # Slots of each pattern in each size, in rank order.
    slots, sequence, at = [], 0, Counter()
    for n, pattern in plan(dict(need), capacity):
        for s, each in pattern.items():
            slots.append((s, at[s], at[s] + n * each, sequence, each))
            at[s] += n * each
        sequence += n
    slot_df = spark.createDataFrame(slots, "size int, lo long, hi long, first long, each long")
    by_size = slot_df.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "each"))).alias("slots"))
    # A row per class, with the class's patterns: bounded by capacity / grain.
    by_kind = spark.createDataFrame(classes, "kind int, size int, from long, per long").join(by_size, "size")
    order = [F.col(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    inside = F.row_number().over(Window.partitionBy("kind", "salt").orderBy(*order)) - 1
    ranked = rest.join(base, ["kind", "salt"]).withColumn("rank", F.col("base") + inside).join(F.broadcast(by_kind), "kind")
    ranked = ranked.withColumn("slot", F.col("from") + F.floor(F.col("rank") / F.col("per")))
    own = F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("slot")) & (F.col("slot") < s["hi"])), 1)
    placed = ranked.withColumn("own", own)
    placed = placed.withColumn("sequence_id", F.col("own.first") + F.floor((F.col("slot") - F.col("own.lo")) / F.col("own.each")))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order, "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("offset", F.sum("length").over(within) - F.col("length"))
    alone = full.withColumn("sequence_id", F.col("own") + sequence).withColumn("offset", F.lit(0).cast("long"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    return placed.select(*out).unionByName(alone.select(*out))
