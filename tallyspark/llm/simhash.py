"""SimHash near-duplicates by anchor-point covering.

A fingerprint's two 23-bit parts are covered by the binary Golay code: perfect, with
covering radius 3, so every part has one code word within 3 bits.  An anchor is a
pair of code words.  Each distinct fingerprint is at home at its nearest anchor and
is replicated to every anchor within covering radius plus threshold of it: a
fingerprint within ``threshold`` bits of one at home lies within 3+i and 3+j bits
of its code words for some i+j <= threshold.  Comparing homes with replicas anchor by
anchor therefore finds every pair within the threshold; there are 2**24 anchors and
about 61 replicas of a fingerprint at two bits.

Equal fingerprints are one vertex, so copies cost nothing beyond one aggregation.  An
anchor's comparisons leave a spanning forest, never all pairs; components are joined
by ``graph.components``.

Null and empty texts, and texts without words: fingerprint zero, linked like any
other.  Repeated rows and ties: same fingerprint, same component.  Null doc_ids keep
their row and never name a component unless all of its doc_ids are null.  Very long
texts: all shingles, hashed 65,536 at a time.  Empty table: no rows.  Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import graph, storage
from tallyspark.llm.words import M1, mix, tidy

BITS, CODE, GENERATOR = 23, 12, 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1
RADIUS = 3
SEED = 42
WIDE, TABLES = 4, 24  # 64-bit words of a wide fingerprint, anchors it is at home at in the pass over homes alone
SHORT, CROWD = 7, 4  # bits of a short part of these, texts that share one of these anchors by chance at most
COVERED = (20, 40, 88, 192, 420, 920)  # tables with replicas, by short parts: 99.9 % of pairs at a similarity of 0.8 meet (simulated to two parts)


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of one text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    for at in range(0, n, 65536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + 65536], last[at : at + 65536])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, fp): the fingerprint as a signed long, for every row; tie is a
    hash of the text that tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter(map(fingerprint, batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "tie", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").mapInArrow(run, "doc_id long, tie long, fp long")


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of 64 * WIDE bits of hashed shingles; zero without any."""
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        with np.errstate(over="ignore"):
            x = np.column_stack([mix(part + M1 * np.uint64(k)) for k in range(1, WIDE + 1)])
        # Eight counters of a byte each are added as one number, 255 rows at most.
        ones = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        sums = np.add.reduceat(ones, np.arange(0, len(part), 255), axis=0)
        counts += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")


@cache
def _code() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Syndromes of 23-bit words, and by excess weight 0.. (over RADIUS) the error
    patterns of each syndrome: (start of each syndrome's run, patterns)."""
    unit = []
    for i in range(BITS):
        r = 1 << i
        for k in range(BITS - 1, BITS - CODE - 1, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - (BITS - CODE))
        unit.append(r)
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ unit[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ unit[12 + i]
    by_excess = []
    for excess in range(3):
        weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
        errors = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(BITS), w)], np.int64)
        syndrome = low[errors & 4095] ^ high[errors >> 12]
        order = np.argsort(syndrome, kind="stable")
        by_excess.append((np.searchsorted(syndrome[order], np.arange((1 << 11) + 1)), errors[order]))
    return np.concatenate((low, high)), by_excess


def _syndrome(part: np.ndarray) -> np.ndarray:
    table, _ = _code()
    return table[part & 4095] ^ table[4096 + (part >> 12)]


def _home(part: np.ndarray) -> np.ndarray:
    """The code word within RADIUS of each 23-bit word."""
    at, near = _code()[1][0]
    return part ^ near[at[_syndrome(part)]]


@cache
def _short() -> np.ndarray:
    """The word of the Hamming code (7 bits, perfect, radius 1) within a bit of each word."""
    word = np.arange(1 << SHORT)
    syndrome = np.bitwise_xor.reduce([(word >> i & 1) * (i + 1) for i in range(SHORT)])
    return np.where(syndrome > 0, word ^ (1 << np.maximum(syndrome, 1) - 1), word)


def short_parts(n: int) -> int:
    """Short parts of an anchor among ``n`` texts: each makes 16 times as many anchors."""
    parts = 0
    while parts < 5 and n > CROWD << CODE + 4 * parts:
        parts += 1
    return parts


@cache
def _beside() -> tuple[np.ndarray, np.ndarray]:
    """Words of the Hamming code two bits from each 7-bit word: (start of each word's run,
    code words)."""
    word, code = np.arange(1 << SHORT), np.unique(_short())
    at, which = np.nonzero(np.bitwise_count(word[:, None] ^ code) == 2)
    return np.searchsorted(at, np.arange((1 << SHORT) + 1)), code[which]


def _chosen(wide: np.ndarray, table: int, short: int, ones: np.ndarray | None = None) -> list[np.ndarray]:
    """The parts of wide fingerprints (or of their bits, a row each) in one table."""
    ones = _ones(wide) if ones is None else ones
    chosen = np.argsort(mix(np.arange(64 * WIDE, dtype=np.uint64) + np.uint64((table + 1) << 20))).tolist()
    word = lambda at, size: sum((ones[b] << i for i, b in enumerate(chosen[at : at + size])), np.zeros(len(wide), np.int64))
    return [word(0, BITS), *(word(BITS + SHORT * k, SHORT) for k in range(short))]


def _ones(wide: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), -1), axis=1, bitorder="little").T.astype(np.int64)


def _joined(codes: list[np.ndarray], table: int) -> np.ndarray:
    """One hash of the code words that make an anchor of a table."""
    anchor = codes[0]
    for c in codes[1:]:
        anchor = anchor << SHORT | c
    with np.errstate(over="ignore"):
        return mix(anchor.astype(np.uint64) + mix(np.array([table + 1], np.uint64)))


def wide_anchors(wide: np.ndarray, short: int) -> np.ndarray:
    """A row of home anchors per table, hashed: a 23-bit part and ``short`` parts of 7 bits
    of the wide fingerprints, their bits chosen anew for each table, each part moved to the
    word of its perfect code that covers it."""
    ones = _ones(wide)
    out = np.empty((TABLES, len(wide)), np.uint64)
    for t in range(TABLES):
        parts = _chosen(wide, t, short, ones)
        out[t] = _joined([_home(parts[0]), *(_short()[p] for p in parts[1:])], t)
    return out


def wide_places(wide: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index, home): all anchors of wide fingerprints over all tables of
    ``COVERED``.  As in ``anchors`` a fingerprint is at home at one anchor of a table and is
    replicated to all within the covering radii plus one bit: in each table it meets the
    homes of all that differ from it in at most one of the table's bits, and of many more."""
    ones, every = _ones(wide), np.arange(len(wide))
    places, owners, homes = [], [], []
    for t in range(COVERED[short]):
        parts = _chosen(wide, t, short, ones)
        codes = [_home(parts[0]), *(_short()[p] for p in parts[1:])]
        places.append(_joined(codes, t))
        owners.append(every)
        homes.append(np.ones(len(wide), bool))
        for k, part in enumerate(parts):
            at, near = _beside() if k else _code()[1][1]
            run = part if k else _syndrome(part)
            count = np.diff(at)[run]
            own = np.repeat(every, count)
            found = near[np.arange(len(own)) + np.repeat(at[run] - np.cumsum(count) + count, count)]
            moved = [c[own] for c in codes]
            moved[k] = found if k else part[own] ^ found
            places.append(_joined(moved, t))
            owners.append(own)
            homes.append(np.zeros(len(own), bool))
    return np.concatenate(places), np.concatenate(owners), np.concatenate(homes)


def anchors(fp: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint, and all (anchor, index) it is replicated to."""
    if threshold > 2:
        raise ValueError("error patterns are built for thresholds up to 2")
    parts = [((fp >> np.uint64(BITS * i)) & np.uint64((1 << BITS) - 1)).astype(np.int64) for i in range(2)]
    syndromes = [_syndrome(p) for p in parts]
    _, by_excess = _code()
    home = _home(parts[0]) | (_home(parts[1]) << BITS)
    places, owners = [], []
    for i in range(threshold + 1):
        for j in range(threshold + 1 - i):
            (a_at, a_err), (b_at, b_err) = by_excess[i], by_excess[j]
            a0, na = a_at[syndromes[0]], np.diff(a_at)[syndromes[0]]
            b0, nb = b_at[syndromes[1]], np.diff(b_at)[syndromes[1]]
            count = na * nb
            own = np.repeat(np.arange(len(fp)), count)
            k = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            ea = a_err[a0[own] + k // nb[own]] if len(own) else own
            eb = b_err[b0[own] + k % nb[own]] if len(own) else own
            places.append((parts[0][own] ^ ea) | ((parts[1][own] ^ eb) << BITS))
            owners.append(own)
    return home, np.concatenate(places), np.concatenate(owners)


def _forest(home: np.ndarray, home_fp: np.ndarray, place: np.ndarray, place_fp: np.ndarray, threshold: int, chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between fingerprints that meet at an anchor."""
    order = np.argsort(place, kind="stable")
    place, place_fp = place[order], place_fp[order]
    lo, hi = np.searchsorted(place, home, "left"), np.searchsorted(place, home, "right")
    fps, index = np.unique(np.concatenate((home_fp, place_fp)), return_inverse=True)
    h_index, p_index = index[: len(home_fp)], index[len(home_fp) :]
    roots = np.arange(len(fps))
    count = hi - lo
    at = 0
    ends = np.cumsum(count)
    while at < len(home):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
        own = np.repeat(np.arange(at, to), count[at:to])
        k = np.arange(len(own)) - np.repeat(ends[at:to] - count[at:to] - (ends[at - 1] if at else 0), count[at:to]) + lo[own]
        close = np.flatnonzero(np.bitwise_count(home_fp[own] ^ place_fp[k]) <= threshold)
        roots = graph.local_roots(len(fps), h_index[own[close]], p_index[k[close]], roots)
        at = to
    linked = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[linked], fps[roots[linked]]


def links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs within ``threshold`` bits
    of the distinct fingerprints (column fp)."""
    # About 32 MB of anchors and fingerprints (62 pairs of 8 bytes each) to a bucket.
    buckets = max(storage.partitions(distinct.sparkSession) * 4, 256, distinct.count() * 62 * 16 >> 25)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for s in range(0, len(fp), 20_000):
                part = fp[s : s + 20_000]
                home, place, own = anchors(part, threshold)
                anchor = np.concatenate((home, place))
                value = np.concatenate((part, part[own]))
                is_home = np.concatenate((np.ones(len(home), bool), np.zeros(len(place), bool)))
                with np.errstate(over="ignore"):
                    bucket = ((anchor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
                order = np.lexsort((~is_home, bucket))
                bucket, anchor, value, is_home = bucket[order], anchor[order], value[order], is_home[order]
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                rows = [(b, int(is_home[x:y].sum()), anchor[x:y].tobytes(), value[x:y].tobytes()) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "homes", "anchors", "fps"])

    def compare(table: pa.Table) -> pa.Table:
        tidy()
        home, home_fp, place, place_fp = [], [], [], []
        for n, a, f in zip(*(table.column(c).to_pylist() for c in ("homes", "anchors", "fps"))):
            a, f = np.frombuffer(a, np.int64), np.frombuffer(f, np.uint64)
            home.append(a[:n])
            home_fp.append(f[:n])
            place.append(a[n:])
            place_fp.append(f[n:])
        u, v = _forest(*(np.concatenate(x) for x in (home, home_fp, place, place_fp)), threshold)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    spread = distinct.select("fp").repartition(storage.partitions(distinct.sparkSession), "fp")
    rows = spread.mapInArrow(replicate, "bucket int, homes long, anchors binary, fps binary")
    return rows.groupBy("bucket").applyInArrow(compare, "u long, v long")


def rooted(docs: DataFrame, threshold: int = 2) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and (fp, root, low, n) of the distinct ones: the
    component's root fingerprint, the smallest doc_id and the rows of the class."""
    marked, _ = storage.stage(fingerprints(docs), "fingerprints")
    classes, c_path = storage.stage(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "fingerprint-classes")
    edges, e_path = storage.stage(links(classes, threshold), "fingerprint-links")
    roots = graph.components(edges).select(F.col("vertex").alias("fp"), "root")
    out, _ = storage.stage(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    storage.drop(docs.sparkSession, c_path, e_path)
    return marked, out


def near_duplicates(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, members) for every row of ``docs``;
    ``members`` counts the rows of the component."""
    marked, classes = rooted(docs, threshold)
    named = classes.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("members"))
    of_class = classes.select("fp", "root").join(named, "root").select("fp", "component_id", "members")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of_class, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", "members")


def keep_one(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """One row of ``docs`` from each component, with all its columns: the smallest
    doc_id (null only if all are), then the smallest text hash."""
    marked, classes = rooted(docs, threshold)
    rows = marked.withColumn("key", F.coalesce("doc_id", F.lit((1 << 63) - 1))).join(classes.select("fp", "root"), "fp")
    first = rows.groupBy("root").agg(F.min(F.struct("key", "tie")).alias("x")).select(F.col("x.key").alias("__key"), F.col("x.tie").alias("__tie")).distinct()
    own = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("__tie", F.xxhash64("text"))
    kept = own.join(first, ["__key", "__tie"]).dropDuplicates(["__key", "__tie"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
