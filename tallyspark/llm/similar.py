"""Near-duplicates by SimHash, checked by an exact similarity, for the pipeline.

Two texts are linked if their sets of five-word shingles reach a Jaccard similarity of
0.8.  SimHash and its anchors find the links.  ``simhash.links`` finds the texts whose
fingerprints lie within its radius of 2 bits, homes against replicas.  Most linked texts
differ in more bits (about 15 % at 0.8), which would need too many replicas in one table
(see the README).  For these, wide fingerprints of the shingles have anchors in many tables,
code words over bits chosen anew for each, again homes against replicas: in a table two
texts meet if they differ in at most one of its bits, and often if in more.  There are as
many tables as bring together 99.9 % of pairs at a similarity of 0.8, more for more texts.
Those that meet and are near in their first 128 bits are a pair.  All pairs are verified
on whole sets, and what they link is one component.

Groups of many copies: a first pass over homes alone compares a text with a few others of
each anchor.  The pass over all homes and replicas, and the exact one, leave out pairs inside
a component, which cannot change it.

An exact check of what anchors may have missed follows, by prefixes, between
components only: with all shingles in one fixed order, two linked sets of a and b shingles
share one among the first n - ceil(0.8 n) + 1 of each.  Any order finds every pair;
here shingles that are frequent in a sample come last, the rest by hash.  A pair
becomes a candidate only where lengths and places still allow the overlap it needs, and
parities of 512 classes of shingles (they differ in no more classes than the sets in
shingles) the difference; it is then verified on the whole sets.  Texts are read once for
their prefixes and wide fingerprints; prefix shingles that no other text has go before
anything is compared.

Words are split and lower-cased as by ``simhash.fingerprint``; a shorter text is one
shingle.  Null and empty texts, and texts without words, are equal to each other.  Very
long texts: a set of all their shingles, a few megabytes of text at a time.  Repeated
rows and equal texts are one vertex, so ties cost nothing.  Null doc_ids are kept only
where all of a component are null.  Empty table: no rows.  Extra columns are kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import graph, simhash, storage, words
from tallyspark.llm.substring import bucket_count, keyed, repeated_anchors

SIZE = 5
PIVOTS, FEW = 16, 2  # texts that each is compared with at an anchor, before all are; near ones that make no crowd
NEAR, BOTH = 22, 38  # of 64 and of 128 bits: over 4 standard deviations above what is expected at a similarity of 0.8
FULL, BLOCK = 16, 1 << 20  # times CROWD texts share an anchor with replicas by chance; comparisons at once
CLASSES, FINE = 512, 4096  # of shingles, for parities
SAMPLE, FREQUENT, LISTED = 20_000, 8, 100_000  # order of shingles only; results do not depend on them


def shingles(text: str | None, cache: words.HashCache) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    w = (text or "").encode().lower().split()
    return np.unique(words.gram_hashes(words.hashes(w, cache), min(SIZE, len(w)))) if w else np.empty(0, np.uint64)


def _parities(h: np.ndarray, classes: int) -> bytes:
    """One bit for each class of shingles: whether their number is odd."""
    return np.packbits(np.bincount((h % np.uint64(classes)).astype(np.int64), minlength=classes).astype(np.uint8) & 1).tobytes()


def enough(overlap, a, b):
    """Whether sets of ``a`` and ``b`` with this overlap reach a similarity of 0.8."""
    return 9 * overlap >= 4 * (a + b)


def frequent(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many texts of a sample hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = words.HashCache()
        for batch in batches:
            found = [shingles(t, cache) for t in batch.column(0).to_pylist()]
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    step = max(1, rows.count() // SAMPLE)
    seen = rows.where(F.pmod("tie", F.lit(step)) == 0).select("text").mapInArrow(run, "h long, n long")
    many = seen.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(LISTED)
    return np.sort(np.array([r["h"] for r in many.select("h").collect()], np.int64).view(np.uint64))


def _partners(group: np.ndarray, root: np.ndarray, chunk: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group and different roots; both sorted, roots within groups."""
    n = len(group)
    start = np.concatenate(([True], (group[1:] != group[:-1])))[:n]
    run = start | np.concatenate(([True], root[1:] != root[:-1]))[:n]
    end_of = lambda mark: np.append(np.flatnonzero(mark), n)[np.cumsum(mark)]
    lo, count = end_of(run), end_of(start) - end_of(run)
    ends, at = np.cumsum(count), 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + chunk, "right")))
        own = np.repeat(np.arange(at, to), count[at:to])
        yield own, lo[own] + np.arange(len(own)) - (ends[own] - count[own] - before)
        at = to


def prefixes(rows: DataFrame, rare_last: np.ndarray) -> DataFrame:
    """(tie, size, parities, tokens, wide): each text once, with the number of its shingles,
    the parities of their classes, its prefix (packed hashes) and its wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = words.HashCache()
        for batch in batches:
            ties, out = batch.column(0).to_numpy(), []
            _, keep = np.unique(ties, return_index=True)
            for i in keep.tolist():
                h = shingles(batch.column(1)[i].as_py(), cache)
                n = len(h)
                parity, wide = _parities(h, CLASSES), simhash.wide_fingerprint(h)
                late = np.isin(h, rare_last, assume_unique=True)
                h = np.concatenate((h[~late], h[late]))[: n - (4 * n + 4) // 5 + 1] if n else np.zeros(1, np.uint64)
                out.append((int(ties[i]), n, parity, h.tobytes(), wide.tobytes()))
            kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tie", "size", "parities", "tokens", "wide"])

    return rows.select("tie", "text").mapInArrow(run, "tie long, size int, parities binary, tokens binary, wide binary").dropDuplicates(["tie"])


def _tokens(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens end to end, and whose they are."""
    found = [np.frombuffer(x, np.uint64) for x in packed]
    return np.concatenate([np.empty(0, np.uint64), *found]), np.repeat(np.arange(len(found)), [len(x) for x in found])


def shared_prefixes(heads: DataFrame, buckets: int) -> DataFrame:
    """``heads`` with those tokens alone that another text has too, and their places."""
    rows = heads.select(F.lit(0).cast("long").alias("key"), "tie", F.col("tokens").alias("text"))
    repeated = repeated_anchors(rows, _tokens, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places = [], []
            for own, replies in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                h = np.frombuffer(own, np.uint64)
                at = np.flatnonzero(np.isin(h, np.frombuffer(b"".join(replies), np.uint64)))
                tokens.append(h[at].tobytes())
                places.append(at.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tokens, pa.binary()), pa.array(places, pa.binary())], names=["tie", "size", "parities", "tokens", "places"])

    listed = repeated.groupBy("tie").agg(F.collect_list("values").alias("replies"))
    joined = heads.join(listed, "tie").select("tie", "size", "parities", "tokens", "replies")
    return joined.mapInArrow(run, "tie long, size int, parities binary, tokens binary, places binary")


def candidates(heads: DataFrame, buckets: int) -> DataFrame:
    """Distinct pairs (u, v) of the ties of ``heads`` (with a column root) that share a token,
    have different roots and may be linked."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
            place = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(x, np.int32) for x in batch.column("places").to_pylist())])
            token, own = np.concatenate([np.empty(0, np.uint64), *held]), np.repeat(np.arange(len(held)), [len(x) for x in held])
            bucket = ((token >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
            parities = np.frombuffer(b"".join(batch.column("parities").to_pylist()), f"V{CLASSES // 8}")
            of_text = [*(batch.column(c).to_numpy()[own] for c in ("tie", "root", "size")), parities[own]]
            order = np.argsort(bucket, kind="stable")
            columns = [c[order] for c in (token.astype(np.uint32), place, *of_text)]
            cut = words.groups(bucket[order])
            packed = [(int(bucket[order[x]]), *(c[x:y].tobytes() for c in columns)) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            kinds = (pa.int32(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*packed)) or [()] * 7, kinds)], names=["bucket", "tokens", "places", "ties", "roots", "sizes", "parities"])

    def compare(table: pa.Table) -> pa.Table:
        words.tidy()
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        token, tie, root = read("tokens", np.uint32), read("ties", np.int64), read("roots", np.int64)
        size, place = read("sizes", np.int32).astype(np.int64), read("places", np.int32).astype(np.int64)
        parities = read("parities", np.uint64).reshape(-1, CLASSES // 64)
        order = np.lexsort((tie, root, token))
        new = np.concatenate(([True], (token[order][1:] != token[order][:-1]) | (tie[order][1:] != tie[order][:-1])))[: len(token)]
        token, tie, root, size, place, parities = (x[order[new]] for x in (token, tie, root, size, place, parities))
        found = [np.empty((0, 2), np.int64)]
        for i, j in _partners(token, root):
            reach = np.minimum(size[i] - place[i], size[j] - place[j])
            ok = np.flatnonzero((root[i] != root[j]) & enough(reach, size[i], size[j]))
            i, j = i[ok], j[ok]
            apart = np.bitwise_count(parities[i] ^ parities[j]).sum(axis=1, dtype=np.int64)
            ok = 9 * apart <= size[i] + size[j]
            found.append(np.unique(np.sort(np.column_stack((tie[i[ok]], tie[j[ok]])), axis=1), axis=0))
        both = np.unique(np.concatenate(found), axis=0)
        return pa.table({"u": pa.array(both[:, 0]), "v": pa.array(both[:, 1])})

    packed = heads.select("tie", "root", "size", "parities", "tokens", "places").mapInArrow(post, "bucket int, tokens binary, places binary, ties binary, roots binary, sizes binary, parities binary")
    return packed.groupBy("bucket").applyInArrow(compare, "u long, v long").distinct()


def _pivots(group: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of each entry and the first entries of its group's first roots."""
    n = len(group)
    if not n:
        return
    start = np.concatenate(([True], group[1:] != group[:-1]))
    of_root = np.flatnonzero(start | np.concatenate(([True], root[1:] != root[:-1])))
    number = np.cumsum(start) - 1
    first = np.searchsorted(of_root, np.flatnonzero(start))  # each group's first root
    last = np.append(first[1:], len(of_root))
    for p in range(PIVOTS):
        own = np.flatnonzero(first[number] + p < last[number])
        yield own, of_root[first[number[own]] + p]


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of ties whose texts' whole sets reach the similarity.  Parities of
    more classes come first (an exact bound as well), so that few whole sets travel."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = words.HashCache()
        for batch in batches:
            found = [shingles(t, cache) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([len(h) for h in found], pa.int64()), pa.array([_parities(h, FINE) for h in found], pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["tie", "size", "parities", "held"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("size_u").to_numpy() + batch.column("size_v").to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(f"parities_{x}").to_pylist()), np.uint64).reshape(-1, FINE // 64) for x in "uv")
            good = pa.array(9 * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= n)
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:2]], names=["u", "v"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                good.append(enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    def with_both(these: DataFrame, *columns: str) -> DataFrame:
        for x in "uv":
            these = these.join(held.select(F.col("tie").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)), x)
        return these.select("u", "v", *(f"{c}_{x}" for c in columns for x in "uv"))

    named = pairs.select(F.explode(F.array("u", "v")).alias("tie")).distinct()
    held, path = storage.stage(texts.join(named, "tie").select("tie", "text").mapInArrow(sets, "tie long, size long, parities binary, held binary"), "shingle-sets")
    near, n_path = storage.stage(with_both(pairs, "size", "parities").mapInArrow(likely, "u long, v long"), "similar-likely")
    out, _ = storage.stage(with_both(near, "held").mapInArrow(check, "u long, v long"), "similar-pairs")
    storage.drop(pairs.sparkSession, path, n_path)
    return out


def fingerprint_pairs(docs: DataFrame, threshold: int = 2) -> tuple[DataFrame, str]:
    """A stage table and its path: pairs (u, v) of ties whose components are those of all texts within ``threshold``
    bits of each other's SimHash: a text and the least of its fingerprint, and the least
    ones of linked fingerprints."""
    marked, m_path = storage.stage(simhash.fingerprints(docs).groupBy("tie").agg(F.min("fp").alias("fp")), "text-fingerprints")
    classes, c_path = storage.stage(marked.groupBy("fp").agg(F.min("tie").alias("least")), "fingerprint-classes")
    linked, l_path = storage.stage(simhash.links(classes, threshold).distinct(), "fingerprint-links")
    equal = marked.join(classes, "fp").select(F.col("least").alias("u"), F.col("tie").alias("v"))
    for x in "uv":
        linked = linked.join(classes.select(F.col("fp").alias(x), F.col("least").alias(f"least_{x}")), x)
    near = linked.select(F.col("least_u").alias("u"), F.col("least_v").alias("v"))
    out = storage.stage(equal.unionByName(near).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "fingerprint-pairs")
    storage.drop(docs.sparkSession, m_path, c_path, l_path)
    return out


def wide_pairs(heads: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of the ties of ``heads`` whose wide fingerprints meet at an anchor,
    are near in their first 64 bits and whose sizes allow a link.  At an anchor where many
    are at home, each is paired with the first of them; ``replica_pairs`` pairs it with all."""
    n = heads.count()
    short = simhash.short_parts(n)
    # About 32 MB of entries (24 bytes each) to a bucket at most.
    buckets = max(max(storage.partitions(heads.sparkSession), 64) * 4, n * simhash.TABLES * 24 >> 25)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint64).reshape(-1, simhash.WIDE)
            key = simhash.wide_anchors(wide, short).ravel()
            bucket = ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            own = order % max(1, len(wide))
            columns = [key.astype(np.uint32)[order], *(c[own] for c in (batch.column("tie").to_numpy(), batch.column("size").to_numpy(), wide[:, 0]))]
            cut = words.groups(bucket[order])
            packed = [(int(bucket[order[x]]), *(c[x:y].tobytes() for c in columns)) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*packed)) or [()] * 5, kinds)], names=["bucket", "keys", "ties", "sizes", "prints"])

    def compare(table: pa.Table) -> pa.Table:
        words.tidy()
        key, tie, size, fp = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("keys", np.uint32), ("ties", np.int64), ("sizes", np.int32), ("prints", np.uint64)))
        order = np.lexsort((tie, key))
        key, tie, size, fp = (x[order] for x in (key, tie, size.astype(np.int64), fp))
        found = [np.empty((0, 2), np.int64)]
        for i, j in _pivots(key, tie):
            ok = np.flatnonzero((tie[i] != tie[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= NEAR) & enough(np.minimum(size[i], size[j]), size[i], size[j]))
            found.append(np.unique(np.sort(np.column_stack((tie[i[ok]], tie[j[ok]])), axis=1), axis=0))
        both = np.unique(np.concatenate(found), axis=0)
        return pa.table({"u": pa.array(both[:, 0]), "v": pa.array(both[:, 1])})

    packed = heads.select("tie", "size", "wide").mapInArrow(post, "bucket int, keys binary, ties binary, sizes binary, prints binary")
    return packed.groupBy("bucket").applyInArrow(compare, "u long, v long").distinct()


def _meetings(key: np.ndarray, home: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, replica or home) that meet at an anchor and are near; sorted by
    anchor, homes first."""
    cut = words.groups(key)
    first, second = (np.ascontiguousarray(fp[:, w]) for w in range(2))
    at_home = np.add.reduceat(home, cut[:-1], dtype=np.int64) if len(key) else cut[:-1]
    rows, columns, held = [], [], 0
    for lo, hi, n in zip(cut[:-1].tolist(), cut[1:].tolist(), at_home.tolist()):
        if hi - lo < 2:
            continue
        step = max(1, BLOCK // (hi - lo))
        for a in range(lo, lo + n, step):
            own = first[a : min(a + step, lo + n)]
            near = np.flatnonzero(np.bitwise_count(own[:, None] ^ first[lo:hi]) <= NEAR)
            rows.append(near // (hi - lo) + a)
            columns.append(near % (hi - lo) + lo)
            held += len(near)
            if held >= BLOCK:
                yield _both(rows, columns, first, second)
                rows, columns, held = [], [], 0
    if held:
        yield _both(rows, columns, first, second)


def _both(rows: list, columns: list, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.concatenate(rows), np.concatenate(columns)
    apart = np.bitwise_count(first[i] ^ first[j]).astype(np.int64) + np.bitwise_count(second[i] ^ second[j])
    ok = np.flatnonzero(apart <= BOTH)
    return i[ok], j[ok]


def replica_pairs(heads: DataFrame) -> DataFrame:
    """Pairs (u, v) of the ties of ``heads`` (with a column root) of different roots whose wide
    fingerprints are near in their first 128 bits and meet at an anchor where one is at home:
    all homes of an anchor against all its homes and replicas.  A home that is near to many
    there leaves no pairs but rows (tie, 1, anchor), and those it is near to (tie, 0, anchor);
    ``crowd_pairs`` compares them."""
    n = heads.count()
    short = simhash.short_parts(n // FULL)
    each = simhash.COVERED[short] * (6 + 3 * short)  # entries of a text, at least their mean
    # About 32 MB of entries (33 bytes each) to a bucket at most.
    buckets = max(max(storage.partitions(heads.sparkSession), 64) * 4, n * each * 33 >> 25)
    names = ["bucket", "keys", "homes", "ties", "roots", "prints"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = max(1, BLOCK // each)
            for at in range(0, batch.num_rows, part):
                tie, root, wide = (batch.column(c).slice(at, part) for c in range(3))
                wide = np.frombuffer(b"".join(wide.to_pylist()), np.uint64).reshape(-1, simhash.WIDE)
                key, own, home = simhash.wide_places(wide, short)
                bucket = ((key >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                own = own[order]
                # Half a hash tells roots apart; equal ones are left to the exact pass.
                half = words.mix(root.to_numpy().view(np.uint64)).astype(np.uint32)
                columns = [key.astype(np.uint32)[order], home[order], tie.to_numpy()[own], half[own], wide[own, :2]]
                cut = words.groups(bucket[order])
                packed = [(int(bucket[order[x]]), *(c[x:y].tobytes() for c in columns)) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*packed), (pa.int32(), *[pa.binary()] * 5))], names=names)

    def compare(table: pa.Table) -> pa.Table:
        words.tidy()
        kinds = (np.uint32, np.bool_, np.int64, np.uint32, np.uint64)
        key, home, tie, root, fp = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in zip(names[1:], kinds))
        order = np.lexsort((~home, key))
        key, home, tie, root, fp = (x[order] for x in (key, home, tie, root, fp.reshape(-1, 2)))
        found = [np.empty((0, 2), np.int64)]
        crowd = np.zeros(len(key), np.int8)  # 1: near to a home of many, 2: such a home
        for i, j in _meetings(key, home, fp):
            ok = np.flatnonzero((tie[i] != tie[j]) & (root[i] != root[j]))
            i, j = i[ok], j[ok]
            many = np.bincount(i, minlength=len(key))[i] > FEW
            crowd[j[many]] |= 1
            crowd[i[many]] |= 2
            i, j = i[~many], j[~many]
            found.append(np.unique(np.sort(np.column_stack((tie[i], tie[j])), axis=1), axis=0))
        both, at = np.unique(np.concatenate(found), axis=0), np.flatnonzero(crowd)
        anchor = (int(table.column("bucket")[0].as_py()) << 32 if len(key) else 0) + key[at].astype(np.int64)
        u, v = np.concatenate((both[:, 0], tie[at])), np.concatenate((both[:, 1], (crowd[at] > 1).astype(np.int64)))
        return pa.table({"u": pa.array(u), "v": pa.array(v), "anchor": pa.concat_arrays([pa.nulls(len(both), pa.int64()), pa.array(anchor)])})

    packed = heads.select("tie", "root", "wide").mapInArrow(post, "bucket int, keys binary, homes binary, ties binary, roots binary, prints binary")
    return packed.groupBy("bucket").applyInArrow(compare, "u long, v long, anchor long")


def crowd_pairs(crowds: DataFrame, heads: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of ties that meet in ``crowds`` (u, v, anchor), as left by
    ``replica_pairs``, have different roots and whose sizes and parities allow a link.  Only
    rows in proportion to the crowds travel; their pairs are compared in memory."""
    buckets = max(storage.partitions(heads.sparkSession), 64) * 4

    def compare(table: pa.Table) -> pa.Table:
        words.tidy()
        anchor, home, tie, root, size = (table.column(c).to_numpy() for c in ("anchor", "home", "tie", "root", "size"))
        parities = np.frombuffer(b"".join(table.column("parities").to_pylist()), np.uint64).reshape(-1, CLASSES // 64)
        order = np.lexsort((tie, -home, anchor))
        anchor, home, tie, root, size, parities = (x[order] for x in (anchor, home, tie, root, size.astype(np.int64), parities))
        cut, found, seen = words.groups(anchor), np.empty((0, 2), np.int64), []
        at_home = np.add.reduceat(home, cut[:-1]) if len(home) else cut[:-1]
        for lo, hi, n in zip(cut[:-1].tolist(), cut[1:].tolist(), at_home.tolist()):
            step = max(1, BLOCK // (hi - lo) // 4)
            for a in range(lo, lo + n, step):
                b, all_ = min(a + step, lo + n), slice(lo, hi)
                apart = sum(np.bitwise_count(parities[a:b, None, w] ^ parities[all_, w]).astype(np.int64) for w in range(CLASSES // 64))
                total = size[a:b, None] + size[all_]
                ok = (root[a:b, None] != root[all_]) & (9 * apart <= total) & enough(np.minimum(size[a:b, None], size[all_]), size[a:b, None], size[all_])
                i, j = np.nonzero(ok)
                seen.append(np.sort(np.column_stack((tie[a + i], tie[lo + j])), axis=1))
            if sum(map(len, seen)) > BLOCK:
                found, seen = np.unique(np.concatenate((found, *seen)), axis=0), []
        both = np.unique(np.concatenate((found, *seen)), axis=0)
        return pa.table({"u": pa.array(both[:, 0]), "v": pa.array(both[:, 1])})

    members = crowds.select("anchor", F.col("v").alias("home"), F.col("u").alias("tie")).join(heads.select("tie", "root", "size", "parities"), "tie")
    spread = members.select(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"), "anchor", "home", "tie", "root", "size", "parities")
    return spread.groupBy("bucket").applyInArrow(compare, "u long, v long").distinct()


def possible(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """``pairs`` without those whose sizes or parities of few classes exclude a link."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(f"parities_{x}").to_pylist()), np.uint64).reshape(-1, CLASSES // 64) for x in "uv")
            m, n = (batch.column(f"size_{x}").to_numpy().astype(np.int64) for x in "uv")
            good = pa.array(enough(np.minimum(m, n), m, n) & (9 * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= m + n))
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(good) for x in "uv"], names=["u", "v"])

    for x in "uv":
        pairs = pairs.join(heads.select(F.col("tie").alias(x), F.col("size").alias(f"size_{x}"), F.col("parities").alias(f"parities_{x}")), x)
    return pairs.mapInArrow(likely, "u long, v long")


def rooted(docs: DataFrame) -> DataFrame:
    """(tie, root) of the texts in components of several texts, but the roots."""
    spark = docs.sparkSession
    rows = keyed(storage.bounded(docs))
    heads, h_path = storage.stage(prefixes(rows, frequent(rows)), "prefixes")
    shared, s_path = storage.stage(shared_prefixes(heads, bucket_count(docs)), "shared-prefixes")
    # The texts that share a token, one row each: whatever many rows repeat travels once.
    holders = rows.groupBy("tie").agg(F.min("key").alias("key")).join(shared.select("tie"), "tie")
    texts, f_path = storage.stage(rows.join(holders, ["key", "tie"]).select("key", "tie", "text").dropDuplicates(["key", "tie"]).select("tie", "text"), "shared-texts")
    known = spark.createDataFrame([], "tie long, root long")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The roots once these pairs are verified too."""
        pairs, path = storage.stage(pairs, name)
        # A component's star stands for its links: plans do not grow with the passes.
        near = verified(texts, pairs).unionByName(known.select(F.col("tie").alias("u"), F.col("root").alias("v")))
        storage.drop(spark, path)
        return graph.components(near).select(F.col("vertex").alias("tie"), "root")

    def with_roots(of: DataFrame) -> DataFrame:
        return of.join(known, "tie", "left").withColumn("root", F.coalesce("root", "tie"))

    close, c_path = fingerprint_pairs(docs)
    known = linked(close.unionByName(possible(wide_pairs(heads), heads)).distinct(), "simhash-pairs")
    own = with_roots(heads)
    met, m_path = storage.stage(replica_pairs(own), "replica-meetings")
    few = possible(met.where("anchor is null").select("u", "v").distinct(), heads)
    known = linked(few.unionByName(crowd_pairs(met.where("anchor is not null"), own)).distinct(), "replica-pairs")
    known = linked(candidates(with_roots(shared), max(storage.partitions(spark), 64) * 4), "missed-pairs")
    storage.drop(spark, h_path, c_path, m_path, s_path, f_path)
    return known


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` from each component, with all its columns: the smallest
    doc_id (null only if all are), then the smallest text hash."""
    rows = keyed(docs).select("key", "tie").join(rooted(docs), "tie", "left").withColumn("root", F.coalesce("root", "tie"))
    first = rows.groupBy("root").agg(F.min(F.struct("key", "tie")).alias("x")).select(F.col("x.key").alias("__key"), F.col("x.tie").alias("__tie")).distinct()
    own = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("__tie", F.xxhash64("text"))
    kept = own.join(first, ["__key", "__tie"]).dropDuplicates(["__key", "__tie"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
