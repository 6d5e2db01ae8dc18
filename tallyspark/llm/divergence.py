"""Source divergence audit: how far apart the sources of a language are, and which terms
set a source apart.

Terms are counted once; what circulates afterwards are compressed count vectors of the kept
terms.  A language's terms are dealt into blocks by hash, and a vector has one row per
group (language and source) and block, so no row grows with the number of terms.

Systolic rotation.  The groups of a language are dealt to ``CELLS`` cells.  A cell's vectors
stay where one exchange has put them; the vectors of the other cells come by in the rounds
of a round-robin tournament (circle method), so that any two cells meet once.  A meeting
compares the residents with the visitors block by block and reports both directions.
Sources of one cell are compared in a round of their own, in which the whole language's
vector, with the words of the block, comes by too: there each resident keeps a heap of its
``TOP`` leading terms.  All rounds read one exchange of residents; a round's visitors are
read from the staged vectors, so a lost executor repeats that round's tasks alone.

Shares are whole numbers, exact for up to 9e15 words: 1 + floor(1e9 (count + 5) / (N + 5 V)),
by long division in base 1,000.  Absent terms count 0, so the distance of two groups is a
sum over the terms that either has, plus the rest of the block times one difference.

Null text, language and source are empty strings.  Texts without terms, and groups without
any, take part with counts of 0; a language without kept terms has distances of 0.  Very
long texts: read whole, counts leave when there are many.  Repeated rows count each.  Extra
columns are ignored.  Empty table: no row.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import storage
from tallyspark.llm.words import tidy

SCALE, SMOOTH, TOP, CELLS = 1_000_000_000, 5, 50, 8
#: Different (language, source, term) counts that a task holds at most.
HELD = 200_000
#: Counts of kept terms that a block has on average, at most.
BLOCK = 100_000
#: Letters in lower case; all other ASCII bytes part terms.
TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term, added up within
    tasks; and a row without a term for every group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def flush():
            for (lang, source), (n, df) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    own = terms[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[t] for t in own], pa.int64()), pa.array([df[t] for t in own], pa.int64())], schema=schema)
            held.clear()
            tidy()

        groups = set()
        for batch in batches:
            for text, lang, source in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                key = (lang or "", source or "")
                if key not in groups:
                    groups.add(key)
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([None], pa.string()), pa.array([0]), pa.array([0])], schema=schema)
                text = text.as_py()
                if not text:
                    continue
                n, df = held.setdefault(key, (Counter(), Counter()))
                own = Counter(text.encode().translate(TERMS).split())
                size += len(own) - len(n)
                n.update(own)
                df.update(own.keys())
                size += len(n) - len(own)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    texts = docs.select(*(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    return storage.bounded(texts).mapInArrow(count, "lang string, source string, term string, n long, df long")


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH terms)), exactly."""
    whole = total + SMOOTH * terms
    if whole > 9_000_000_000_000_000:
        raise OverflowError("more words than exact shares allow")
    rest = count.astype(np.int64) + SMOOTH
    out = rest // whole
    rest = rest % whole
    for _ in range(3):  # SCALE is 1000 to the third
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places and their counts, as differences, compressed."""
    body = np.concatenate((np.diff(places, prepend=0), counts)).astype("<i8").tobytes()
    return pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(vector: bytes, terms: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(vector, 16 * terms, codec="zstd", asbytes=True), "<i8")
    return np.cumsum(both[:terms]), both[terms:]


VECTOR = "lang string, block int, source string, here long, terms long, n long, vector binary, words binary"


def vectors(kept: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """One row per group and block, and per language and block (null source) with the
    block's words: terms it has (terms), of those kept there (here), their occurrences (n)."""
    kind = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("source", pa.string()), ("here", pa.int64()), ("terms", pa.int64()), ("n", pa.int64()), ("vector", pa.binary()), ("words", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        lang, block = table.column("lang")[0].as_py(), table.column("block")[0].as_py()
        words = table.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(np.array([w.encode() for w in words.dictionary.to_pylist()], object), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at, n = place[words.indices.to_numpy()], table.column("n").to_numpy()
        names = table.column("source").combine_chunks().dictionary_encode()
        by = names.indices.to_numpy()
        sort = np.lexsort((at, by))
        cuts = np.searchsorted(by[sort], np.arange(len(names.dictionary) + 1))
        rows = []
        for i, source in enumerate(names.dictionary.to_pylist()):
            own = sort[cuts[i] : cuts[i + 1]]
            rows.append((lang, block, source, len(order), len(own), int(n[own].sum()), _packed(at[own], n[own]), None))
        total = np.zeros(len(order), np.int64)
        np.add.at(total, at, n)
        text = "\n".join(words.dictionary.take(pa.array(order)).to_pylist()).encode()
        rows.append((lang, block, None, len(order), len(order), int(n.sum()), _packed(np.arange(len(order)), total), pa.compress(text, codec="zstd", asbytes=True)))
        rows[-1] = (*rows[-1][:-1], len(text).to_bytes(8, "little") + rows[-1][-1])
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)

    dealt = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    made, _ = storage.stage(dealt.select("lang", "block", "source", "term", "n").groupBy("lang", "block").applyInArrow(pack, VECTOR), "vectors")
    # Every group has a row in each block that its language has, empty where it has no term.
    held = made.where("source IS NULL").select("lang", "block", F.col("here").alias("all_here"))
    every = groups.select("lang", "source").join(held, "lang")
    full = every.join(made.drop("here"), ["lang", "block", "source"], "left").withColumnRenamed("all_here", "here")
    empty = F.lit(_packed(np.empty(0, np.int64), np.empty(0, np.int64)))
    of_groups = full.select("lang", "block", "source", "here", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("vector", empty).alias("vector"), F.lit(None).cast("binary").alias("words"))
    return of_groups.unionByName(made.where("source IS NULL"))


def rounds(cells: int) -> list[list[tuple[int, int]]]:
    """Circle method: each round pairs all cells, (host, visitor); any two meet once.  Hosts
    take turns, so that every cell is at home about as often."""
    ring, out = list(range(cells)), []
    for r in range(cells - 1):
        pairs = [(ring[i], ring[-1 - i]) for i in range(cells // 2)]
        out.append([(a, b) if (r + i) % 2 else (b, a) for i, (a, b) in enumerate(pairs)])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


MEETING = "lang string, source string, part string, item string, value long"


def _share_rows(table: pa.Table) -> list[tuple]:
    """(source, total, v, here, places, shares, share of an absent term, words) of each row."""
    out = []
    for row in table.to_pylist():
        places, counts = _unpacked(row["vector"], row["terms"])
        absent = int(shares(np.zeros(1, np.int64), row["total"], row["v"])[0])
        out.append((row["source"], row["here"], places, shares(counts, row["total"], row["v"]), absent, counts, row["words"]))
    return out


def _dense(row: tuple) -> np.ndarray:
    full = np.full(row[1], row[4], np.int64)
    full[row[2]] = row[3]
    return full


def _distance(a: np.ndarray, row: tuple) -> int:
    """Sum of differences of a dense vector and a packed one, over the block."""
    places, own, absent = row[2], row[3], row[4]
    at = a[places]
    return int(np.abs(a - absent).sum() - np.abs(at - absent).sum() + np.abs(at - own).sum())


def _meet(key, residents: pa.Table, visitors: pa.Table) -> pa.Table:
    """Both directions of every pair of a resident and a visitor, on one block."""
    lang, out = key[1].as_py(), []
    guests = _share_rows(visitors)
    for host in _share_rows(residents):
        dense = _dense(host)
        for guest in guests:
            value = _distance(dense, guest)
            out += [(lang, host[0], "pair", guest[0], value), (lang, guest[0], "pair", host[0], value)]
    return _rows(out)


def _at_home(key, residents: pa.Table, language: pa.Table) -> pa.Table:
    """Pairs of residents, both directions, and each resident's leading terms of the block
    against the language."""
    lang, out, hosts = key[1].as_py(), [], _share_rows(residents)
    words = None
    for i, host in enumerate(hosts):
        dense = _dense(host)
        for guest in hosts[:i]:
            value = _distance(dense, guest)
            out += [(lang, host[0], "pair", guest[0], value), (lang, guest[0], "pair", host[0], value)]
    for whole in _share_rows(language):
        packed = whole[6]
        words = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True).decode().split("\n")
        q = _dense(whole)
        for host in hosts:
            lead = host[3] - q[host[2]]
            up = np.flatnonzero(lead > 0)
            # Places follow the terms' order, so ties go to the lesser place.
            best = heapq.nsmallest(TOP, zip((-lead[up]).tolist(), host[2][up].tolist()))
            out += [(lang, host[0], "term", words[place], -f) for f, place in best]
    return _rows(out)


def _rows(rows: list[tuple]) -> pa.Table:
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)


def meetings(placed: DataFrame, whole: DataFrame, cells: int) -> DataFrame:
    """All rounds: distances and leading terms by block, of groups seated in cells."""
    at, parts = ["cell", "lang", "block"], storage.partitions(placed.sparkSession)
    residents = placed.repartition(parts, *at)
    home = residents.groupBy(*at).cogroup(whole.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).repartition(parts, *at).groupBy(*at)).applyInArrow(_at_home, MEETING)
    for pairs in rounds(cells):
        to = F.create_map(*(F.lit(x) for host, visitor in pairs for x in (visitor, host)))
        visitors = placed.withColumn("cell", to[F.col("cell")]).where("cell IS NOT NULL").repartition(parts, *at)
        home = home.unionByName(residents.groupBy(*at).cogroup(visitors.groupBy(*at)).applyInArrow(_meet, MEETING))
    return home


def audit(docs: DataFrame, min_docs: int = 30, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group: its distance from each other
    source of the language (part pair) and its leading terms (part term)."""
    if cells % 2:
        raise ValueError("an even number of cells is needed")
    spark = docs.sparkSession
    counts, _ = storage.stage(term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "terms")
    groups = counts.where("term IS NULL").select("lang", "source")
    each = F.collect_list(F.struct("source", "n")).alias("each")
    common = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("df").alias("df"), each).where(F.col("df") >= min_docs)
    kept, _ = storage.stage(common.select("lang", "term", F.explode("each").alias("e")).select("lang", "term", "e.source", "e.n"), "kept")
    blocks = max(8, -(-kept.count() // BLOCK))
    made = vectors(kept, groups, blocks)
    sums = made.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("here").alias("v"))
    # Sources of a language in turn to the cells; the language itself (null) has none.
    turn = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) % cells
    seats = groups.select("lang", "source", turn.cast("int").alias("cell"))
    known = made.alias("m").join(sums.alias("s"), (F.col("m.lang") == F.col("s.lang")) & F.col("m.source").eqNullSafe(F.col("s.source"))).select("m.*", "s.total", "s.v")
    whole = known.where("source IS NULL")
    placed, _ = storage.stage(known.where("source IS NOT NULL").join(seats, ["lang", "source"]), "seats")
    whole, _ = storage.stage(whole, "languages")
    met, _ = storage.stage(meetings(placed, whole, cells), "meetings")
    added = met.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # Languages without kept terms meet in no block.
    bare = groups.join(sums.select("lang").distinct(), "lang", "left_anti")
    others = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item")
    added = added.unionByName(others.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    leading = met.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return added.withColumn("rank", F.row_number().over(order)).unionByName(leading)


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), o AS (
  SELECT lang, source, row, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT row) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY 1
), gn AS (
  SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v) AS p
  FROM gn JOIN kept ON gn.lang = kept.lang JOIN v ON gn.lang = v.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY 1) USING (lang) JOIN v USING (lang) GROUP BY 1, 2
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(pa.p - pb.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source
  LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term GROUP BY ALL
), term AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (FROM pair UNION ALL FROM term) QUALIFY part = 'pair' OR rank <= 50
"""
