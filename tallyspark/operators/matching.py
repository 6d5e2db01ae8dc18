"""1:1 caliper matching of two sides by a score, in sorted ranges with carried ends.

Both sides are walked in order of (score, id).  An arriving row is matched to the first
waiting row of the other side whose score is within the caliper; if none waits, it waits
itself; waiting rows that fell out of reach leave.  This gives as many pairs as any 1:1
matching can, and the k-th matched row of one side meets the k-th of the other.

Rows of equal score count together, and those matched are the first by id, so it is enough
to know how many of each score and side are matched.  Scores lie in ranges, a task each; a
range hands what still waits at its end to the next one.  Ranges are walked again while
what they are handed changes: twice as a rule, once more for each range that a change
passes through; ranges whose start did not change keep their result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.readers import delete, staged_at

MATCHED = "kind string, part int, score double, left_n long, right_n long"


def walk(scores: Iterable[tuple[float, int, int]], waiting: list[tuple[float, int, int]], caliper: float) -> tuple[dict, list]:
    """Matched rows {(score, side): n} of ascending (score, left, right) counts, after what
    already waits, and what waits at the end.  Side 0 is the left one."""
    matched: dict[tuple[float, int], int] = {}
    queue = deque([s, *([0, a] if a else [1, b])] for s, a, b in waiting)
    for score, left, right in scores:
        for side, n in ((0, left), (1, right)):
            while queue and score - queue[0][0] > caliper:
                queue.popleft()
            while n and queue and queue[0][1] != side:
                other = queue[0]
                k = min(n, other[2])
                for key in ((score, side), (other[0], other[1])):
                    matched[key] = matched.get(key, 0) + k
                n, other[2] = n - k, other[2] - k
                if not other[2]:
                    queue.popleft()
            if n:
                queue.append([score, side, n])
    return matched, [(s, *((n, 0) if side == 0 else (0, n))) for s, side, n in queue]


def _counts(left: DataFrame, right: DataFrame, parts: int) -> tuple[DataFrame, str]:
    both = left.select("score", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("score", F.lit(0).alias("l"), F.lit(1).alias("r")))
    sums = both.repartitionByRange(parts, "score").groupBy("score").agg(F.sum("l").cast("long").alias("left_n"), F.sum("r").cast("long").alias("right_n"))
    return staged_at(sums.select(F.spark_partition_id().alias("part"), "score", "left_n", "right_n"), "scores")


def _quotas(counts: DataFrame, caliper: float, parts: int) -> tuple[DataFrame, list[str]]:
    """(score, left_n, right_n): matched rows of each score and side."""
    kind = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("score", pa.float64()), ("left_n", pa.int64()), ("right_n", pa.int64())])
    spark = counts.sparkSession

    def run(key, own: pa.Table, handed: pa.Table) -> pa.Table:
        rows = lambda t: sorted(zip(*(t.column(c).to_pylist() for c in ("score", "left_n", "right_n"))))
        part = key[0].as_py()  # a range without rows hands on what it is handed
        matched, waiting = walk(rows(own), rows(handed), caliper)
        out = [("matched", part, s, n if side == 0 else 0, n if side == 1 else 0) for (s, side), n in matched.items()]
        out += [("waits", part + 1, *w) for w in waiting if part + 1 < parts]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, kind)], schema=kind)

    handed, paths, before = spark.createDataFrame([], MATCHED), [], None
    for _ in range(parts + 1):
        start = handed.where("kind = 'waits'").select("part", "score", "left_n", "right_n")
        made = counts.groupBy("part").cogroup(start.groupBy("part")).applyInArrow(run, MATCHED)
        handed, path = staged_at(made, "matched")
        paths.append(path)
        now = handed.where("kind = 'waits'").agg(F.count("*"), F.sum(F.xxhash64("part", "score", "left_n", "right_n").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    sums = handed.where("kind = 'matched'").groupBy("score").agg(F.sum("left_n").alias("left_n"), F.sum("right_n").alias("right_n"))
    return sums, paths


def caliper_pairs(left: DataFrame, right: DataFrame, caliper: float, parts: int | None = None) -> DataFrame:
    """(left_id, right_id, left_score, right_score) of rows (id, score) on either side.
    Null scores match nothing; equal ids may repeat on a side, each row for itself."""
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (df.where("score IS NOT NULL AND NOT isnan(score)").select("id", F.col("score").cast("double").alias("score")) for df in (left, right))
    counts, path = _counts(left, right, parts)
    quotas, paths = _quotas(counts, caliper, parts)
    quotas, _ = staged_at(quotas, "quotas")
    delete(left.sparkSession, path, *paths)
    before = {}
    for side in ("left_n", "right_n"):
        # Distinct scores are ordered in ranges again; only the ranges' sums meet.
        dealt = quotas.where(F.col(side) > 0).repartitionByRange(parts, "score").withColumn("part", F.spark_partition_id())
        own, _ = staged_at(dealt.select("part", "score", F.col(side).alias("n")), "places")
        within = F.sum("n").over(Window.partitionBy("part").orderBy("score")) - F.col("n")
        sums = own.groupBy("part").agg(F.sum("n").alias("all"))
        starts = sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("start"))
        before[side] = own.withColumn("within", within).join(F.broadcast(starts), "part").select("score", "n", (F.col("start") + F.col("within")).alias("start"))
    sides = []
    for df, side, name in ((left, "left_n", "left"), (right, "right_n", "right")):
        rank = F.row_number().over(Window.partitionBy("score").orderBy("id")) - 1
        found = df.join(before[side], "score").withColumn("rank", rank).where(F.col("rank") < F.col("n"))
        sides.append(found.select((F.col("start") + F.col("rank")).alias("k"), F.col("id").alias(f"{name}_id"), F.col("score").alias(f"{name}_score")))
    return sides[0].join(sides[1], "k").select("left_id", "right_id", "left_score", "right_score")
