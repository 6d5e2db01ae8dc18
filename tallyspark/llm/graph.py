"""Connected components of an edge table, distributed.

Alternating large-star and small-star contraction: every vertex's neighbours are
linked to the smallest label near it until each component is a star.  Each half of a
round is a min-aggregation and an equi-join; its result is a table in the shared folder,
so no lineage grows, plans stay small (one plan of both halves would read the edges 12
times) and a lost executor repeats the tasks of half a round at most.  Rounds grow
with the logarithm of a component's diameter.  Only a row count and a checksum reach
the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import storage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (u, v) but the roots themselves."""
    spark = edges.sparkSession
    state = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    paths: list[str] = []
    seen = None
    while True:
        for large in (True, False):
            state, path = storage.stage(_star(state, large), "components")
            paths.append(path)
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
        storage.drop(spark, *paths[:-1])
        del paths[:-1]
    return state.select(F.col("u").alias("vertex"), F.col("v").alias("root"))


def local_roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Component roots of ``n`` vertices under edges a-b, by vectorised hooking."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        label[np.maximum(la, lb)] = np.minimum(la, lb)
        while not np.array_equal(up := label[label], label):
            label = up
