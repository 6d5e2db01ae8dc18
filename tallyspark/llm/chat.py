"""Chat formatting: cumulative-snapshot collapse, then rendering; DataFrame functions only.

Logs often hold a conversation again at every turn.  Rolling turn-prefix hashes (two
64-bit lanes, each the running XOR of a hash of the turn's place and content) name
every prefix of every conversation.  A conversation whose full hash is a proper prefix
of another one is dropped by anti-join; of equal conversations the smallest conv_id
stays.  What is left is rendered in ``part_turns`` turns a row.

Turns are ordered by (turn, role, text) with a range partitioning, so one conversation
that holds a third of all turns spreads over many tasks; a sorted row's number gives its
place, and places and hashes carry over from partition to partition by one row per
(conversation, partition).  After the sort only numbers and hashes travel: a row is named
by 128 bits of its content, and texts are joined once, to the turns that stay.  Prefixes
are made distinct, with partial aggregation, before they meet the full hashes, so a first
turn shared by a third of all conversations counts once.

Nulls: a null role or text renders as empty but is told apart from an empty one; a
null turn sorts first; turns with a null conv_id form one conversation.  Repeated rows
are turns of their own; ties in turn are ordered by role and text.  Very long texts:
hashed and rendered where they stand, a row at a time; very long conversations: in
parts of ``part_turns``.  Empty table: no rows.  Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import storage

PART_TURNS = 256
START, STOP = "<|im_start|>", "<|im_end|>"


def _named(turns: DataFrame) -> DataFrame:
    """Turns with conv_id as (cid, none), two hashes of the content and two of the row."""
    out = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("cid"), F.col("conv_id").isNull().alias("none"), "turn", "role", "text")
    for i, salt in ((1, 11), (2, 23)):
        content = F.xxhash64(F.lit(salt), F.col("role").isNull(), F.col("role"), F.lit(salt + 1), F.col("text").isNull(), F.col("text"))
        out = out.withColumn(f"c{i}", content)
    return out.withColumns({f"r{i}": F.xxhash64(F.lit(salt), "none", "cid", F.col("turn").isNull(), "turn", "c1", "c2") for i, salt in ((1, 31), (2, 47))})


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(cid, none, r1, r2, pos, n_turns, h1, h2): each turn's name with the hash of the
    conversation up to it and the conversation's length."""
    spark = turns.sparkSession
    conv, order = ["cid", "none"], ["turn", "role", "text"]
    ranged = _named(turns).repartitionByRange(storage.partitions(spark), *conv, *order).sortWithinPartitions(*conv, *order)
    # Numbers of sorted rows: the partition in the upper bits; data from here on.
    ranged, r_path = storage.stage(ranged.select(*conv, "c1", "c2", "r1", "r2", F.monotonically_increasing_id().alias("at")), "turns")
    ranged = ranged.withColumn("pid", F.shiftright("at", 33))
    # One row per (conversation, partition it reaches into).
    sizes = ranged.groupBy(*conv, "pid").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    across = Window.partitionBy(*conv).orderBy("pid")
    sizes = sizes.select(*conv, "pid", (F.sum("n").over(across) - F.col("n") - F.col("low") + 1).alias("shift"), F.sum("n").over(Window.partitionBy(*conv)).alias("n_turns"))
    placed = ranged.join(sizes, [*conv, "pid"]).withColumn("pos", F.col("at") + F.col("shift"))
    lanes = {f"l{i}": F.xxhash64(F.lit(salt), "pos", "c1", "c2") for i, salt in ((1, 11), (2, 23))}
    placed, p_path = storage.stage(placed.withColumns(lanes).select(*conv, "pid", "pos", "n_turns", "r1", "r2", "l1", "l2"), "turn-hashes")
    running = Window.partitionBy("pid", *conv).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({f"x{i}": F.bit_xor(f"l{i}").over(running) for i in (1, 2)})
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*conv, "pid").agg(*(F.bit_xor(f"l{i}").alias(f"s{i}") for i in (1, 2)))
    sums = sums.select(*conv, "pid", *(F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)))
    hashed = own.join(sums, [*conv, "pid"]).select(*conv, "r1", "r2", "pos", "n_turns", *(F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)))
    hashed, _ = storage.stage(hashed, "turn-prefixes")
    storage.drop(spark, r_path, p_path)
    return hashed


def maximal(hashed: DataFrame) -> DataFrame:
    """(cid, none, n_copies) of the conversations that prefix no longer one."""
    key = ["len", "h1", "h2"]
    full = hashed.where(F.col("pos") == F.col("n_turns")).groupBy(F.col("pos").alias("len"), "h1", "h2").agg(F.min(F.struct("none", "cid")).alias("first"), F.count("*").alias("n_copies"))
    proper = hashed.where(F.col("pos") < F.col("n_turns")).select(F.col("pos").alias("len"), "h1", "h2").distinct()
    return full.join(proper, key, "left_anti").select("first.cid", "first.none", "n_copies")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(STOP + "\n"))


def collapse(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, rendered): maximal conversations in order."""
    hashed = prefix_hashes(turns)
    kept = hashed.join(maximal(hashed), ["cid", "none"])
    # Equal rows of one conversation stand side by side and share a name.
    named = kept.groupBy("r1", "r2").agg(F.min("pos").alias("first"), F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"))
    own = _named(turns).select("cid", "none", "r1", "r2", render(F.col("role"), F.col("text")).alias("s")).join(named, ["r1", "r2"])
    again = F.row_number().over(Window.partitionBy("r1", "r2").orderBy("first")) - 1
    own = own.withColumn("pos", F.col("first") + again).withColumn("part", F.floor((F.col("pos") - 1) / part_turns).cast("int"))
    grouped = own.groupBy("cid", "none", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("turns"))
    conv_id = F.when(~F.col("none"), F.col("cid")).cast(turns.schema["conv_id"].dataType)
    return grouped.select(conv_id.alias("conv_id"), "part", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: t["s"]), "").alias("rendered"))


SQL = """
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations
), p AS (
  SELECT *, string_agg(md5(role) || md5(text), '') OVER (
           PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t
), f AS (
  SELECT min(conv_id) AS conv_id, prefix, count(*) AS n_copies
  FROM p WHERE pos = n_turns GROUP BY prefix
), kept AS (
  SELECT * FROM f WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n_turns)
)
SELECT t.conv_id, CAST((t.pos - 1) // 256 AS INTEGER) AS part, t.n_turns, kept.n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN kept USING (conv_id)
GROUP BY 1, 2, 3, 4
"""
