"""Queries over the driver's tables, each beside the SQL that checks it.

``Tables`` binds the evaluation tables (samples, transcriptions, checkpoints, ...) to
columns of the driver's tables; ``S`` is the same binding in SQL.  The binding tests
computation, it says nothing about any model.  ``Tables.chosen`` filters by model and
condition on the raw columns behind them, so that these filters reach the Parquet scan.
Results are rounded here, never inside an operator.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.functions import scalars as sc
from tallyspark.operators import controls, leaks, matching, metrics, posterior, stats, training
from tallyspark.plans import gates, report
from tallyspark.sources import images, readers, schemas, tensors

KS, SEED_KS, REPLICATES = [1, 8, 16, 64], [1, 8], 200
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        return self.chosen()

    def chosen(self, model: str | None = None, conditions: str | None = None) -> DataFrame:
        """Samples of one model ("base", "rl"), or of some conditions ("T", "DE", ...)."""
        raw = self.lineitem
        if model:
            raw = raw.where("l_linestatus = 'F'" if model == "base" else "l_linestatus <> 'F'")
        if conditions:
            raw = raw.where(F.col("l_returnflag").isin([{"T": "A", "D": "N", "E": "R"}[c] for c in conditions]))
        model = F.when(F.col("l_linestatus") == "F", "base").otherwise("rl")
        condition = F.when(F.col("l_returnflag") == "A", "T").when(F.col("l_returnflag") == "N", "D").otherwise("E")
        family = F.when(F.col("l_partkey") % 3 == 0, "3B").when(F.col("l_partkey") % 3 == 1, "7B").otherwise("2B")
        return raw.select(
            F.col("l_suppkey").alias("problem_id"), model.alias("model"), condition.alias("condition"), family.alias("model_family"),
            F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") % 3).alias("seed"),
            F.col("l_tax").cast("decimal(4,2)").alias("temperature"), (F.col("l_discount") >= 0.1).alias("correct"),
            (F.col("l_quantity") * 10).cast("int").alias("n_tokens"), (F.col("l_partkey") % 4 != 0).alias("answered"),
            F.concat(F.lit("we get #### 12 and so #### "), F.format_number("l_extendedprice", 2)).alias("completion"),
            F.col("l_extendedprice").cast("decimal(38,10)").alias("truth"), "l_orderkey", "l_linenumber", "l_partkey",
        )

    @cached_property
    def transcripts(self) -> DataFrame:
        return controls.join_transcripts(self.conversations)

    @cached_property
    def checkpoints(self) -> DataFrame:
        step = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
        rows = self.orders.select((F.col("o_custkey") % 3).cast("int").alias("seed"), step.alias("step"), (F.col("o_totalprice") > 200000).cast("double").alias("hit"))
        return rows.groupBy("seed", "step").agg(F.round(F.avg("hit"), 6).alias("pass1"))

    @cached_property
    def weights(self) -> DataFrame:
        digest = lambda edited: F.md5(F.concat_ws("|", "p_name", "p_brand", F.when(edited, F.lit("edited")).otherwise(F.col("p_size").cast("string"))))
        before = self.part.select(F.lit("before").alias("phase"), F.col("p_partkey").alias("param_key"), F.col("p_type").alias("module"), digest(F.lit(False)).alias("digest"))
        after = self.part.where("p_partkey % 97 <> 3").select(F.lit("after").alias("phase"), F.col("p_partkey").alias("param_key"), F.col("p_type").alias("module"), digest(F.col("p_partkey") % 50 == 0).alias("digest"))
        return before.unionByName(after)

    @cached_property
    def reviews(self) -> DataFrame:
        return self.labels.select(F.col("doc_id").alias("sample_id"), F.when(F.col("quality") == 0, "spurious").otherwise("sound").alias("verdict"))

    @cached_property
    def correct_traces(self) -> DataFrame:
        return self.documents.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("condition"), F.col("source").alias("model"))

    @cached_property
    def rollouts(self) -> DataFrame:
        s = self.lineitem
        return s.select(F.col("l_suppkey").alias("problem_id"), F.col("l_linenumber").alias("step"), F.col("l_orderkey").alias("attempt"), "l_partkey", (F.col("l_discount") >= 0.1).cast("double").alias("reward"))

    @cached_property
    def transcribed(self) -> DataFrame:
        """Condition D samples with whether their transcription was right."""
        return self.chosen(conditions="D").select("model", "problem_id", "correct", (F.col("l_partkey") % 2 == 0).alias("match"))


S = """s AS (
  SELECT l_suppkey AS problem_id, CASE l_linestatus WHEN 'F' THEN 'base' ELSE 'rl' END AS model,
         CASE l_returnflag WHEN 'A' THEN 'T' WHEN 'N' THEN 'D' ELSE 'E' END AS condition,
         CASE l_partkey % 3 WHEN 0 THEN '3B' WHEN 1 THEN '7B' ELSE '2B' END AS model_family,
         CASE WHEN l_linestatus = 'O' THEN l_linenumber % 3 END AS seed,
         CAST(l_tax AS DECIMAL(4,2)) AS temperature, l_discount >= 0.1 AS correct,
         CAST(l_quantity * 10 AS INTEGER) AS n_tokens, l_partkey % 4 <> 0 AS answered,
         'we get #### 12 and so #### ' || format('{:,.2f}', l_extendedprice) AS completion,
         CAST(l_extendedprice AS DECIMAL(38,10)) AS truth, l_orderkey, l_linenumber, l_partkey
  FROM lineitem)"""
EXTRACT = r"regexp_extract_all(completion, '####\s*(-?[0-9][0-9,]*(?:\.[0-9]+)?)', 1)[-1]"
NUMBER = f"TRY_CAST(replace({EXTRACT}, ',', '') AS DECIMAL(38,10))"
NORM = r"""trim(regexp_replace(regexp_replace(lower({0}), '[!"#$%&''()*,/:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+', ' ', 'g'))"""
TR = """tr AS (SELECT u.conv_id, u.turn, u.text AS problem, a.text AS transcript FROM conversations u
  JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
CK = """ck AS (SELECT CAST(o_custkey % 3 AS INTEGER) AS seed, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS step,
  round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 6) AS pass1 FROM orders GROUP BY 1, 2)"""
WD = """w AS (SELECT coalesce(b.k, a.k) AS param_key, coalesce(b.m, a.m) AS module, b.d IS NOT DISTINCT FROM a.d AS identical FROM
  (SELECT p_partkey AS k, p_type AS m, md5(p_name || '|' || p_brand || '|' || p_size) AS d FROM part) b FULL JOIN
  (SELECT p_partkey AS k, p_type AS m, md5(p_name || '|' || p_brand || '|' || CASE WHEN p_partkey % 50 = 0 THEN 'edited' ELSE CAST(p_size AS VARCHAR) END) AS d
   FROM part WHERE p_partkey % 97 <> 3) a ON a.k = b.k)"""


def passk(n: str = "n", c: str = "c", k: str = "k") -> str:
    return f"""CASE WHEN {n} < {k} THEN NULL WHEN {n} - {c} < {k} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - list_reduce(
      list_transform(range(0, {k}), lambda i: ({n} - {c} - i)::DOUBLE / ({n} - i)), lambda a, b: a * b) END"""


def pairs_sql(ks: list[int], by: str = "") -> str:
    """CTE d: (by, seed, condition, problem_id, k, d)."""
    own = f"{by}, " if by else ""
    ki = ", ".join(map(str, ks))
    return f"""nr AS (SELECT {own}seed, condition, problem_id, count(*) AS n, count(*) FILTER (correct) AS c FROM s WHERE model = 'rl' GROUP BY ALL),
  nb AS (SELECT {own}condition, problem_id, count(*) AS n, count(*) FILTER (correct) AS c FROM s WHERE model = 'base' GROUP BY ALL),
  er AS (SELECT *, {passk()} AS p FROM nr, (SELECT unnest([{ki}]) AS k)), eb AS (SELECT *, {passk()} AS p FROM nb, (SELECT unnest([{ki}]) AS k)),
  d AS (SELECT {f"er.{by} AS {by}, " if by else ""}er.seed, er.condition, er.problem_id, er.k, er.p - eb.p AS d FROM er JOIN eb
        ON er.condition = eb.condition AND er.problem_id = eb.problem_id AND er.k = eb.k{f" AND er.{by} = eb.{by}" if by else ""})"""


WIDE = """wide AS (SELECT *, dt - dd AS did_d, dt - dp AS did FROM (SELECT seed, k, problem_id, max(d) FILTER (condition = 'T') AS dt,
    max(d) FILTER (condition = 'D') AS dd, max(d) FILTER (condition = 'E') AS dp FROM d GROUP BY 1, 2, 3))"""
BOOT = f"""idx AS (SELECT problem_id, row_number() OVER (ORDER BY problem_id) - 1 AS i FROM (SELECT DISTINCT problem_id FROM wide)),
  dr AS (SELECT b, i, count(*) AS w FROM (SELECT b, (('0x' || substr(md5(b || ':' || j), 1, 8))::BIGINT) % (SELECT count(*) FROM idx) AS i
         FROM range({REPLICATES}) t(b), range((SELECT count(*) FROM idx)) u(j)) GROUP BY 1, 2),
  long AS (UNPIVOT wide ON {", ".join(metrics.GAINS)} INTO NAME metric VALUE x),
  names AS (SELECT * FROM (SELECT DISTINCT seed, k, problem_id FROM wide), (SELECT unnest({metrics.GAINS}) AS metric)),
  own AS (SELECT * FROM names LEFT JOIN long USING (seed, k, problem_id, metric)),
  reps AS (SELECT seed, k, metric, b, sum(x * w) / nullif(sum(w) FILTER (x IS NOT NULL), 0) AS x FROM dr JOIN idx USING (i) JOIN own USING (problem_id) GROUP BY 1, 2, 3, 4),
  ci AS (SELECT seed, k, metric, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi, stddev_samp(x) AS se FROM reps GROUP BY 1, 2, 3),
  pt AS (SELECT seed, k, metric, avg(x) AS point, count(x) AS n FROM own GROUP BY 1, 2, 3)"""


def query(name: str, sql: str | None, *ctes: str):
    """Register a query with its SQL; None where SQL cannot express it (tests hold those
    against brute force)."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = (f"WITH {'RECURSIVE ' if any(c.startswith('st(') for c in ctes) else ''}{', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


#: Base models have no training seed; the results show -1 for it.
SHOWN = "coalesce(seed, -1)"


def r6(c: str):
    return F.round(c, 6).alias(c)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- sources and sinks ---------------------------------------------------------

def stored(t: Tables, rows: DataFrame, schema: str, name: str, kind: str = "parquet") -> str:
    """A file set in the shared folder with the rows in a schema's columns (others null)."""
    fields = StructType.fromDDL(schema)
    full = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
    path = f"{readers.shared_path(t.spark, name)}.{kind}"
    (full.write.option("header", True) if kind == "csv" else full.write).format(kind).save(path)
    return path


@query("src_text", "SELECT doc_id AS problem_id, CASE WHEN doc_id % 5 = 0 THEN 'eval' ELSE 'train' END AS split, text, CAST(n_chars AS DOUBLE) AS answer FROM documents")
def _(t):
    split = F.when(F.col("doc_id") % 5 == 0, "eval").otherwise("train")
    rows = t.documents.select(F.col("doc_id").alias("problem_id"), split.alias("split"), "text", F.col("n_chars").alias("answer"))
    loaded = readers.load_problems(t.spark, stored(t, rows, schemas.PROBLEMS, "problems"))
    return loaded.select("problem_id", "split", "text", F.col("answer").cast("double").alias("answer"))


@query("src_image", "SELECT doc_id AS problem_id, CAST(strlen(text) AS BIGINT) AS image_bytes, md5(text) AS image_md5 FROM documents")
def _(t):
    folder = readers.shared_path(t.spark, "pictures")
    rows = t.documents.select(F.col("doc_id").alias("problem_id"), F.concat(F.col("doc_id") % 16, F.lit("/p "), "doc_id", F.lit(".img")).alias("image_path"), F.encode("text", "UTF-8").alias("image"))
    images.write(rows, folder).count()
    loaded = readers.load_problems(t.spark, stored(t, rows.drop("image"), schemas.PROBLEMS, "problems"), images=folder)
    return loaded.select("problem_id", "image_bytes", F.md5("image").alias("image_md5"))


@query("src_math500", "SELECT p_partkey AS problem_id, p_name AS text, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS answer_text, p_partkey % 2 = 0 AS numeric_answer FROM part")
def _(t):
    answer = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    rows = t.part.select(F.col("p_partkey").alias("problem_id"), F.col("p_name").alias("text"), answer.alias("answer_text"))
    loaded = readers.load_problems(t.spark, stored(t, rows, schemas.PROBLEMS, "problems", "json"))
    return loaded.select("problem_id", "text", "answer_text", F.col("typed.number").isNotNull().alias("numeric_answer"))


@query("src_samples", "SELECT problem_id, model, condition, coalesce(seed, -1) AS seed, CAST(temperature AS DOUBLE) AS temperature, n_tokens, completion FROM s", S)
def _(t):
    folder = readers.shared_path(t.spark, "samples")
    kept = t.samples.withColumn("sample_idx", F.col("l_linenumber"))
    readers.write_samples(kept.select(*(f.name for f in StructType.fromDDL(schemas.SAMPLES))), folder)
    loaded = readers.load_samples(t.spark, folder)
    return loaded.select("problem_id", "model", "condition", F.coalesce("seed", F.lit(-1)).alias("seed"), F.col("temperature").cast("double").alias("temperature"), "n_tokens", "completion")


@query("src_transcripts", "SELECT conv_id AS problem_id, turn AS sample_idx, transcript FROM tr", TR)
def _(t):
    rows = t.transcripts.select(F.col("conv_id").alias("problem_id"), F.col("turn").alias("sample_idx"), "transcript")
    loaded = readers.load_transcriptions(t.spark, stored(t, rows, schemas.TRANSCRIPTIONS, "transcriptions", "json"))
    return loaded.select("problem_id", F.col("sample_idx").cast("long").alias("sample_idx"), "transcript")


@query("src_weights", "SELECT phase, count(*) AS n_params, count(DISTINCT digest) AS n_digests FROM (SELECT 'before' AS phase, md5(p_name || '|' || p_brand || '|' || p_size) AS digest FROM part UNION ALL SELECT 'after', md5(p_name || '|' || p_brand || '|' || CASE WHEN p_partkey % 50 = 0 THEN 'edited' ELSE CAST(p_size AS VARCHAR) END) FROM part WHERE p_partkey % 97 <> 3) GROUP BY phase")
def _(t):
    folder = readers.shared_path(t.spark, "state-dicts")
    data = lambda edited: F.encode(F.concat_ws("|", "p_name", "p_brand", F.when(edited, F.lit("edited")).otherwise(F.col("p_size").cast("string"))), "UTF-8")
    row = lambda edited: (F.pmod("p_partkey", F.lit(8)).alias("file"), F.concat_ws(".", "p_type", F.col("p_partkey").cast("string")).alias("param_key"), data(edited).alias("data"))
    tensors.write(t.part.select(*row(F.lit(False))), f"{folder}/before").count()
    tensors.write(t.part.where("p_partkey % 97 <> 3").select(*row(F.col("p_partkey") % 50 == 0)), f"{folder}/after").count()
    both = tensors.manifest(t.spark, f"{folder}/before", "before").unionByName(tensors.manifest(t.spark, f"{folder}/after", "after"))
    return both.groupBy("phase").agg(F.count("*").alias("n_params"), F.countDistinct("digest").alias("n_digests"))


@query("src_ckpt", "SELECT seed, step, pass1 FROM ck", CK)
def _(t):
    return readers.load_checkpoints(t.spark, stored(t, t.checkpoints, schemas.CHECKPOINTS, "checkpoints", "orc")).select("seed", "step", "pass1")


@query("src_config", "SELECT event_id AS run_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS INTEGER) AS n_settings FROM events")
def _(t):
    rows = t.events.select(F.col("event_id").cast("string").alias("run_id"), F.from_json("props", "map<string,string>").alias("settings"))
    loaded = readers.load_config(t.spark, stored(t, rows, schemas.CONFIG, "config", "json"))
    return loaded.select(F.col("run_id").cast("long").alias("run_id"), F.col("settings")["k"].alias("k"), F.size("settings").alias("n_settings"))


@query("src_reviews", "SELECT doc_id AS sample_id, CASE WHEN quality = 0 THEN 'spurious' ELSE 'sound' END AS verdict FROM labels")
def _(t):
    return readers.load_reviews(t.spark, stored(t, t.reviews, schemas.REVIEWS, "reviews", "csv")).select("sample_id", "verdict")


@query("snk_report", f"SELECT model, condition, k, round(avg(p), 6) AS pass_at_k, count(p) AS n_problems FROM (SELECT *, {passk()} AS p FROM nc, (SELECT unnest([1, 8]) AS k)) GROUP BY ALL", S, "nc AS (SELECT model, condition, problem_id, count(*) AS n, count(*) FILTER (correct) AS c FROM s GROUP BY ALL)")
def _(t):
    return readers.write_report(rounded(metrics.curve(t.samples, ["model", "condition"], SEED_KS), "pass_at_k"))


# -- scalars -------------------------------------------------------------------

ROW = "l_orderkey, l_linenumber, l_partkey"
_row = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("sc_extract", f"SELECT {ROW}, {EXTRACT} AS answer FROM s", S)
def _(t):
    return t.samples.select(*_row, sc.extract_answer(F.col("completion")).alias("answer"))


@query("sc_norm_num", f"SELECT {ROW}, CAST({NUMBER} AS DOUBLE) AS number FROM s", S)
def _(t):
    return t.samples.select(*_row, sc.normalize_number(sc.extract_answer(F.col("completion"))).cast("double").alias("number"))


@query("sc_match", f"SELECT model, condition, count(*) AS n, count(*) FILTER (coalesce({NUMBER} = truth, false)) AS matched FROM s GROUP BY 1, 2", S)
def _(t):
    match = sc.is_correct(sc.normalize_number(sc.extract_answer(F.col("completion"))), F.col("truth"))
    return t.samples.groupBy("model", "condition").agg(F.count("*").alias("n"), F.count_if(match).alias("matched"))


TYPED = "regexp_replace(regexp_replace({0}, '\\\\text\\{{([^{{}}]*)\\}}', '\\1'), '\\$|\\s+', '', 'g')"


@query("sc_match_typed", f"SELECT p_partkey AS problem_id, CASE WHEN p_partkey % 4 = 0 THEN {TYPED.format('p_brand')} = {TYPED.format('p_type')} ELSE true END AS matched FROM part")
def _(t):
    """Text answers and numbers, boxed, against the truth as it is written elsewhere."""
    kind = F.col("p_partkey") % 4
    said = F.when(kind == 0, F.concat(F.lit("so \\boxed{"), "p_brand", F.lit("}"))).when(kind == 1, F.concat(F.lit("\\boxed{ \\text{"), "p_type", F.lit("} }."))).when(kind == 2, F.concat(F.lit("#### "), F.col("p_size").cast("string"), F.lit(".00"))).otherwise(F.format_string("\\boxed{%,d}", F.col("p_partkey") * 1000))
    truth = F.when(kind.isin(0, 1), F.concat(F.lit("$"), "p_type", F.lit("$"))).when(kind == 2, F.col("p_size").cast("string")).otherwise((F.col("p_partkey") * 1000).cast("string"))
    return t.part.select(F.col("p_partkey").alias("problem_id"), sc.answers_match(sc.typed_answer(sc.extract_boxed(said)), sc.typed_answer(truth)).alias("matched"))


@query("sc_reward", f"SELECT {ROW}, CAST(correct AS INTEGER) AS reward FROM s", S)
def _(t):
    return t.samples.select(*_row, sc.reward(F.col("correct")).alias("reward"))


@query("sc_trunc", f"SELECT {ROW}, n_tokens >= 500 AND NOT answered AS truncated FROM s", S)
def _(t):
    answer = F.when(F.col("answered"), sc.extract_answer(F.col("completion")))
    return t.samples.select(*_row, sc.is_truncated(F.col("n_tokens"), answer).alias("truncated"))


@query("sc_norm_text", f"SELECT conv_id, turn, {NORM.format('problem')} AS normalized FROM tr", TR)
def _(t):
    return t.transcripts.select("conv_id", "turn", sc.normalize_text(F.col("problem")).alias("normalized"))


HEARD = "CASE WHEN turn % 4 = 0 THEN problem WHEN turn % 4 = 2 THEN '  ' || problem || '!' ELSE transcript END"


def _heard():
    turn = F.col("turn") % 4
    return F.when(turn == 0, F.col("problem")).when(turn == 2, F.concat(F.lit("  "), "problem", F.lit("!"))).otherwise(F.col("transcript"))


@query("sc_trans_match", f"SELECT conv_id, turn, {HEARD} = problem AS exact, {NORM.format('(' + HEARD + ')')} = {NORM.format('problem')} AS normalized FROM tr", TR)
def _(t):
    exact, normalized = sc.transcription_match(_heard(), F.col("problem"))
    return t.transcripts.select("conv_id", "turn", exact.alias("exact"), normalized.alias("normalized"))


NC = "nc AS (SELECT model, seed, condition, problem_id, count(*) AS n, count(*) FILTER (correct) AS c FROM s GROUP BY ALL)"
POOL = "nc AS (SELECT model, condition, problem_id, count(*) AS n, count(*) FILTER (correct) AS c FROM s GROUP BY ALL)"


@query("sc_pass1", "SELECT model, condition, problem_id, round(c / n, 6) AS pass1 FROM nc", S, POOL)
def _(t):
    cells = metrics.count_correct(t.samples, ["model", "condition", "problem_id"])
    return cells.select("model", "condition", "problem_id", F.round(F.try_divide("c", "n"), 6).alias("pass1"))


@query("sc_passk", f"SELECT model, condition, problem_id, k, round({passk()}, 6) AS pass_at_k FROM nc, (SELECT unnest({KS}) AS k)", S, POOL)
def _(t):
    e = metrics.estimates(metrics.count_correct(t.samples, ["model", "condition", "problem_id"]), KS)
    return e.select("model", "condition", "problem_id", "k", F.round("p", 6).alias("pass_at_k"))


D1 = pairs_sql([1])
DK = pairs_sql(SEED_KS)
DELTAS = "SELECT seed, condition, k, round(avg(d), 6) AS delta, count(d) AS n_problems FROM d {} GROUP BY 1, 2, 3"


@query("sc_survive", "SELECT seed, round(avg(dp) / nullif(avg(dt), 0), 4) AS survival FROM wide GROUP BY seed", S, D1, WIDE)
def _(t):
    wide = metrics.problem_pivot(t.chosen(conditions="TE"), [1])
    return wide.groupBy("seed").agg(F.round(sc.survival_ratio(F.avg("dp"), F.avg("dt")), 4).alias("survival"))


CI_SQL = "SELECT seed, k, metric, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, round(se, 6) AS se, n FROM ci JOIN pt USING (seed, k, metric)"
OUTCOME = """SELECT seed, CASE WHEN NOT tl > 0 THEN 'no_reference_gain' WHEN ph < 0 THEN 'D' WHEN pl > 0 AND dl > 0 THEN 'C' WHEN pl > 0 AND dh < 0 THEN 'exceeds'
  WHEN pl > 0 THEN 'B' WHEN dl > 0 THEN 'A' ELSE 'noise' END AS outcome FROM (SELECT seed, max(lo) FILTER (metric = 'dt') AS tl, max(lo) FILTER (metric = 'dp') AS pl,
  max(hi) FILTER (metric = 'dp') AS ph, max(lo) FILTER (metric = 'did') AS dl, max(hi) FILTER (metric = 'did') AS dh FROM ci GROUP BY seed)"""


@query("sc_outcome", OUTCOME, S, D1, WIDE, BOOT)
def _(t):
    return gates.outcomes(metrics.problem_pivot(t.chosen(conditions="TE"), [1]), REPLICATES).select("seed", "outcome")


@query("sc_calib", "SELECT condition, round(avg(c / n), 6) AS base_pass1, avg(c / n) BETWEEN 0.01 AND 0.99 AS calibrated FROM nc WHERE model = 'base' GROUP BY 1", S, POOL)
def _(t):
    base = metrics.count_correct(t.chosen("base"), ["condition", "problem_id"])
    p = F.avg(F.col("c") / F.col("n"))
    return base.groupBy("condition").agg(F.round(p, 6).alias("base_pass1"), sc.calibration_ok(p).alias("calibrated"))


@query("sc_cost", "SELECT p_brand AS platform, round(min(p_size) * min(p_retailprice), 4) AS cost_low, round(max(p_size) * max(p_retailprice), 4) AS cost_high FROM part GROUP BY 1")
def _(t):
    low, high = sc.cost((F.min("p_size"), F.max("p_size")), (F.min("p_retailprice"), F.max("p_retailprice")))
    return t.part.groupBy(F.col("p_brand").alias("platform")).agg(F.round(low, 4).alias("cost_low"), F.round(high, 4).alias("cost_high"))


# -- joins ---------------------------------------------------------------------

@query("j_truth", f"SELECT s_nationkey AS split, count(*) AS n, count(*) FILTER (coalesce({NUMBER} = truth, false)) AS correct FROM s JOIN supplier ON problem_id = s_suppkey GROUP BY 1", S)
def _(t):
    problems = t.supplier.select(F.col("s_suppkey").alias("problem_id"), F.col("s_nationkey").alias("split"))
    scored = metrics.join_truth(t.samples.drop("correct"), problems)
    return scored.groupBy("split").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


@query("j_pair_modality", "SELECT model, problem_id, round(avg(correct::INT) FILTER (condition = 'T'), 6) AS text_rate, round(avg(correct::INT) FILTER (condition = 'E'), 6) AS image_rate FROM s WHERE condition IN ('T', 'E') GROUP BY 1, 2", S)
def _(t):
    return rounded(controls.paired_rates(t.chosen(conditions="TE"), "T", "E", ["model", "problem_id"], ("text_rate", "image_rate")), "text_rate", "image_rate")


@query("j_pair_model", "SELECT seed, condition, problem_id, round(d, 6) AS d FROM d", S, D1)
def _(t):
    return metrics.model_pairs(t.samples, [1]).select("seed", "condition", "problem_id", r6("d"))


@query("j_transcript", "SELECT conv_id, turn, problem, transcript FROM tr", TR)
def _(t):
    return t.transcripts


PB = "pb AS (SELECT model, problem_id, avg((l_partkey % 2 = 0)::INT) > 0.5 AS perceived FROM s WHERE condition = 'D' GROUP BY 1, 2)"


@query("j_perception", "SELECT s.model, condition, coalesce(perceived, false) AS perceived, count(*) AS n, count(*) FILTER (correct) AS c FROM s LEFT JOIN pb ON s.model = pb.model AND s.problem_id = pb.problem_id WHERE condition <> 'D' GROUP BY ALL", S, PB)
def _(t):
    buckets = controls.perception_buckets(t.transcribed)
    joined = t.chosen(conditions="TE").join(buckets, ["model", "problem_id"], "left")
    return metrics.count_correct(joined.withColumn("perceived", F.coalesce("perceived", F.lit(False))), ["model", "condition", "perceived"])


@query("j_weights", "SELECT * FROM w WHERE NOT identical", WD)
def _(t):
    return controls.weight_diff(t.weights).where("NOT identical")


LK = """grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: list_aggregate(w[i:i+7], 'string_agg', ' '))) AS g FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 8),
  own AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 6), lambda i: list_aggregate(w[i:i+7], 'string_agg', ' '))) AS g FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 8),
  lk AS (SELECT DISTINCT item_id FROM own WHERE g IN (SELECT g FROM grams) UNION SELECT item_id FROM benchmark WHERE trim(lower(text)) IN (SELECT trim(lower(text)) FROM documents))"""


@query("j_leak", "SELECT item_id FROM lk", LK)
def _(t):
    return leaks.leaked(t.benchmark, t.documents)


NUM = "num AS (SELECT *, row_number() OVER (PARTITION BY model, condition, problem_id ORDER BY l_orderkey, l_linenumber, l_partkey, n_tokens, temperature, correct) - 1 AS sample_idx FROM s)"
DM = "dm AS (SELECT problem_id, avg(correct::INT) FILTER (condition = 'T') AS t, avg(correct::INT) FILTER (condition = 'E') AS e FROM num WHERE model = 'base' AND sample_idx % 2 = 0 GROUP BY 1 HAVING abs(t - e) <= 0.05)"


@query("j_difficulty", "SELECT problem_id, round(t, 6) AS t, round(e, 6) AS e FROM dm", S, NUM, DM)
def _(t):
    return controls.difficulty_matched(controls.numbered(t.chosen("base", "TE"))).select("problem_id", r6("t"), r6("e"))


HALF = "half AS (SELECT problem_id, avg(correct::INT) FILTER (condition = 'T') AS t, avg(correct::INT) FILTER (condition = 'E') AS e FROM num WHERE model = 'base' AND sample_idx % 2 = 0 GROUP BY 1)"


@query("j_difficulty_pairs", """SELECT lo.problem_id AS left_id, hi.problem_id AS right_id, round(t, 6) AS left_score, round(e, 6) AS right_score FROM st JOIN lo USING (i) JOIN hi USING (j) WHERE abs(t - e) <= 0.05""", S, NUM, HALF,
  "lo AS (SELECT problem_id, t, row_number() OVER (ORDER BY t, problem_id) AS i FROM half WHERE t IS NOT NULL)", "hi AS (SELECT problem_id, e, row_number() OVER (ORDER BY e, problem_id) AS j FROM half WHERE e IS NOT NULL)",
  """st(i, j) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT st.i + CASE WHEN t - e > 0.05 THEN 0 ELSE 1 END, st.j + CASE WHEN e - t > 0.05 THEN 0 ELSE 1 END FROM st JOIN lo USING (i) JOIN hi USING (j))""")
def _(t):
    """Text problems matched 1:1 to image problems of like difficulty for the base model."""
    half = controls.half_rates(controls.numbered(t.chosen("base", "TE")))
    pairs = matching.caliper_pairs(half.select(F.col("problem_id").alias("id"), F.col("t").alias("score")), half.select(F.col("problem_id").alias("id"), F.col("e").alias("score")), 0.05)
    return pairs.select("left_id", "right_id", r6("left_score"), r6("right_score"))


@query("j_paraphrase", "SELECT a.problem_id, round(a.r, 6) AS original, round(b.r, 6) AS paraphrase FROM (SELECT problem_id, avg(correct::INT) AS r FROM s WHERE condition = 'T' GROUP BY 1) a JOIN (SELECT problem_id, avg(correct::INT) AS r FROM s WHERE condition = 'D' GROUP BY 1) b USING (problem_id)", S)
def _(t):
    both = controls.paired_rates(t.chosen(conditions="TD"), "T", "D", ["problem_id"], ("original", "paraphrase"))
    return rounded(both.dropna(), "original", "paraphrase")


@query("j_reviews", "SELECT doc_id AS sample_id, lang AS condition, verdict FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN 'spurious' ELSE 'sound' END AS verdict FROM labels) USING (doc_id)")
def _(t):
    return t.correct_traces.join(t.reviews, "sample_id", "left").select("sample_id", "condition", "verdict")


DF_ = pairs_sql([1], "model_family")
FAMILY = "fam AS (SELECT model_family, seed, condition, k, avg(d) AS delta FROM d GROUP BY ALL)"


@query("j_cross_model", "SELECT a.seed, a.condition, a.k, round(a.delta, 6) AS delta_3b, round(b.delta, 6) AS delta_7b, round(c.delta, 6) AS delta_2b FROM fam a JOIN fam b USING (seed, condition, k) JOIN fam c USING (seed, condition, k) WHERE a.model_family = '3B' AND b.model_family = '7B' AND c.model_family = '2B'", S, DF_, FAMILY)
def _(t):
    d = rounded(metrics.deltas(t.samples, [1], ["model_family"]), "delta")
    return d.groupBy("seed", "condition", "k").pivot("model_family", ["3B", "7B", "2B"]).agg(F.first("delta")).withColumnsRenamed({"3B": "delta_3b", "7B": "delta_7b", "2B": "delta_2b"})


@query("j_boot", "SELECT seed, k, b, metric, round(x, 6) AS x FROM reps WHERE x IS NOT NULL", S, DK, WIDE, BOOT)
def _(t):
    reps = stats.replicate_means(metrics.problem_pivot(t.samples, SEED_KS), metrics.GAINS, REPLICATES)
    return rounded(reps.withColumn("b", F.col("b").cast("long")).unpivot(["seed", "k", "b"], metrics.GAINS, "metric", "x").where("x IS NOT NULL"), "x")


# -- aggregations --------------------------------------------------------------

@query("ag_nc", "SELECT model_family, model, coalesce(seed, -1) AS seed, condition, CAST(temperature AS DOUBLE) AS temperature, problem_id, count(*) AS n, count(*) FILTER (correct) AS c FROM s GROUP BY ALL", S)
def _(t):
    return metrics.count_correct(t.samples, ["model_family", "model", "seed", "condition", "temperature", "problem_id"]).withColumn("temperature", F.col("temperature").cast("double")).withColumn("seed", F.expr(SHOWN))


@query("ag_passk", f"SELECT model, coalesce(seed, -1) AS seed, condition, k, round(avg(p), 6) AS pass_at_k, count(p) AS n_problems FROM (SELECT *, {passk()} AS p FROM nc, (SELECT unnest({SEED_KS}) AS k)) GROUP BY ALL", S, NC)
def _(t):
    return rounded(metrics.curve(t.samples, ["model", "seed", "condition"], SEED_KS), "pass_at_k").withColumn("seed", F.expr(SHOWN))


@query("ag_curve", f"SELECT model, condition, k, round(avg(p), 6) AS pass_at_k, count(p) AS n_problems FROM (SELECT *, {passk()} AS p FROM nc, (SELECT unnest({KS}) AS k)) GROUP BY ALL", S, POOL)
def _(t):
    return rounded(metrics.curve(t.samples, ["model", "condition"], KS), "pass_at_k")


@query("ag_delta_text", DELTAS.format("WHERE condition = 'T'"), S, D1)
def _(t):
    return rounded(metrics.deltas(t.chosen(conditions="T"), [1]), "delta")


@query("ag_delta_pixel", DELTAS.format("WHERE condition IN ('D', 'E')"), S, D1)
def _(t):
    return rounded(metrics.deltas(t.chosen(conditions="DE"), [1]), "delta")


@query("ag_delta_k", DELTAS.format(""), S, DK)
def _(t):
    return rounded(metrics.deltas(t.samples, SEED_KS), "delta")


@query("ag_did", "SELECT seed, round(avg(did), 6) AS did, count(did) AS n_problems FROM wide GROUP BY 1", S, D1, WIDE)
def _(t):
    return metrics.problem_pivot(t.chosen(conditions="TE"), [1]).groupBy("seed").agg(F.round(F.avg("did"), 6).alias("did"), F.count("did").alias("n_problems"))


def gap_sql(a: str, b: str) -> str:
    return f"""SELECT model, coalesce(seed, -1) AS seed, k, round(avg(pa - pb), 6) AS gap, count(pa - pb) AS n_problems FROM (SELECT *, {passk('na', 'ca')} AS pa, {passk('nb', 'cb')} AS pb FROM (
      SELECT model, seed, problem_id, count(*) FILTER (condition = '{a}') AS na, count(*) FILTER (condition = '{a}' AND correct) AS ca,
      count(*) FILTER (condition = '{b}') AS nb, count(*) FILTER (condition = '{b}' AND correct) AS cb FROM s WHERE condition IN ('{a}', '{b}') GROUP BY ALL), (SELECT unnest({SEED_KS}) AS k)) GROUP BY 1, 2, 3"""


for _name, _a, _b in (("ag_gap_td", "T", "D"), ("ag_gap_de", "D", "E"), ("ag_percep_tax", "T", "E")):
    query(_name, gap_sql(_a, _b), S)(lambda t, a=_a, b=_b: rounded(metrics.condition_gap(t.chosen(conditions=a + b), a, b, SEED_KS), "gap").withColumn("seed", F.expr(SHOWN)))


@query("ag_drl3", "SELECT seed, max(delta) FILTER (condition = 'T') AS delta_t, max(delta) FILTER (condition = 'D') AS delta_d, max(delta) FILTER (condition = 'E') AS delta_e FROM (SELECT seed, condition, round(avg(d), 6) AS delta FROM d GROUP BY 1, 2) GROUP BY 1", S, D1)
def _(t):
    d = rounded(metrics.deltas(t.samples, [1]), "delta")
    return d.groupBy("seed").agg(*(F.max(F.when(F.col("condition") == c, F.col("delta"))).alias(f"delta_{c.lower()}") for c in "TDE"))


@query("ag_seed", "SELECT condition, k, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, round(min(delta), 6) AS lo, round(max(delta), 6) AS hi, count(delta) AS n_seeds FROM (SELECT seed, condition, k, avg(d) AS delta FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2", S, DK)
def _(t):
    return rounded(stats.across_seeds(metrics.deltas(t.samples, SEED_KS), "delta", ["condition", "k"]), "mean", "sd", "lo", "hi")


CI_KS = [1, 8, 64]
DC = pairs_sql(CI_KS)


@query("ag_ci", CI_SQL, S, DC, WIDE, BOOT)
def _(t):
    ci = stats.intervals(metrics.problem_pivot(t.samples, CI_KS), metrics.GAINS, REPLICATES)
    return ci.select("seed", "k", "metric", r6("point"), r6("lo"), r6("hi"), r6("se"), "n")


@query("ag_bayes", """SELECT seed, condition, round(m, 6) AS point, round(m - 1.959963984540054 * sqrt(v) / n, 6) AS lo, round(m + 1.959963984540054 * sqrt(v) / n, 6) AS hi, n FROM (
  SELECT r.seed, condition, avg((r.c + 1) / (r.n + 2) - (b.c + 1) / (b.n + 2)) AS m, count(*) AS n,
         sum((r.c + 1) * (r.n - r.c + 1) / ((r.n + 2)::DOUBLE * (r.n + 2) * (r.n + 3)) + (b.c + 1) * (b.n - b.c + 1) / ((b.n + 2)::DOUBLE * (b.n + 2) * (b.n + 3))) AS v
  FROM (SELECT * FROM nc WHERE model = 'rl') r JOIN (SELECT condition, problem_id, sum(n) AS n, sum(c) AS c FROM nc WHERE model = 'base' GROUP BY 1, 2) b USING (condition, problem_id) GROUP BY 1, 2)""", S, NC)
def _(t):
    return rounded(stats.bayes_intervals(t.samples), "point", "lo", "hi")


@query("ag_bayes_exact", None)
def _(t):
    return rounded(posterior.exact_intervals(t.samples), "point", "lo", "hi")


@query("ag_equiv", "SELECT seed, k, metric, lo <= 0 AND hi >= 0 AS contains_zero, lo >= -0.02 AND hi <= 0.02 AS inside_margin FROM ci WHERE metric IN ('dt', 'dd', 'dp')", S, DC, WIDE, BOOT)
def _(t):
    return gates.equivalence(metrics.problem_pivot(t.samples, CI_KS), REPLICATES)


D8 = pairs_sql([8])


@query("ag_sharpen_gate", "SELECT seed, k, 'sharpening' AS gate, round(greatest(abs(lo), abs(hi)), 6) AS value, 0.02::DOUBLE AS threshold, lo >= -0.02 AND hi <= 0.02 AS passed FROM ci WHERE metric = 'dt'", S, D8, WIDE, BOOT)
def _(t):
    return rounded(gates.sharpening(metrics.problem_pivot(t.chosen(conditions="T"), [8]), REPLICATES), "value")


LARGE = [64, 256, 512]


@query("ag_extrapolate", f"""SELECT model, condition, k, round(CASE WHEN size IS NULL THEN 1 - pow(1 - m, k) ELSE 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, k), lambda i: ((1 - m) * size + i) / (size + i))), lambda a, b: a * b) END, 6) AS pass_at_k, n_problems FROM (
  SELECT *, CASE WHEN rho > 1e-9 THEN 1 / rho - 1 END AS size FROM (SELECT *, (v / nullif(m * (1 - m), 0) - w) / nullif(1 - w, 0) AS rho FROM (
    SELECT model, condition, avg(c / n) AS m, var_pop(c / n) AS v, avg(1 / n) AS w, count(*) AS n_problems FROM nc GROUP BY 1, 2))), (SELECT unnest({LARGE}) AS k)""", S, POOL)
def _(t):
    cells = metrics.count_correct(t.samples, ["model", "condition", "problem_id"])
    return rounded(metrics.extrapolate(cells, ["model", "condition"], LARGE), "pass_at_k")


@query("ag_extrapolate_ml", None)
def _(t):
    by = ["model", "condition"]
    return rounded(posterior.predicted(posterior.fitted(metrics.count_correct(t.samples, [*by, "problem_id"]), by), by, LARGE), "pass_at_k")


@query("ag_extrapolate_check", None)
def _(t):
    """pass@64 predicted from 16 samples a problem, against all samples."""
    return rounded(posterior.extrapolation_check(controls.numbered(t.samples), ["model", "condition"], 16, 64), "predicted", "observed", "error")


TRUNC = "round(avg((n_tokens >= 500 AND NOT answered)::INT), 6) AS truncated, round(avg((n_tokens >= 500)::INT), 6) AS at_cap, count(*) AS n"


@query("ag_trunc", f"SELECT model, condition, {TRUNC} FROM s GROUP BY 1, 2", S)
def _(t):
    return rounded(controls.truncation_rates(t.samples, ["model", "condition"]), "truncated", "at_cap")


@query("ag_trunc_asym", "SELECT condition, round(rl - base, 6) AS difference, round(sqrt(rl * (1 - rl) / nr + base * (1 - base) / nb), 6) AS se, (rl - base) - 1.96 * sqrt(rl * (1 - rl) / nr + base * (1 - base) / nb) > 0 AS raise_cap FROM (SELECT condition, avg(x) FILTER (model = 'rl') AS rl, avg(x) FILTER (model = 'base') AS base, count(*) FILTER (model = 'rl') AS nr, count(*) FILTER (model = 'base') AS nb FROM (SELECT *, (n_tokens >= 500)::INT AS x FROM s) GROUP BY 1)", S)
def _(t):
    return rounded(gates.truncation_asymmetry(t.samples), "difference", "se")


@query("ag_length", "SELECT model, correct, round(avg(n_tokens), 6) AS mean, round(quantile_cont(n_tokens, 0.5), 6) AS median, round(quantile_cont(n_tokens, 0.95), 6) AS p95, count(*) AS n FROM s GROUP BY 1, 2", S)
def _(t):
    return rounded(controls.lengths(t.samples, ["model", "correct"]), "mean", "median", "p95")


@query("ag_phrase", "SELECT role, round(avg((contains(lower(text), 'the'))::INT), 6) AS phrase_rate, round(avg((length(trim(text)) < 20)::INT), 6) AS near_empty, count(*) AS n FROM conversations GROUP BY 1")
def _(t):
    return rounded(gates.phrase_rates(t.conversations, "the", ["role"]), "phrase_rate", "near_empty")


@query("ag_trans_acc", f"SELECT turn % 4 AS grp, round(avg(({HEARD} = problem)::INT), 6) AS exact, round(avg(({NORM.format('(' + HEARD + ')')} = {NORM.format('problem')})::INT), 6) AS normalized, count(*) AS n FROM tr GROUP BY 1", TR)
def _(t):
    heard = t.transcripts.select("problem", _heard().alias("heard"), (F.col("turn") % 4).alias("grp"))
    return rounded(controls.transcription_accuracy(heard, ["grp"]), "exact", "normalized")


@query("ag_percep", "SELECT seed, condition, perceived, round(avg(d), 6) AS delta, count(d) AS n_problems FROM d JOIN (SELECT problem_id, perceived FROM pb WHERE model = 'rl') USING (problem_id) GROUP BY 1, 2, 3", S, D1, PB)
def _(t):
    buckets = controls.perception_buckets(t.transcribed).where("model = 'rl'").select("problem_id", "perceived")
    d = metrics.model_pairs(t.samples, [1]).join(buckets, "problem_id")
    return d.groupBy("seed", "condition", "perceived").agg(F.round(F.avg("d"), 6).alias("delta"), F.count("d").alias("n_problems"))


@query("ag_difficulty", DELTAS.format("WHERE condition = 'T' AND problem_id IN (SELECT problem_id FROM dm)"), S.replace("s AS (", "s0 AS ("), "s1 AS (SELECT *, row_number() OVER (PARTITION BY model, condition, problem_id ORDER BY l_orderkey, l_linenumber, l_partkey, n_tokens, temperature, correct) - 1 AS sample_idx FROM s0)", DM.replace("FROM num", "FROM s1"), "s AS (SELECT * FROM s1 WHERE model = 'rl' OR sample_idx % 2 = 1)", D1)
def _(t):
    base = controls.numbered(t.chosen("base", "TE"))
    odd = base.where("condition = 'T' AND sample_idx % 2 = 1").drop("sample_idx").unionByName(t.chosen("rl", "T"))
    return rounded(metrics.deltas(odd.join(controls.difficulty_matched(base).select("problem_id"), "problem_id", "left_semi"), [1]), "delta")


@query("ag_paraphrase", DELTAS.format("WHERE condition IN ('P', 'T')"), S.replace("WHEN 'N' THEN 'D'", "WHEN 'N' THEN 'P'"), D1)
def _(t):
    p = t.chosen(conditions="TD").withColumn("condition", F.when(F.col("condition") == "D", "P").otherwise(F.col("condition")))
    return rounded(metrics.deltas(p, [1]), "delta")


@query("ag_spurious", "SELECT lang AS condition, round(avg((quality = 0)::INT), 6) AS spurious, count(*) AS n_reviewed FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    return rounded(controls.spurious_rates(t.correct_traces, t.reviews, ["condition"]), "spurious")


@query("ag_headroom", f"SELECT model_family, round(p16 - p1, 6) AS headroom, round(p16, 6) AS pass16, p16 - p1 > 0.05 AND p16 > 0.02 AS passed FROM (SELECT model_family, avg({passk(k='1')}) AS p1, avg({passk(k='16')}) AS p16 FROM (SELECT model_family, problem_id, count(*) AS n, count(*) FILTER (correct) AS c FROM s WHERE model = 'base' GROUP BY ALL) GROUP BY 1)", S)
def _(t):
    return rounded(gates.headroom(t.chosen("base")), "headroom", "pass16")


@query("ag_manip", "SELECT module, bool_and(identical) AS frozen, count(*) FILTER (NOT identical) AS n_changed, count(*) AS n_params FROM w GROUP BY 1", WD)
def _(t):
    return controls.weight_diff(t.weights).groupBy("module").agg(F.bool_and("identical").alias("frozen"), F.count_if(~F.col("identical")).alias("n_changed"), F.count("*").alias("n_params"))


@query("ag_throughput", "SELECT event_type AS run, round(count(*) / nullif(sum(value), 0), 6) AS per_second FROM events GROUP BY 1")
def _(t):
    return rounded(controls.throughput(t.events.withColumnRenamed("event_type", "run"), ["run"], "value"), "per_second")


@query("ag_agree", "SELECT condition, count(DISTINCT sign(round(delta, 9))) = 1 AS agree FROM (SELECT model_family, condition, avg(delta) AS delta FROM fam GROUP BY 1, 2) GROUP BY 1", S, DF_, FAMILY)
def _(t):
    d = metrics.deltas(t.samples, [1], ["model_family"]).groupBy("model_family", "condition").agg(F.avg("delta").alias("delta"))
    return metrics.agreement(d, "delta", ["condition"])


# -- windows, limits, sets -------------------------------------------------------

RO = "ro AS (SELECT l_suppkey AS problem_id, l_linenumber AS step, l_orderkey AS attempt, l_partkey, (l_discount >= 0.1)::INT::DOUBLE AS reward FROM lineitem)"


@query("w_adv_grpo", "SELECT problem_id, step, attempt, l_partkey, round((reward - avg(reward) OVER g) / nullif(stddev_pop(reward) OVER g, 0), 6) AS advantage FROM ro WINDOW g AS (PARTITION BY step, problem_id)", RO)
def _(t):
    return training.group_advantage(t.rollouts, ["step", "problem_id"]).select("problem_id", "step", "attempt", "l_partkey", r6("advantage"))


@query("w_adv_drgrpo", "SELECT problem_id, step, attempt, l_partkey, round(reward - avg(reward) OVER (PARTITION BY step, problem_id), 6) AS advantage FROM ro", RO)
def _(t):
    return training.group_advantage(t.rollouts, ["step", "problem_id"], by_std=False).select("problem_id", "step", "attempt", "l_partkey", r6("advantage"))


@query("w_plateau", "SELECT seed, step, pass1, flat = 1 AS flat, min(flat) OVER m = 1 AND count(*) OVER m = 2 AS stop FROM (SELECT *, coalesce((abs(pass1 - lag(pass1) OVER (PARTITION BY seed ORDER BY step)) < 0.01)::INT, 0) AS flat FROM ck) WINDOW m AS (PARTITION BY seed ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", CK)
def _(t):
    return training.plateau(t.checkpoints).select("seed", "step", "pass1", (F.col("flat") == 1).alias("flat"), "stop")


BT = f"""half AS (SELECT model, temperature, problem_id, sample_idx % 2 AS half, count(*) AS n, count(*) FILTER (correct) AS c FROM num GROUP BY ALL),
  rates AS (SELECT model, temperature, half, k, round(avg(p), 9) AS rate FROM (SELECT *, {passk()} AS p FROM half, (SELECT unnest([1, 4]) AS k)) GROUP BY ALL HAVING avg(p) IS NOT NULL),
  best AS (SELECT model, k, temperature FROM (SELECT *, row_number() OVER (PARTITION BY model, k ORDER BY rate DESC, temperature) AS r FROM rates WHERE half = 0) WHERE r = 1)"""


@query("w_best_temp", "SELECT model, k, CAST(temperature AS DOUBLE) AS temperature, round(rate, 6) AS rate FROM rates JOIN best USING (model, k, temperature) WHERE half = 1", S, NUM, BT)
def _(t):
    return rounded(training.best_temperature(controls.numbered(t.samples), [1, 4]).withColumn("temperature", F.col("temperature").cast("double")), "rate")


@query("w_strat_sample", "SELECT sample_id, condition FROM (SELECT doc_id AS sample_id, lang AS condition, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) AS r FROM documents) WHERE r <= 10")
def _(t):
    return training.stratified_sample(t.correct_traces.select("sample_id", "condition"), ["condition"], 10, F.col("sample_id").cast("string"))


@query("l_subset", "SELECT s_suppkey AS problem_id FROM supplier ORDER BY md5(CAST(s_suppkey AS VARCHAR)), s_suppkey LIMIT 40")
def _(t):
    return training.subset(t.supplier.select(F.col("s_suppkey").alias("problem_id")), "problem_id", 40)


@query("l_order_ckpt", "SELECT seed, step, pass1, row_number() OVER (PARTITION BY seed ORDER BY step) AS position FROM ck ORDER BY seed, step", CK)
def _(t):
    return training.ordered_checkpoints(t.checkpoints)


@query("u_conditions", "SELECT condition, count(*) AS n, count(*) FILTER (correct) AS c FROM s GROUP BY 1", S)
def _(t):
    parts = [t.chosen(conditions=c) for c in "TDE"]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return metrics.count_correct(union, ["condition"])


@query("e_clean", "SELECT item_id, text FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM lk)", LK)
def _(t):
    return t.benchmark.select("item_id", "text").join(leaks.leaked(t.benchmark, t.documents), "item_id", "left_anti")


def _figures(name: str, sql: str, columns: str) -> str:
    key = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in report.KEYS[name]) + ")"
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, {key} AS row_key, '{c}' AS figure, CAST({c} AS DOUBLE) AS value FROM ({sql})" for c in columns.split())


_with = lambda sql, *ctes: f"WITH {', '.join(ctes)} {sql}"
_curve = f"SELECT model, condition, k, round(avg(p), 6) AS pass_at_k, count(p) AS n_problems FROM (SELECT *, {passk()} AS p FROM nc, (SELECT unnest({CI_KS}) AS k)) GROUP BY ALL"
_seed = "SELECT condition, k, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, round(min(delta), 6) AS lo, round(max(delta), 6) AS hi, count(delta) AS n_seeds FROM (SELECT seed, condition, k, avg(d) AS delta FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2"
REPORT = " UNION ALL ".join((
    _figures("text_gain", SQL["ag_delta_text"], "delta n_problems"), _figures("pixel_gain", SQL["ag_delta_pixel"], "delta n_problems"),
    _figures("curves", _with(_curve, S, POOL), "pass_at_k n_problems"), _figures("intervals", SQL["ag_ci"], "point lo hi se n"),
    _figures("seeds", _with(_seed, S, DC), "mean sd lo hi n_seeds"), _figures("truncation", SQL["ag_trunc"], "truncated at_cap n"),
    _figures("families", _with("SELECT model_family, seed, condition, k, round(avg(d), 6) AS delta, count(d) AS n_problems FROM d GROUP BY ALL", S, DF_), "delta n_problems"),
    _figures("transcription", SQL["ag_trans_acc"], "exact normalized n"), _figures("weights", SQL["ag_manip"], "frozen n_changed n_params"),
    _figures("perception", SQL["ag_percep"], "delta n_problems"), _figures("spurious", SQL["ag_spurious"], "spurious n_reviewed"),
))


@query("report_tables", REPORT)
def _(t):
    """All result tables, written, listed and read back."""
    counts, path = readers.staged_at(report.cells(t.chosen().withColumn("match", F.col("l_partkey") % 2 == 0)), "cells")
    heard = t.transcripts.select("problem", _heard().alias("heard"), (F.col("turn") % 4).alias("grp"))
    made = report.tables(counts, heard, t.weights, t.correct_traces, t.reviews, True, tuple(CI_KS), REPLICATES)
    folder = readers.shared_path(t.spark, "report")
    report.write(made, folder)
    readers.delete(t.spark, path)
    return rounded(report.figures(report.read(t.spark, folder)), "value")


@query("gate_report", f"""SELECT 'calibration' AS gate, round(avg(c / n), 6) AS value, 0.01::DOUBLE AS threshold, avg(c / n) BETWEEN 0.01 AND 0.99 AS passed, count(*) AS evidence_n FROM nc WHERE model = 'base'
  UNION ALL SELECT 'truncation', round(avg((n_tokens >= 500 AND NOT answered)::INT), 6), 0.05, avg((n_tokens >= 500 AND NOT answered)::INT) < 0.05, count(*) FROM s
  UNION ALL SELECT 'manipulation', count(*) FILTER (NOT identical), 0, bool_and(identical), count(*) FROM w""", S, POOL, WD)
def _(t):
    return rounded(gates.report(t.samples, controls.weight_diff(t.weights), t.chosen("base")), "value")
