"""The reference relations over the test tables, in Spark and as DuckDB views.

Each relation has a function that makes it from a table folder and a
common table expression in SQL with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from currikit.sources.shared import spread


SOURCES = {"view": "local_easy", "click": "local_medium", "purchase": "local_hard", "signup": "public_easy", "error": "public_medium"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of seven clients from five sources, with two margins."""
    e = table(spark, sf_dir, "events")
    source = F.element_at(F.create_map(*(F.lit(x) for kv in SOURCES.items() for x in kv)), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_id").alias("row_id"),
        (F.col("user_id") % 7).alias("client_id"),
        source.alias("source"),
        ((F.col("value") - 50) / 100).alias("client_margin"),
        ((k - 50) / 100).alias("reward_gap"),
        (F.col("user_id") % 5 == 0).alias("client_truncated"),
        F.when(F.col("event_id") % 11 == 0, F.lit(False)).when(F.col("event_id") % 11 == 1, F.lit(True)).alias("client_margin_valid"),
        F.concat(F.lit("q"), (F.col("user_id") % 40).cast("string"), F.lit("."), k.cast("int").cast("string")).alias("query"),
    )


SCORED = """px_scored AS (SELECT event_id AS row_id, user_id % 7 AS client_id,
  CASE event_type WHEN 'view' THEN 'local_easy' WHEN 'click' THEN 'local_medium' WHEN 'purchase' THEN 'local_hard' WHEN 'signup' THEN 'public_easy' WHEN 'error' THEN 'public_medium' END AS source,
  (value - 50) / 100 AS client_margin, (CAST(props->>'$.k' AS DOUBLE) - 50) / 100 AS reward_gap, user_id % 5 = 0 AS client_truncated,
  CASE WHEN event_id % 11 = 0 THEN false WHEN event_id % 11 = 1 THEN true END AS client_margin_valid,
  'q' || (user_id % 40) || '.' || CAST(props->>'$.k' AS INTEGER) AS query FROM events)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn, the answer to it, and the first answer of the next conversation as the rejected one."""
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("chosen"))
    first = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("reject"))
    rejects = first.select((F.col("conv_id") - 1).alias("conv_id"), "reject")
    return u.join(a, ["conv_id", "turn"]).join(rejects, "conv_id", "left").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "conv_id", "query", "chosen", "reject")


PAIRS = """px_first AS (SELECT conv_id, min_by(text, turn) AS reject FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
px_pair AS (SELECT u.conv_id * 1000 + u.turn AS row_id, u.conv_id, u.text AS query, a.text AS chosen, f.reject FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND u.role = 'user'
  LEFT JOIN px_first f ON f.conv_id = u.conv_id + 1)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with metrics, some of them missing, for the pools: events stand for pairs."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    gap = lambda c, n: F.when(F.col("event_id") % 7 != n, c)
    return e.select(
        F.col("event_id").alias("row_id"),
        (F.col("user_id") % 7).alias("client_id"),
        gap(F.col("value") / 5, 0).alias("bleu"),
        gap(k / 100, 1).alias("sim_char"),
        gap(k / 200, 2).alias("sim_jacc"),
        (F.lit(1.0) - k / 150).alias("len_ratio"),
        (F.col("value") / 300).alias("hardness_score"),
    )


METRICS = """px_metrics AS (SELECT event_id AS row_id, user_id % 7 AS client_id, CASE WHEN event_id % 7 <> 0 THEN value / 5 END AS bleu,
  CASE WHEN event_id % 7 <> 1 THEN k / 100 END AS sim_char, CASE WHEN event_id % 7 <> 2 THEN k / 200 END AS sim_jacc,
  1e0 - k / 150 AS len_ratio, value / 300 AS hardness_score FROM (SELECT *, CAST(props->>'$.k' AS DOUBLE) AS k FROM events))"""


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients' parameters: labels are clients, ranks of vectors within a label are tensors (even A, odd B), components are values."""
    e = table(spark, sf_dir, "embeddings")
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    key = F.concat(F.lit("layers."), F.floor(F.col("r") / 2).cast("string"), F.when(F.col("r") % 2 == 0, ".lora_A").otherwise(".lora_B"))
    return ranked.select(F.col("label").alias("client_id"), key.alias("key"), F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def _tensor_views(prefix: str) -> str:
    """Materialised, and made anew where a query needs them twice: a limit above a join of such a view with itself never ends in DuckDB."""
    return f"""{prefix}_rank AS MATERIALIZED (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings),
{prefix}_tensor AS MATERIALIZED (SELECT label AS client_id, 'layers.' || (r // 2) || CASE WHEN r % 2 = 0 THEN '.lora_A' ELSE '.lora_B' END AS key,
  CAST(i AS INTEGER) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS value FROM {prefix}_rank, range(0, 64) t(i))"""


TENSORS = _tensor_views("px")


def global_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global state: client 0's parameters, but for the first tensors' values halved, and two tensors it lacks."""
    return tensors(spark, sf_dir).where("client_id = 0 AND key NOT IN ('layers.3.lora_A', 'layers.4.lora_B')").select("key", "pos", (F.col("value") * 0.5).alias("value"))


STATE = f"{TENSORS},\n{_tensor_views('px_first')},\npx_state AS MATERIALIZED (SELECT key, pos, value * 5e-1 AS value FROM px_first_tensor WHERE client_id = 0 AND key NOT IN ('layers.3.lora_A', 'layers.4.lora_B'))"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("client_id")).agg(F.count("*").alias("sample_num"))


SAMPLES = "px_samples AS (SELECT label AS client_id, count(*) AS sample_num FROM embeddings GROUP BY label)"


def logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token log-probabilities of pairs by two models: four vectors make a pair."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    out = e.select(
        F.floor(v / 4).cast("long").alias("row_id"),
        F.when(v % 2 == 0, "chosen").otherwise("rejected").alias("response_name"),
        F.when(v % 4 < 2, "policy").otherwise("ref").alias("model"),
        (v % 8).cast("int").alias("prompt_len"),
        (F.lit(64) - (v % 3)).cast("int").alias("full_len"),
        (v % 3 == 0).alias("truncated"),
        F.posexplode("embedding").alias("pos", "x"),
    )
    return out.withColumn("logprob", F.when(F.col("row_id") % 50 != 7, -F.abs(F.col("x").cast("double")))).drop("x")


LOGPROBS = """px_logprob AS (SELECT vec_id // 4 AS row_id, CASE WHEN vec_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS response_name,
  CASE WHEN vec_id % 4 < 2 THEN 'policy' ELSE 'ref' END AS model, vec_id % 8 AS prompt_len, 64 - vec_id % 3 AS full_len, vec_id % 3 = 0 AS truncated,
  i AS pos, CASE WHEN (vec_id // 4) % 50 <> 7 THEN -abs(CAST(embedding[i + 1] AS DOUBLE)) END AS logprob FROM embeddings, range(0, 64) t(i))"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def code_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code samples: a document's first line is its docstring, the words of its text the code's tokens, its language the language."""
    d = documents(spark, sf_dir)
    words = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda w: w != "")
    return d.select("doc_id", "lang", F.col("source").alias("repo"), F.concat(F.lit("f"), (F.col("doc_id") % 20).cast("string")).alias("func_name"), F.split("text", "\n")[0].alias("docstring"), words.alias("code_tokens"))


CODE = """px_code AS (SELECT doc_id, lang, source AS repo, 'f' || (doc_id % 20) AS func_name, string_split(text, chr(10))[1] AS docstring,
  list_filter(regexp_split_to_array(lower(text), '[ \n]+'), lambda w: w <> '') AS code_tokens FROM documents)"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, some blank, some broken, some no objects."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 10
    margin = F.when(kind == 3, F.lit('"0.25"')).when(kind == 4, F.lit("true")).when(kind == 5, F.lit("null")).otherwise(F.col("value").cast("int").cast("string"))
    good = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "margin": '), margin, F.lit("}"))
    line = F.when(kind == 0, F.lit("  ")).when(kind == 1, F.concat(F.lit('{"id": '), F.col("event_id").cast("string"))).when(kind == 2, F.lit("[1, 2]")).otherwise(good)
    return e.select("event_type", line.alias("value"))


