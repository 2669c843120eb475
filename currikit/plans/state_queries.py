"""Queries for pools, scoring, parameter states, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from currikit.functions import text as T
from currikit.operators import federated as A
from currikit.operators import pools as P
from currikit.operators import scoring as G
from currikit.operators import selection as S
from currikit.plans import proxies as X
from currikit.plans import selection_queries as Q
from currikit.sources import readers, writers
from currikit.sources.shared import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


c = F.col

# ---------------------------------------------------------------- pools
_share = lambda x: f"greatest(0e0, least(1e0, coalesce({x}, 0e0)))"
_near = lambda x, m: f"(1e0 - least(1e0, abs({x} - {m}) / {m}))"
_D = "coalesce(greatest(0e0, least(1e0, bleu / 100e0)), greatest(0e0, least(1e0, sim_char)), greatest(0e0, least(1e0, sim_jacc)), hardness_score, 0e0)"
_D = _D.replace("greatest(0e0, least(1e0, bleu / 100e0))", "CASE WHEN bleu IS NOT NULL THEN greatest(0e0, least(1e0, bleu / 100e0)) END").replace("greatest(0e0, least(1e0, sim_char))", "CASE WHEN sim_char IS NOT NULL THEN greatest(0e0, least(1e0, sim_char)) END").replace("greatest(0e0, least(1e0, sim_jacc))", "CASE WHEN sim_jacc IS NOT NULL THEN greatest(0e0, least(1e0, sim_jacc)) END")
_Q = f"35e-2 * {_near(_share('sim_char'), '48e-2')} + 25e-2 * {_near(_share('sim_jacc'), '22e-2')} + 25e-2 * {_near(_share('bleu / 100e0'), '24e-2')} + 15e-2 * {_share('len_ratio')}"
_M = f"{X.METRICS}, m AS (SELECT *, {_D} AS difficulty_score, {_Q} AS quality FROM px_metrics)"


def _metrics(spark, sf_dir):
    return P.with_scores(X.metrics(spark, sf_dir))


@_query("fn_difficulty_score", f"WITH {_M} SELECT row_id, difficulty_score AS value FROM m")
def fn_difficulty_score(spark, sf_dir):
    return _metrics(spark, sf_dir).select("row_id", c("difficulty_score").alias("value"))


@_query("fn_pair_quality", f"WITH {_M} SELECT row_id, round(quality, 9) AS value FROM m")
def fn_pair_quality(spark, sf_dir):
    return _metrics(spark, sf_dir).select("row_id", F.round("quality", 9).alias("value"))


@_query("win_ratio_buckets", f"WITH {_M}, n AS (SELECT client_id, row_id, row_number() OVER (PARTITION BY client_id ORDER BY difficulty_score, row_id) AS rn, count(*) OVER (PARTITION BY client_id) AS n FROM m) SELECT client_id, row_id, CASE WHEN rn <= round_even(n * 4e-1, 0) THEN 'easy' WHEN rn <= 2 * round_even(n * 4e-1, 0) THEN 'medium' ELSE 'hard' END AS level FROM n")
def win_ratio_buckets(spark, sf_dir):
    return P.ratio_buckets(_metrics(spark, sf_dir), ["client_id"], "difficulty_score", "row_id").select("client_id", "row_id", "level")


@_query("win_margin_buckets", f"WITH {X.SCORED}, n AS (SELECT client_id, row_id, row_number() OVER (PARTITION BY client_id ORDER BY client_margin DESC, row_id) AS rn, count(*) OVER (PARTITION BY client_id) AS n FROM px_scored WHERE client_margin_valid IS DISTINCT FROM false) SELECT client_id, row_id, CASE WHEN rn <= round_even(n * 3e-1, 0) THEN 'easy' WHEN rn <= round_even(n * 3e-1, 0) + round_even(n * 5e-1, 0) THEN 'medium' ELSE 'hard' END AS level FROM n")
def win_margin_buckets(spark, sf_dir):
    rows = X.scored(spark, sf_dir).where(F.coalesce("client_margin_valid", F.lit(True)))
    return P.ratio_buckets(rows, ["client_id"], "client_margin", "row_id", 0.3, 0.5, descending=True).select("client_id", "row_id", "level")


_FLOOR = f"{_M}, fl AS (SELECT client_id, quantile_cont(quality, 5e-2) AS f, count(*) AS n FROM m GROUP BY 1), k AS (SELECT m.client_id, count(*) FILTER (quality >= f) AS kept FROM m JOIN fl USING (client_id) GROUP BY 1), q AS (SELECT m.* FROM m JOIN fl USING (client_id) JOIN k USING (client_id) WHERE quality >= f OR kept < greatest(3, least(12, n)))"


@_query("flt_quality_floor", f"WITH {_FLOOR} SELECT client_id, row_id FROM q")
def flt_quality_floor(spark, sf_dir):
    return P.quality_floor(_metrics(spark, sf_dir), ["client_id"]).select("client_id", "row_id")


_BALANCED = f"""{_FLOOR}, n AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY difficulty_score, quality DESC, row_id) AS rn, count(*) OVER (PARTITION BY client_id) AS n FROM q),
l AS (SELECT *, least(1, greatest(1, n // 3)) AS lo FROM n), e AS (SELECT *, greatest(lo, least(n - 2 * lo, round_even(n * 4e-1, 0))) AS ne FROM l), f AS (SELECT *, greatest(lo, least(n - ne - lo, round_even(n * 35e-2, 0))) AS nm FROM e),
b AS (SELECT *, CASE WHEN n <= 2 THEN CASE WHEN rn = 1 THEN 'easy' ELSE 'medium' END WHEN rn <= ne THEN 'easy' WHEN rn <= ne + nm THEN 'medium' ELSE 'hard' END AS level FROM f)"""


@_query("win_balanced_quantile", f"WITH {_BALANCED} SELECT client_id, row_id, level FROM b")
def win_balanced_quantile(spark, sf_dir):
    return P.balanced_buckets(_metrics(spark, sf_dir), ["client_id"], "row_id").select("client_id", "row_id", "level")


_BANDS = f"""{_M}, e AS (SELECT * REPLACE (CASE WHEN client_id = 2 THEN difficulty_score * 1e-1 ELSE difficulty_score END AS difficulty_score) FROM m), s AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY difficulty_score, row_id) - 1 AS i, count(*) OVER (PARTITION BY client_id) AS n,
  CASE WHEN difficulty_score <= 16e-2 THEN 'easy' WHEN difficulty_score BETWEEN 16e-2 AND 3e-1 THEN 'medium' WHEN difficulty_score BETWEEN 3e-1 AND 45e-2 THEN 'hard' END AS band FROM e),
h AS (SELECT client_id, list(DISTINCT band) AS has FROM s GROUP BY 1), b AS (SELECT client_id, row_id, band AS level FROM s WHERE band IS NOT NULL
  UNION ALL SELECT client_id, row_id, 'easy' FROM s JOIN h USING (client_id) WHERE NOT list_contains(has, 'easy') AND i < greatest(1, round_even(n * 3e-1, 0))
  UNION ALL SELECT client_id, row_id, 'medium' FROM s JOIN h USING (client_id) WHERE NOT list_contains(has, 'medium') AND i >= round_even(n * 3e-1, 0) AND i < greatest(round_even(n * 3e-1, 0) + 1, round_even(n * 65e-2, 0))
  UNION ALL SELECT client_id, row_id, 'hard' FROM s JOIN h USING (client_id) WHERE NOT list_contains(has, 'hard') AND i >= round_even(n * 65e-2, 0))"""


@_query("win_score_bands", f"WITH {_BANDS} SELECT client_id, row_id, level FROM b")
def win_score_bands(spark, sf_dir):
    score = c("difficulty_score")  # one client's pairs are all easy
    rows = _metrics(spark, sf_dir).withColumn("difficulty_score", F.when(c("client_id") == 2, score * 0.1).otherwise(score))
    return P.score_bands(rows, ["client_id"], "row_id").select("client_id", "row_id", "level")


def _levels(spark, sf_dir):
    return P.balanced_buckets(_metrics(spark, sf_dir), ["client_id"], "row_id")


@_query("proj_annotate", f"WITH {_BALANCED} SELECT row_id, level AS difficulty, 'local_' || level AS source, CASE level WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS curriculum_level, client_id AS curriculum_client_id FROM b")
def proj_annotate(spark, sf_dir):
    out = P.annotate(_levels(spark, sf_dir).withColumn("origin", F.lit("local")))
    return out.select("row_id", "difficulty", "source", "curriculum_level", "metadata.curriculum_client_id")


@_query("proj_pair_metadata", f"WITH {X.METRICS} SELECT row_id, round_even(sim_char, 2) AS sim_char, client_id FROM px_metrics")
def proj_pair_metadata(spark, sf_dir):
    meta = X.metrics(spark, sf_dir).select("row_id", F.struct(F.bround("sim_char", 4).alias("sim_char"), "client_id").alias("metadata"))
    return meta.select("row_id", "metadata.*")


@_query("proj_stable_row", f"WITH {X.SCORED} SELECT row_id, source, client_margin AS instruction_margin, coalesce(client_margin_valid, true) AS client_margin_valid, query FROM px_scored")
def proj_stable_row(spark, sf_dir):
    return P.stable_rows(X.scored(spark, sf_dir)).select("row_id", "source", "instruction_margin", "client_margin_valid", "query")


@_query("agg_split_stats", f"WITH {_BALANCED} SELECT client_id, level, count(*) AS n, min(difficulty_score) AS min_difficulty, max(difficulty_score) AS max_difficulty, round(avg(quality), 6) AS mean_quality FROM b GROUP BY ALL")
def agg_split_stats(spark, sf_dir):
    return P.split_stats(_levels(spark, sf_dir), ["client_id"]).withColumn("mean_quality", F.round("mean_quality", 6))


@_query("agg_split_stats_empty", "SELECT client_id, level, CASE WHEN level = 'easy' THEN n ELSE 0 END AS n FROM (SELECT user_id % 7 AS client_id, count(*) AS n FROM events GROUP BY 1), unnest(['easy', 'medium', 'hard']) t(level)")
def agg_split_stats_empty(spark, sf_dir):
    return P.split_stats(_metrics(spark, sf_dir).withColumn("level", F.lit("easy")), ["client_id"]).select("client_id", "level", "n")


@_query("discover_partitions", "SELECT lang, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS client_id FROM documents GROUP BY lang")
def discover_partitions(spark, sf_dir):
    return P.discover_clients(X.documents(spark, sf_dir))


@_query("discover_known_partitions", "SELECT DISTINCT lang, CASE lang WHEN 'fr' THEN 0 ELSE 1 END AS client_id FROM documents WHERE lang IN ('fr', 'en')")
def discover_known_partitions(spark, sf_dir):
    return P.discover_clients(X.documents(spark, sf_dir), known=["fr", "xx", "en"])


@_query("sink_empty_pools", "SELECT DISTINCT user_id % 7 AS client_id, level, CAST(0 AS BIGINT) AS n FROM events, unnest(['easy', 'medium', 'hard']) t(level)")
def sink_empty_pools(spark, sf_dir):
    return writers.empty_pools(X.scored(spark, sf_dir).select("client_id").distinct())


# ---------------------------------------------------------------- scoring
_SUMS = f"{X.LOGPROBS}, s AS (SELECT row_id, response_name, model, sum(logprob) FILTER (pos >= prompt_len AND pos < full_len) AS logp, count(logprob) FILTER (pos >= prompt_len AND pos < full_len) AS tokens, bool_or(truncated) AS truncated FROM px_logprob GROUP BY ALL)"


def _sums(spark, sf_dir):
    return G.response_logprobs(X.logprobs(spark, sf_dir), ["row_id", "response_name", "model"])


@_query("agg_sum_response_logprob", f"WITH {_SUMS} SELECT row_id, response_name, model, round(logp, 6) AS logp, tokens, truncated, tokens > 0 AS valid FROM s")
def agg_sum_response_logprob(spark, sf_dir):
    return _sums(spark, sf_dir).withColumn("logp", F.round(F.when(c("valid"), c("logp")), 6))


_PARTS = ", ".join(f"max(CASE WHEN model = '{m}' AND response_name = '{r}' THEN logp END) AS {m}_{r}" for m in ("policy", "ref") for r in ("chosen", "rejected"))


@_query("join_margin_parts", f"WITH {_SUMS}, p AS (SELECT row_id, {_PARTS}, bool_or(truncated) AS t FROM s GROUP BY 1) SELECT row_id, round(1e-1 * ((policy_chosen - policy_rejected) - (ref_chosen - ref_rejected)), 6) AS client_margin, t AS client_truncated, policy_chosen + policy_rejected + ref_chosen + ref_rejected IS NOT NULL AS client_margin_valid FROM p")
def join_margin_parts(spark, sf_dir):
    return G.margin_parts(_sums(spark, sf_dir), "row_id").select("row_id", F.round("client_margin", 6).alias("client_margin"), "client_truncated", "client_margin_valid")


@_query("ext_build_examples", "SELECT conv_id AS row_id, r AS response_name, CAST(least(n + CASE r WHEN 'chosen' THEN 3 ELSE 2 END, 40) AS INTEGER) AS full_len, CAST(least(n, 40) AS INTEGER) AS prompt_len, n + CASE r WHEN 'chosen' THEN 3 ELSE 2 END > 40 AS truncated FROM (SELECT conv_id * 100 + turn AS conv_id, len(string_split(text, ' ')) AS n FROM conversations), unnest(['chosen', 'rejected']) t(r)")
def ext_build_examples(spark, sf_dir):
    rows = X.table(spark, sf_dir, "conversations").select((c("conv_id") * 100 + c("turn")).alias("row_id"), F.split("text", " ").alias("p"), F.array(*map(F.lit, "abc")).alias("a"), F.array(*map(F.lit, "xy")).alias("b"))
    return G.examples(rows, "row_id", "p", "a", "b", 40).select("row_id", "response_name", "full_len", "prompt_len", "truncated")


@_query("flt_missing_text", f"WITH {X.PAIRS} SELECT row_id, reject IS NOT NULL AS client_margin_valid, CASE WHEN reject IS NULL THEN 'missing query/chosen/rejected' END AS client_margin_error FROM px_pair")
def flt_missing_text(spark, sf_dir):
    return G.mark_missing(X.pairs(spark, sf_dir), "query", "chosen", "reject").select("row_id", "client_margin_valid", "client_margin_error")


@_query("agg_score_summary", f"WITH {X.SCORED} SELECT source, count(*) AS num_rows, count(*) FILTER (client_margin_valid = false) AS num_invalid, round(avg(client_margin), 6) AS mean_margin FROM px_scored GROUP BY 1")
def agg_score_summary(spark, sf_dir):
    return G.score_summary(X.scored(spark, sf_dir)).withColumn("mean_margin", F.round("mean_margin", 6))


def _length_model():
    def score(pdf):
        return pdf.assign(logprob=-pdf["text"].str.len() / 100.0)[["doc_id", "logprob"]]

    return score


@_query("ext_score_logprobs", "SELECT doc_id, -length(text) / 100e0 AS logprob FROM documents")
def ext_score_logprobs(spark, sf_dir):
    return G.with_model(X.documents(spark, sf_dir).select("doc_id", "text"), _length_model, "doc_id long, logprob double")


@_query("ext_score_source", f"WITH {_SUMS}, p AS (SELECT row_id, {_PARTS} FROM s GROUP BY 1), m AS (SELECT row_id, 1e-1 * ((policy_chosen - policy_rejected) - (ref_chosen - ref_rejected)) AS g FROM p) SELECT row_id % 3 AS source, count(*) AS num_rows, count(*) FILTER (g IS NULL) AS num_invalid, round(avg(g), 6) AS mean_margin FROM m GROUP BY 1")
def ext_score_source(spark, sf_dir):
    """Scores of each source from the models' log-probabilities."""
    scored = G.margin_parts(_sums(spark, sf_dir), "row_id").withColumn("source", c("row_id") % 3)
    return G.score_summary(scored).withColumn("mean_margin", F.round("mean_margin", 6))


@_query("ext_generate_candidates", "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n FROM documents")
def ext_generate_candidates(spark, sf_dir):
    model = lambda: lambda prompts: [["first answer", " " if int(p) % 2 else "second answer"] for p in prompts]
    prompts = X.documents(spark, sf_dir).select("doc_id", c("doc_id").cast("string").alias("prompt"))
    return G.generate_candidates(prompts, model, "doc_id").select("doc_id", F.size("generated_responses").alias("n"))


@_query("ext_count_tokens", "SELECT doc_id, len(string_split(text, ' ')) AS n_tokens FROM documents")
def ext_count_tokens(spark, sf_dir):
    return G.count_tokens(X.documents(spark, sf_dir), lambda: lambda t: len(t.split(" ")), "text").select("doc_id", "n_tokens")


# ---------------------------------------------------------------- parameter states
_W = f"{X.SAMPLES}, w AS (SELECT client_id, sample_num / greatest(1, sum(sample_num) OVER ()) AS w FROM px_samples)"
_FED = f"{X.STATE}, {_W}, l AS (SELECT t.*, w.w, 1e-1 AS u FROM px_tensor t JOIN w USING (client_id) WHERE key LIKE '%lora_A%'), a AS (SELECT key, pos, sum(value * w) AS sw, sum(w) AS w, avg(value) AS mean FROM l GROUP BY ALL), j AS (SELECT s.key, s.pos, s.value AS g, a.sw, a.w, a.mean, a.mean - s.value AS d FROM px_state s LEFT JOIN a USING (key, pos))"
#: An optimizer's state in a later round.
_OPT = "2e-1 * g AS m, g * g + 1e-2 AS v"


def _optimizer(state):
    return state.select("key", "pos", (0.2 * c("value")).alias("m"), (c("value") * c("value") + 0.01).alias("v"))


def _rule(name: str, value: str, m: str = "NULL", v: str = "NULL", later: bool = False) -> None:
    """Registers a server rule, in its first round or a later one."""
    rule = name.removeprefix("fed_").removesuffix("_later")

    def run(spark, sf_dir):
        state = X.global_state(spark, sf_dir)
        out = A.aggregate(state, X.tensors(spark, sf_dir), X.samples(spark, sf_dir), A.Server(rule), int(later), _optimizer(state) if later else None)
        return out.select("key", "pos", F.round("value", 6).alias("value"))

    QUERIES[name] = run
    opt = _OPT if later else "0e0 AS m, 1e-3 * 1e-3 AS v"
    ORACLES[name] = f"WITH {_FED}, o AS (SELECT *, {opt} FROM j), n AS (SELECT *, {m} AS m1 FROM o), k AS (SELECT *, {v} AS v1 FROM n) SELECT key, pos, round(CASE WHEN sw IS NULL THEN g ELSE {value} END, 6) + 0e0 AS value FROM k"


_STEP = "g + 1e-3 * m1 / (sqrt(v1) + 1e-3)"
_MOMENTUM = "9e-1 * m + (1e0 - 9e-1) * d"
_YOGI = "v - (1e0 - 99e-2) * m1 * m1 * sign(v - m1 * m1)"
_ADAM = "99e-2 * v + (1e0 - 99e-2) * m1 * m1"
_rule("fed_fedavg", "sw")
QUERIES["agg_fedavg"], ORACLES["agg_fedavg"] = QUERIES["fed_fedavg"], ORACLES["fed_fedavg"]
_rule("fed_fedprox", "sw")
_rule("fed_fedavgm", "g + m1", "sw - g * w")
_rule("fed_fedavgm_later", "g + m1", "9e-1 * m + (1e0 - 9e-1) * (sw - g * w)", later=True)
_rule("fed_fedadagrad", _STEP, "d", "v + m1 * m1")
_rule("fed_fedadagrad_later", _STEP, "d", "v + m1 * m1", later=True)
_rule("fed_fedyogi", _STEP, "d", _YOGI)
_rule("fed_fedyogi_later", _STEP, _MOMENTUM, _YOGI, later=True)
_rule("fed_fedadam", _STEP, "d", _ADAM)
_rule("fed_fedadam_later", _STEP, _MOMENTUM, _ADAM, later=True)


@_query("fed_local_all_keys", f"WITH {X.STATE}, {_W} SELECT s.key, s.pos, round(coalesce(x.v, s.value), 6) + 0e0 AS value FROM px_state s LEFT JOIN (SELECT key, pos, sum(value * w) AS v FROM px_tensor JOIN w USING (client_id) GROUP BY ALL) x USING (key, pos)")
def fed_local_all_keys(spark, sf_dir):
    """A rule that shares every key."""
    out = A.aggregate(X.global_state(spark, sf_dir), X.tensors(spark, sf_dir), X.samples(spark, sf_dir), A.Server("local_all"))
    return out.select("key", "pos", F.round("value", 6).alias("value"))


@_query("fed_empty_round", f"WITH {X.STATE} SELECT key, pos, value FROM px_state")
def fed_empty_round(spark, sf_dir):
    out = A.aggregate(X.global_state(spark, sf_dir), X.tensors(spark, sf_dir).limit(0), X.samples(spark, sf_dir).limit(0), A.Server())
    return out.select("key", "pos", "value")


@_query("fed_keys", f"WITH {X.TENSORS} SELECT DISTINCT key FROM px_tensor WHERE key LIKE '%lora_A%'")
def fed_keys(spark, sf_dir):
    return X.tensors(spark, sf_dir).where(A.shared("fedavg")).select("key").distinct()


@_query("agg_client_weights", f"WITH {_W} SELECT client_id, w, 1e0 / count(*) OVER () AS u FROM w")
def agg_client_weights(spark, sf_dir):
    s = X.samples(spark, sf_dir)
    return A.client_weights(s).join(A.client_weights(s, uniform=True).withColumnRenamed("w", "u"), "client_id")


@_query("agg_mean_delta", f"WITH {_FED} SELECT key, pos, round(d, 6) + 0e0 AS delta FROM j WHERE d IS NOT NULL")
def agg_mean_delta(spark, sf_dir):
    local = X.tensors(spark, sf_dir).where(T.is_lora_a(c("key")))
    return A.mean_delta(X.global_state(spark, sf_dir), local).withColumn("delta", F.round("delta", 6))


_CTRL = f"{X.STATE}, n AS (SELECT t.client_id, t.key, t.pos, (s.value - t.value) / (10 * 1e-2) - (s.value - t.value * 5e-1) AS c1, t.value * 5e-1 AS c0 FROM px_tensor t JOIN px_state s USING (key, pos)), k AS (SELECT client_id, key, pos, CASE WHEN key LIKE '%lora_A%' THEN c1 ELSE c0 END AS c, CASE WHEN key LIKE '%lora_A%' THEN c1 - c0 ELSE 0e0 END AS delta FROM n)"


def _controls(spark, sf_dir):
    state, local = X.global_state(spark, sf_dir), X.tensors(spark, sf_dir)
    server = state.select("key", "pos", c("value").alias("c"))
    own = local.select("client_id", "key", "pos", (c("value") * 0.5).alias("c"))
    return server, A.scaffold_client(state, local, server, own, 10, 1e-2)


@_query("fed_scaffold_client", f"WITH {_CTRL} SELECT client_id, key, pos, round(c, 6) + 0e0 AS c, round(delta, 6) + 0e0 AS delta FROM k")
def fed_scaffold_client(spark, sf_dir):
    return _controls(spark, sf_dir)[1].withColumns({"c": F.round("c", 6) + 0.0, "delta": F.round("delta", 6) + 0.0})


@_query("fed_scaffold_server", f"WITH {_CTRL} SELECT s.key, s.pos, round(s.value + coalesce(d.d, 0e0) / 12, 6) + 0e0 AS c FROM px_state s LEFT JOIN (SELECT key, pos, sum(delta) AS d FROM k WHERE key LIKE '%lora_A%' GROUP BY ALL) d USING (key, pos)")
def fed_scaffold_server(spark, sf_dir):
    server, deltas = _controls(spark, sf_dir)
    return A.scaffold_server(server, deltas, 12).withColumn("c", F.round("c", 6) + 0.0)


@_query("fed_prox_penalty", f"WITH {X.STATE} SELECT client_id, round(1e-2 / 2 * sum((t.value - s.value) * (t.value - s.value)), 6) AS penalty FROM px_tensor t JOIN px_state s USING (key, pos) WHERE key LIKE '%lora_A%' GROUP BY 1")
def fed_prox_penalty(spark, sf_dir):
    return A.prox_penalty(X.global_state(spark, sf_dir), X.tensors(spark, sf_dir)).withColumn("penalty", F.round("penalty", 6))


@_query("fed_trainer_dispatch", "SELECT * FROM (VALUES ('fedavg', 'plain'), ('fedprox', 'fedprox'), ('scaffold', 'scaffold'), ('local0', 'plain')) t(rule, trainer)")
def fed_trainer_dispatch(spark, sf_dir):
    return spark.createDataFrame([(r, A.trainer_of(r)) for r in ("fedavg", "fedprox", "scaffold", "local0")], "rule string, trainer string")


@_query("fed_state_init", f"WITH {X.STATE} SELECT key, pos, 0e0 AS m, 1e-3 * 1e-3 AS v FROM px_state")
def fed_state_init(spark, sf_dir):
    return A.initial_state(X.global_state(spark, sf_dir), A.Server("fedadam"))


_G = f"{X.STATE}, f AS (SELECT t.*, s.value AS g FROM px_tensor t LEFT JOIN px_state s USING (key, pos))"


@_query("join_global_local_fuse", f"WITH {_G} SELECT client_id, key, pos, CASE WHEN key LIKE '%lora_A%' THEN coalesce(g, value) ELSE value END AS value FROM f")
def join_global_local_fuse(spark, sf_dir):
    return A.fuse(X.global_state(spark, sf_dir), X.tensors(spark, sf_dir))


@_query("fed_fuse_adapters", f"WITH {X.STATE} SELECT 'local' AS how, client_id, count(*) AS n, round(sum(value), 6) AS total FROM px_tensor GROUP BY ALL UNION ALL SELECT 'global', client_id, (SELECT count(*) FROM px_state), (SELECT round(sum(value), 6) FROM px_state) FROM (SELECT DISTINCT client_id FROM px_tensor)")
def fed_fuse_adapters(spark, sf_dir):
    state, local = X.global_state(spark, sf_dir), X.tensors(spark, sf_dir)
    total = lambda how: A.fuse(state, local, how).groupBy("client_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).withColumn("how", F.lit(how))
    return total("local").unionByName(total("global")).select("how", "client_id", "n", "total")


@_query("join_client_init", f"WITH {_G} SELECT client_id, key, pos, CASE WHEN key LIKE '%lora_A%' THEN g ELSE value END AS value FROM f")
def join_client_init(spark, sf_dir):
    return A.client_init(X.global_state(spark, sf_dir), X.tensors(spark, sf_dir))


@_query("join_a_only_export", f"WITH {_G} SELECT key, pos, CASE WHEN key LIKE '%lora_A%' THEN coalesce(g, value) ELSE value END AS value FROM f WHERE client_id = 1")
def join_a_only_export(spark, sf_dir):
    a = X.global_state(spark, sf_dir).where(T.is_lora_a(c("key")))
    return A.fuse(a, X.tensors(spark, sf_dir).where("client_id = 1")).select("key", "pos", "value")


@_query("agg_export_b", f"WITH {X.STATE}, {_W} SELECT s.key, s.pos, round(coalesce(b.v, s.value), 6) + 0e0 AS value FROM px_state s LEFT JOIN (SELECT key, pos, sum(value * w) AS v FROM px_tensor JOIN w USING (client_id) WHERE key LIKE '%lora_B%' GROUP BY ALL) b USING (key, pos)")
def agg_export_b(spark, sf_dir):
    return A.export_b(X.global_state(spark, sf_dir), X.tensors(spark, sf_dir), X.samples(spark, sf_dir)).withColumn("value", F.round("value", 6) + 0.0)


@_query("agg_cosine_lora_a", f"WITH {X.STATE} SELECT client_id, round(sum(s.value * t.value) / greatest(sqrt(sum(s.value * s.value) * sum(t.value * t.value)), 1e-12), 6) AS cosine, count(DISTINCT key) AS n FROM px_tensor t JOIN px_state s USING (key, pos) WHERE key LIKE '%lora_A%' GROUP BY 1")
def agg_cosine_lora_a(spark, sf_dir):
    return A.cosine_a(X.global_state(spark, sf_dir), X.tensors(spark, sf_dir)).withColumn("cosine", F.round("cosine", 6))


@_query("agg_tensor_counts", f"WITH {X.STATE}, k AS (SELECT DISTINCT client_id, key FROM px_tensor) SELECT client_id, count(*) FILTER (key LIKE '%lora_A%') AS n_a, count(*) FILTER (key LIKE '%lora_B%') AS n_b, count(*) FILTER (key LIKE '%lora_A%' AND key IN (SELECT key FROM px_state)) AS n_replaced FROM k GROUP BY 1")
def agg_tensor_counts(spark, sf_dir):
    return A.tensor_counts(X.tensors(spark, sf_dir), X.global_state(spark, sf_dir))


_KEYS = """src AS (SELECT 'base.layers.' || r_regionkey || '.lora_A.w' AS key, r_regionkey AS ordinal FROM region UNION ALL SELECT 'x.' || r_name, 10 + r_regionkey FROM region),
tgt AS (SELECT 'base.layers.0.lora_A.w' AS key UNION ALL SELECT 'model.layers.' || r_regionkey || '.lora_A.w' FROM region UNION ALL SELECT 'deep.x.' || r_name FROM region UNION ALL SELECT 'nothing')"""


@_query("join_param_alignment", f"WITH {_KEYS} SELECT key, CASE WHEN key LIKE 'deep.%' THEN substr(key, 6) WHEN key LIKE 'model.%' THEN 'base' || substr(key, 6) ELSE key END AS source_key, CASE WHEN key LIKE 'deep.%' THEN 3 WHEN key LIKE 'model.%' THEN 2 ELSE 1 END AS tier FROM tgt WHERE key <> 'nothing'")
def join_param_alignment(spark, sf_dir):
    r = X.table(spark, sf_dir, "region")
    name = lambda prefix, col, suffix="": F.concat(F.lit(prefix), c(col).cast("string"), F.lit(suffix)).alias("key")
    sources = r.select(name("base.layers.", "r_regionkey", ".lora_A.w"), c("r_regionkey").alias("ordinal")).union(r.select(name("x.", "r_name"), c("r_regionkey") + 10))
    single = r.where("r_regionkey = 0")
    targets = single.select(F.lit("base.layers.0.lora_A.w").alias("key")).union(r.select(name("model.layers.", "r_regionkey", ".lora_A.w"))).union(r.select(name("deep.x.", "r_name"))).union(single.select(F.lit("nothing")))
    return A.align_keys(targets, sources)


@_query("agg_train_stats_mean", "SELECT user_id % 7 AS client_id, round(avg(value), 6) AS loss, round(avg(event_id), 6) AS acc, count(*) AS num_steps FROM events GROUP BY 1")
def agg_train_stats_mean(spark, sf_dir):
    steps = X.table(spark, sf_dir, "events").select((c("user_id") % 7).alias("client_id"), c("value").alias("loss"), c("event_id").cast("double").alias("acc"))
    return A.train_stats(steps, ["loss", "acc"]).withColumns({m: F.round(m, 6) for m in ("loss", "acc")})


@_query(
    "fed_round_loop",
    f"""WITH {_FED}, r1 AS (SELECT *, d AS m1, 99e-2 * 1e-3 * 1e-3 + (1e0 - 99e-2) * d * d AS v1 FROM j), g1 AS (SELECT *, g + 1e-3 * m1 / (sqrt(v1) + 1e-3) AS h FROM r1),
r2 AS (SELECT *, 9e-1 * m1 + (1e0 - 9e-1) * (mean - h) AS m2 FROM g1), v2 AS (SELECT *, 99e-2 * v1 + (1e0 - 99e-2) * m2 * m2 AS v2 FROM r2)
SELECT key, pos, round(CASE WHEN sw IS NULL THEN g ELSE h + 1e-3 * m2 / (sqrt(v2) + 1e-3) END, 6) + 0e0 AS value FROM v2""",
)
def fed_round_loop(spark, sf_dir):
    """Two rounds of an adaptive rule with a state that is written between them."""
    from currikit.plans.rounds import run_rounds

    local = X.tensors(spark, sf_dir)
    out = run_rounds(X.global_state(spark, sf_dir), lambda round_, state: local, X.samples(spark, sf_dir), A.Server("fedadam"), 2, shared_folder(spark, "rounds"))
    return out.select("key", "pos", (F.round("value", 6) + 0.0).alias("value"))


# ---------------------------------------------------------------- sources and sinks
def _round_trip(df, write, read, name: str):
    folder = shared_folder(df.sparkSession, name)
    write(df, folder)
    return read(folder)


_SCORED_ROWS = f"WITH {X.SCORED} SELECT row_id, client_id, source, client_margin FROM px_scored"


def _small(spark, sf_dir):
    return X.scored(spark, sf_dir).select("row_id", "client_id", "source", "client_margin")


_FIELDS = {"row_id": "long", "client_id": "long", "source": "string", "client_margin": "double"}


@_query("sink_jsonl", _SCORED_ROWS)
def sink_jsonl(spark, sf_dir):
    """Written as JSON lines and read back leniently."""
    return _round_trip(_small(spark, sf_dir), writers.write_jsonl, lambda p: readers.read_jsonl(spark, p, _FIELDS).drop("raw"), "jsonl")


@_query("scan_named_sources", f"WITH {X.SCORED} SELECT row_id, client_id, 'events' AS source, client_margin FROM px_scored")
def scan_named_sources(spark, sf_dir):
    fields = {k: v for k, v in _FIELDS.items() if k != "source"}
    return _round_trip(_small(spark, sf_dir), writers.write_jsonl, lambda p: readers.read_named(spark, [f"events={p}"], fields).select(*_FIELDS), "named")


@_query("scan_missing_as_empty", _SCORED_ROWS + " WHERE false")
def scan_missing_as_empty(spark, sf_dir):
    return readers.read_jsonl(spark, shared_folder(spark, "missing"), _FIELDS).drop("raw")


@_query("sink_client_partitioned", f"WITH {X.SCORED} SELECT client_id, count(*) AS n FROM px_scored GROUP BY 1")
def sink_client_partitioned(spark, sf_dir):
    return _round_trip(_small(spark, sf_dir), writers.write_clients, lambda p: spark.read.json(p).groupBy(c("client_id").cast("long").alias("client_id")).agg(F.count("*").alias("n")), "clients")


@_query("sink_multi_copy", f"WITH {_BALANCED} SELECT kind, client_id, count(*) AS n FROM b, unnest(['all', 'hard']) t(kind) WHERE kind = 'all' OR level = 'hard' GROUP BY ALL")
def sink_multi_copy(spark, sf_dir):
    rows = _levels(spark, sf_dir).select("client_id", "row_id", "level", "rn")

    def read(p):
        parts = [spark.read.json(f"{p}/{k}").select(F.lit(k).alias("kind"), c("client_id").cast("long").alias("client_id")) for k in ("all", "hard")]
        return parts[0].unionByName(parts[1]).groupBy("kind", "client_id").agg(F.count("*").alias("n"))

    return _round_trip(rows, writers.write_pools, read, "pools")


@_query("sink_json_stats", f"WITH {X.SCORED} SELECT source, count(*) AS num_rows, count(*) FILTER (client_margin_valid = false) AS num_invalid FROM px_scored GROUP BY 1")
def sink_json_stats(spark, sf_dir):
    stats = G.score_summary(X.scored(spark, sf_dir)).drop("mean_margin")
    return _round_trip(stats, writers.write_stats, lambda p: spark.read.schema("source string, num_rows long, num_invalid long").json(p), "stats")


@_query("sink_sharded_part", f"WITH {X.SCORED}, n AS (SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY client_id) AS n FROM px_scored) SELECT CAST(i // CAST(ceil(n / 4) AS BIGINT) AS INTEGER) AS shard, count(*) AS n FROM n GROUP BY ALL")
def sink_sharded_part(spark, sf_dir):
    from currikit.operators.ranking import shards

    rows = shards(_small(spark, sf_dir), [c("row_id")], 4, by=["client_id"])
    return _round_trip(rows, lambda d, p: writers.write_clients(d, p, ["shard"]), lambda p: spark.read.json(p).groupBy(c("shard").cast("int").alias("shard")).agg(F.count("*").alias("n")), "shards")


@_query("sink_tensor_state", f"WITH {X.STATE} SELECT CASE WHEN key LIKE '%lora_A%' THEN 'A' ELSE 'B' END AS factor, count(DISTINCT key) AS n_tensors, count(*) AS n_values FROM px_state GROUP BY 1")
def sink_tensor_state(spark, sf_dir):
    return _round_trip(X.global_state(spark, sf_dir), writers.write_state, lambda p: spark.read.schema("factor string, n_tensors long, n_values long").json(f"{p}/meta"), "state")


@_query("scan_tensor_state", f"WITH {X.STATE} SELECT key, pos, value FROM px_state")
def scan_tensor_state(spark, sf_dir):
    return _round_trip(X.global_state(spark, sf_dir), writers.write_state, lambda p: readers.read_state(spark, p), "state")


@_query("scan_json_document", "SELECT 0.25e0 AS margin, 3 AS missing")
def scan_json_document(spark, sf_dir):
    path = shared_folder(spark, "document")
    spark.range(1).select(F.lit('{"margin": 0.25}').alias("value")).coalesce(1).write.text(path)
    found = readers.read_json_document(spark, path)
    gone = readers.read_json_document(spark, path + "-gone", {"n": 3})
    return spark.createDataFrame([(found["margin"], gone["n"])], "margin double, missing int")


@_query("scan_dataset_split", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND source <> 'src3'")
def scan_dataset_split(spark, sf_dir):
    """Partitions by language and split, read by pruning."""
    rows = X.documents(spark, sf_dir).select("doc_id", "lang", F.when(c("source") != "src3", "train").otherwise("test").alias("split"))
    return _round_trip(rows, lambda d, p: d.write.partitionBy("lang", "split").parquet(p), lambda p: readers.read_split(spark, p, ["de", "fr"], "train").select("doc_id", "lang"), "dataset")


@_query("scan_client_map", "SELECT * FROM (VALUES (0, '/a'), (3, '/b:c')) t(client_id, path)")
def scan_client_map(spark, sf_dir):
    return spark.createDataFrame(sorted(readers.parse_client_map("0:/a, ,3:/b:c").items()), "client_id int, path string")


@_query("resolve_partition_path", "SELECT * FROM (VALUES (0, '/client_0'), (1, '/iter_2/client_1'), (2, '/deep/er/client_2'), (3, '/own'), (4, NULL)) t(client_id, place)")
def resolve_partition_path(spark, sf_dir):
    """Where clients' data are found: the usual places, below the root, or as given."""
    root = shared_folder(spark, "paths")
    for place in ("client_0/dpo_train.jsonl", "iter_2/client_1/dpo_train.jsonl", "own"):
        spark.range(1).select(F.lit("{}").alias("value")).coalesce(1).write.text(f"{root}/{place}")
    spark.range(1).select(F.lit("{}").alias("value")).coalesce(1).write.text(f"{root}/tmp")
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    part = next(s.getPath() for s in fs.listStatus(path(f"{root}/tmp")) if s.getPath().getName().startswith("part"))
    fs.mkdirs(path(f"{root}/deep/er/client_2"))
    fs.rename(part, path(f"{root}/deep/er/client_2/dpo_train.jsonl"))
    found = [readers.resolve_client_path(spark, root, k, 2, {3: "own"}) for k in range(5)]
    end = root.rpartition("/")[2]
    rows = [(k, None if p is None else p.partition(end)[2].removesuffix("/dpo_train.jsonl")) for k, p in enumerate(found)]
    return spark.createDataFrame(rows, "client_id int, place string")


@_query("resolve_client_dir", "SELECT 'second' AS found")
def resolve_client_dir(spark, sf_dir):
    root = shared_folder(spark, "dirs")
    spark.range(1).write.parquet(f"{root}/second")
    found = readers.first_existing(spark, [f"{root}/first", f"{root}/second", f"{root}/third"])
    return spark.createDataFrame([(found.rpartition("/")[2],)], "found string")


@_query("parse_language_list", "SELECT * FROM (VALUES (0, 'go'), (1, 'java'), (2, 'javascript'), (3, 'php'), (4, 'python'), (5, 'ruby'), (10, 'go'), (11, 'php')) t(i, lang)")
def parse_language_list(spark, sf_dir):
    rows = [*enumerate(T.language_list("all")), *((10 + i, x) for i, x in enumerate(T.language_list("go, php")))]
    return spark.createDataFrame(rows, "i int, lang string")


@_query("scan_training_blend", "SELECT least(100, 2 * count(*)) AS n FROM documents")
def scan_training_blend(spark, sf_dir):
    d = X.documents(spark, sf_dir).select("doc_id")
    return readers.blend(spark, [d, d], 100).agg(F.count("*").alias("n"))


@_query("sink_mapping_file", "SELECT string_agg(client_id || ':/out/client_' || client_id, ',' ORDER BY client_id) AS mapping FROM (SELECT DISTINCT user_id % 7 AS client_id FROM events)")
def sink_mapping_file(spark, sf_dir):
    clients = X.scored(spark, sf_dir).select("client_id").distinct().withColumn("path", F.concat(F.lit("/out/client_"), c("client_id").cast("string")))
    return writers.mapping_text(clients)


@_query("copy_first_available", "SELECT lang AS name, min_by(source, doc_id) AS src FROM documents GROUP BY 1")
def copy_first_available(spark, sf_dir):
    return writers.first_available(X.documents(spark, sf_dir).select(c("lang").alias("name"), c("source").alias("src"), c("doc_id").alias("priority")))


@_query("join_zip_outputs", "SELECT doc_id, -length(text) / 100e0 AS logprob, lang FROM documents")
def join_zip_outputs(spark, sf_dir):
    """A model's outputs meet their rows by id, not by position."""
    d = X.documents(spark, sf_dir)
    return G.with_model(d.select("doc_id", "text"), _length_model, "doc_id long, logprob double").join(d.select("doc_id", "lang"), "doc_id")


@_query("join_client_inputs", "SELECT client_id, path, n FROM (SELECT user_id % 7 AS client_id, count(*) AS n FROM events GROUP BY 1) JOIN (VALUES (0, '/a'), (2, '/b')) t(client_id, path) USING (client_id)")
def join_client_inputs(spark, sf_dir):
    """Clients with data; those without a path are left out."""
    paths = spark.createDataFrame(sorted(readers.parse_client_map("0:/a,2:/b,9:/c").items()), "client_id long, path string")
    return X.scored(spark, sf_dir).groupBy("client_id").agg(F.count("*").alias("n")).join(paths, "client_id").select("client_id", "path", "n")


@_query("join_weights", f"WITH {X.TENSORS}, {_W} SELECT key, pos, round(sum(value * w), 6) + 0e0 AS value FROM px_tensor JOIN w USING (client_id) GROUP BY ALL")
def join_weights(spark, sf_dir):
    return A.weighted_sum(X.tensors(spark, sf_dir), A.client_weights(X.samples(spark, sf_dir))).withColumn("value", F.round("value", 6) + 0.0)


@_query("join_scalar_threshold", f"WITH {X.SCORED}, q AS (SELECT client_id, avg(client_margin) AS m FROM px_scored GROUP BY 1) SELECT row_id FROM px_scored JOIN q USING (client_id) WHERE client_margin > m")
def join_scalar_threshold(spark, sf_dir):
    rows = X.scored(spark, sf_dir)
    return rows.join(rows.groupBy("client_id").agg(F.avg("client_margin").alias("m")), "client_id").where("client_margin > m").select("row_id")


@_query("union_languages", "SELECT lang, doc_id FROM documents")
def union_languages(spark, sf_dir):
    d = X.documents(spark, sf_dir).select("lang", "doc_id")
    parts = [d.where(c("lang") == x) for x in ("en", "fr", "de", "es")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@_query("union_buckets", f"WITH {_BALANCED} SELECT client_id, row_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY rn) AS INTEGER) AS place FROM b")
def union_buckets(spark, sf_dir):
    """Easy, medium and hard rows of a client one after the other."""
    from currikit.operators.ranking import ranked

    return ranked(_levels(spark, sf_dir), ["client_id"], [T.level_id(c("level")), c("rn")], "place").select("client_id", "row_id", "place")


@_query("union_selected", Q._oracle_budget(Q._COUNT, 2).replace(f"SELECT {Q._SHOW} FROM fin", "SELECT client_id, row_id, origin FROM fin"))
def union_selected(spark, sf_dir):
    out = S.select_curriculum(Q._pool(spark, sf_dir, 2), Q._COUNT)
    return out.where("origin = 'local'").unionByName(out.where("origin = 'public'")).select("client_id", "row_id", "origin")


@_query("ctl_stage_range", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def ctl_stage_range(spark, sf_dir):
    """Stages by range: the second run starts at the second stage and reads the first one's table."""
    from currikit.plans.rounds import run_stages

    folder = shared_folder(spark, "stages")
    stages = [("rows", lambda t: X.documents(spark, sf_dir).select("lang")), ("counts", lambda t: t["rows"].groupBy("lang").agg(F.count("*").alias("n")))]
    run_stages(spark, stages, folder, end=0)
    return run_stages(spark, stages, folder, start=1)["counts"]


@_query("ctl_stage_config", "SELECT * FROM (VALUES (1, 60, 0.5e0, false, 2), (2, 80, -1e0, false, 4), (3, 80, -1e0, true, 5)) t(round, target, max_public_ratio, gate_hard, n_sources)")
def ctl_stage_config(spark, sf_dir):
    rows = [(k, r.target, r.max_public_ratio, r.gate_hard, len(Q.ROUND_SOURCES[k])) for k, r in ((1, Q.ROUND_1), (2, Q.ROUND_2), (3, Q.ROUND_3))]
    return spark.createDataFrame(rows, "round int, target int, max_public_ratio double, gate_hard boolean, n_sources int")


@_query("ctl_preflight", "SELECT * FROM (VALUES ('documents', true), ('absent', false)) t(name, there)")
def ctl_preflight(spark, sf_dir):
    return spark.createDataFrame([(n, readers.path_exists(spark, f"{sf_dir}/{n}.parquet")) for n in ("documents", "absent")], "name string, there boolean")
