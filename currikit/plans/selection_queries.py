"""Queries for margins, gates, budgets, ranks, sampling and set operations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from currikit.functions import margins as M
from currikit.functions import text as T
from currikit.operators import ranking as R
from currikit.operators import selection as S
from currikit.plans import duck as D
from currikit.plans import proxies as X
from currikit.sources.readers import parse_lines, typed, union_sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FIELDS = ("client_margin", "reward_gap")
ROUND_1 = S.Config(60, FIELDS, max_public_ratio=0.5, drop_truncated=True, dedup=True, seed=20260520)
ROUND_2 = S.Config(80, FIELDS, drop_truncated=True, dedup=True, seed=20260521)
ROUND_3 = S.Config(80, FIELDS, drop_truncated=True, dedup=True, gate_hard=True, seed=20260522)
ROUND_SOURCES = {1: ("local_easy", "public_easy"), 2: ("local_easy", "public_easy", "local_medium", "public_medium"), 3: ("local_easy", "public_easy", "local_medium", "public_medium", "local_hard")}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _expr(name: str, column, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: X.scored(spark, sf_dir).select("row_id", column().alias("value"))
    ORACLES[name] = f"WITH {X.SCORED} SELECT row_id, {sql} AS value FROM px_scored"


c = F.col
_P1, _P2 = D.probability("client_margin"), D.probability("reward_gap")
_POOL = D.pooled(_P1, _P2)
_expr("fn_margin_to_prob", lambda: M.margin_to_probability(c("client_margin")), _P1)
_expr("fn_bayes_pool", lambda: M.bayes_pool([M.margin_to_probability(c(x)) for x in FIELDS]), _POOL)
_expr("fn_clamp", lambda: M.clamp(c("client_margin"), -0.2, 0.3), "greatest(-2e-1, least(3e-1, client_margin))")
_expr("fn_difficulty_of_source", lambda: T.difficulty_of_source(F.when(c("row_id") % 9 == 0, "other").otherwise(c("source"))), "CASE WHEN row_id % 9 = 0 THEN 'unknown' ELSE regexp_extract(source, '_(.*)', 1) END")
_expr("fn_origin_of_source", lambda: T.origin_of_source(c("source")), "CASE WHEN source LIKE 'public~_%' ESCAPE '~' THEN 'public' ELSE 'local' END")
_expr("fn_get_margin", lambda: M.get_margin({"reward_gap": c("reward_gap"), "client_margin": F.when(c("row_id") % 3 == 0, F.lit("nan")).when(c("row_id") % 3 == 1, F.lit("x")).otherwise(c("client_margin").cast("string"))}, c("client_margin_valid")), "CASE WHEN client_margin_valid IS DISTINCT FROM false THEN CASE WHEN row_id % 3 = 2 THEN client_margin ELSE reward_gap END END")
_expr("fn_margin_sources", lambda: F.size(M.margin_sources({"client_margin": c("client_margin"), "reward_gap": F.when(c("source") != "local_hard", c("reward_gap"))})), "CASE WHEN source <> 'local_hard' THEN 2 ELSE 1 END")
_expr("fn_safe_float", lambda: M.safe_float(F.when(c("row_id") % 4 == 0, "true").when(c("row_id") % 4 == 1, "inf").when(c("row_id") % 4 == 2, "-1.5e1").otherwise("?")), "CASE row_id % 4 WHEN 2 THEN -15e0 END")
_expr("fn_score_margin", lambda: M.score_margin(c("client_margin"), M.bayes_pool([M.margin_to_probability(c(x)) for x in FIELDS])), _POOL)
_expr("fn_score_margin_boundary", lambda: F.round(M.score_margin(c("client_margin"), F.lit(None).cast("double"), "boundary"), 9), "round(exp(-abs(client_margin) / 25e-2), 9)")
_expr("fn_score_margin_reliability", lambda: F.round(M.score_margin(c("client_margin"), M.bayes_pool([M.margin_to_probability(c(x)) for x in FIELDS]), "reliability_boundary"), 9), f"round(exp(-abs(client_margin) / 25e-2) * greatest(0e0, ({_POOL}) - 5e-1) / 5e-1, 9) + 0e0")
_expr("fn_instability", lambda: F.round(M.instability(c("client_margin"), F.abs(c("reward_gap"))), 9), "round(greatest(0e0, -client_margin) + greatest(0e0, 5e-1 - abs(reward_gap)), 9) + 0e0")
_expr("fn_dpo_margin", lambda: M.dpo_margin(c("client_margin"), c("reward_gap"), c("reward_gap") * 2, c("client_margin")), "1e-1 * ((client_margin - reward_gap) - (reward_gap * 2 - client_margin))")
_expr("fn_token_logprob", lambda: M.token_logprob(F.when(c("row_id") % 3 == 0, F.create_map(F.lit("7"), c("client_margin"))).otherwise(F.create_map(F.lit("7"), c("client_margin"), F.lit("8"), c("reward_gap"))), F.when(c("row_id") % 2 == 0, 8).otherwise(9)), "CASE WHEN row_id % 3 = 0 THEN client_margin WHEN row_id % 2 = 0 THEN reward_gap END")
_expr("proj_prefixed_seed", lambda: F.lit(20260520) + c("client_id"), "20260520 + client_id")

for _name, _column, _sql in (
    ("flt_margin_present", lambda: M.get_margin({x: c(x) for x in FIELDS}, c("client_margin_valid")).isNotNull(), "client_margin_valid IS DISTINCT FROM false"),
    ("flt_min_sources", lambda: F.size(M.margin_sources({"a": c("client_margin"), "b": F.when(c("source") != "local_hard", c("reward_gap"))})) >= 2, "source <> 'local_hard'"),
    ("flt_min_margin", lambda: c("client_margin") >= 0.1, "client_margin >= 1e-1"),
    ("flt_drop_truncated", lambda: ~c("client_truncated").eqNullSafe(F.lit(True)), "NOT client_truncated"),
    ("flt_drop_invalid", lambda: F.coalesce("client_margin_valid", F.lit(True)), "client_margin_valid IS DISTINCT FROM false"),
):
    QUERIES[_name] = lambda spark, sf_dir, keep=_column: X.scored(spark, sf_dir).where(keep()).select("row_id", "client_id")
    ORACLES[_name] = f"WITH {X.SCORED} SELECT row_id, client_id FROM px_scored WHERE {_sql}"


def _pool(spark, sf_dir, round_: int):
    return X.scored(spark, sf_dir).where(c("source").isin(*ROUND_SOURCES[round_]))


def _prepared(round_: int | None = None, truncated: bool = True) -> str:
    sources = f"source IN ({', '.join(map(D.lit, ROUND_SOURCES[round_]))})" if round_ else "true"
    return f"""{X.SCORED}, prep AS (SELECT *, client_margin AS margin_, {_POOL} AS score, CASE WHEN source LIKE 'public%' THEN 'public' ELSE 'local' END AS origin,
  regexp_extract(source, '_(.*)', 1) AS difficulty FROM px_scored WHERE client_margin_valid IS DISTINCT FROM false AND {sources}{' AND NOT client_truncated' if truncated else ''})"""


def _order(seed: int) -> str:
    return f"score DESC, {D.seeded(str(seed), 'row_id')}, row_id"


def _gated(source: str, q: str = "5e-1") -> str:
    return f"""hard AS (SELECT client_id, list_sort(list(score)) AS s FROM {source} WHERE origin = 'local' AND difficulty <> 'hard' GROUP BY client_id),
gated AS (SELECT p.*, s[1 + CAST(round_even((len(s) - 1) * {q}, 0) AS BIGINT)] AS hard_threshold FROM {source} p LEFT JOIN hard USING (client_id) WHERE difficulty <> 'hard' OR s IS NULL OR score >= s[1 + CAST(round_even((len(s) - 1) * {q}, 0) AS BIGINT)])"""


def _budget(source: str, config: S.Config) -> str:
    t, order = config.target, _order(config.seed)
    room = f"greatest(0, {t} - n_local)"
    if config.max_public_ratio >= 0:
        room = f"least({room}, {int(t * config.max_public_ratio)})"
    if config.max_public_count >= 0:
        room = f"least({room}, {config.max_public_count})"
    return f"""loc AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {order}) AS rn FROM {source} WHERE origin = 'local' QUALIFY rn <= {t}),
thr AS (SELECT client_id, count(*) AS n_local, list_sort(list(score)) AS s FROM loc GROUP BY client_id),
cut AS (SELECT client_id, n_local, s[1 + CAST(round_even((len(s) - 1) * {config.public_quantile}, 0) AS BIGINT)] AS threshold FROM thr),
pub AS (SELECT p.*, row_number() OVER (PARTITION BY p.client_id ORDER BY {order}) AS rn, coalesce(cut.n_local, 0) AS n_local FROM {source} p LEFT JOIN cut USING (client_id) WHERE origin = 'public' AND (cut.threshold IS NULL OR score >= cut.threshold)),
sel AS (SELECT loc.*, rn AS pos FROM loc UNION ALL BY NAME SELECT * EXCLUDE (n_local), n_local + rn AS pos FROM pub WHERE rn <= {room}),
fin AS (SELECT sel.*, cut.threshold AS public_threshold FROM sel LEFT JOIN cut USING (client_id))"""


_SHOW = "client_id, row_id, source, score, public_threshold, pos"


def _show(df):
    return df.select("client_id", "row_id", "source", "score", "public_threshold", F.col("pos").cast("long").alias("pos"))


def _oracle_budget(config: S.Config, round_: int, dedup: bool = False) -> str:
    rows, gate = "prep", ""
    if config.gate_hard:
        rows, gate = "gated", ", " + _gated("prep")
    last = "fin" if not dedup else "(SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY client_id, query ORDER BY pos) = 1)"
    return f"WITH {_prepared(round_, config.drop_truncated)}{gate}, {_budget(rows, config)} SELECT {_SHOW} FROM {last}"


@_query("win_public_fill", _oracle_budget(ROUND_2, 2))
def win_public_fill(spark, sf_dir):
    """The flagship: every client's round-2 curriculum in one job."""
    return _show(S.select_curriculum(_pool(spark, sf_dir, 2), replace(ROUND_2, dedup=False)))


@_query("curriculum_round_1", _oracle_budget(ROUND_1, 1, True))
def curriculum_round_1(spark, sf_dir):
    return _show(S.select_curriculum(_pool(spark, sf_dir, 1), ROUND_1, ["query"]))


@_query("curriculum_round_2", _oracle_budget(ROUND_2, 2, True))
def curriculum_round_2(spark, sf_dir):
    return _show(S.select_curriculum(_pool(spark, sf_dir, 2), ROUND_2, ["query"]))


@_query("curriculum_round_3", _oracle_budget(ROUND_3, 3, True))
def curriculum_round_3(spark, sf_dir):
    return _show(S.select_curriculum(_pool(spark, sf_dir, 3), ROUND_3, ["query"]))


_COUNT = replace(ROUND_2, max_public_count=5, dedup=False)


@_query("win_public_count", _oracle_budget(_COUNT, 2))
def win_public_count(spark, sf_dir):
    return _show(S.select_curriculum(_pool(spark, sf_dir, 2), _COUNT))


@_query("win_local_budget", f"WITH {_prepared(3, False)} SELECT client_id, row_id, score FROM prep WHERE origin = 'local' QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY {_order(42)}) <= 30")
def win_local_budget(spark, sf_dir):
    rows = S.prepare(_pool(spark, sf_dir, 3), S.Config(30, FIELDS)).where("origin = 'local'")
    return R.top_k(rows, ["client_id"], R.best_first("score", "row_id", 42), 30).select("client_id", "row_id", "score")


@_query("flt_hard_gate", f"WITH {_prepared(3, False)}, {_gated('prep')} SELECT client_id, row_id, hard_threshold FROM gated")
def flt_hard_gate(spark, sf_dir):
    return S.hard_gate(S.prepare(_pool(spark, sf_dir, 3), S.Config(30, FIELDS)), 0.5).select("client_id", "row_id", "hard_threshold")


@_query("flt_public_threshold", f"WITH {_prepared(2)}, {_budget('prep', ROUND_2)} SELECT p.client_id, p.row_id FROM prep p JOIN cut USING (client_id) WHERE p.origin = 'public' AND p.score >= cut.threshold")
def flt_public_threshold(spark, sf_dir):
    rows = S.prepare(_pool(spark, sf_dir, 2), ROUND_2)
    local = R.top_k(rows.where("origin = 'local'"), ["client_id"], R.best_first("score", "row_id", ROUND_2.seed), ROUND_2.target)
    thresholds = R.nearest_quantile(local, ["client_id"], "score", 0.25)
    return rows.where("origin = 'public'").join(thresholds, "client_id").where("score >= threshold").select("client_id", "row_id")


_MIXED = S.Config(60, FIELDS, max_local_ratio=0.4, seed=7)


@_query(
    "win_mixed_cap",
    f"""WITH {_prepared(None, False)}, r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {_order(7)}) AS r, row_number() OVER (PARTITION BY client_id, origin ORDER BY {_order(7)}) AS ro FROM prep),
adm AS (SELECT client_id, row_id, row_number() OVER (PARTITION BY client_id ORDER BY r) AS a FROM r WHERE origin <> 'local' OR ro <= 24),
ph AS (SELECT r.*, CASE WHEN a <= 60 THEN 1 ELSE 2 END AS phase FROM r LEFT JOIN adm USING (client_id, row_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY phase, r) AS pos FROM ph)
SELECT client_id, row_id, phase, pos FROM o WHERE pos <= 60""",
)
def win_mixed_cap(spark, sf_dir):
    return S.select_curriculum(X.scored(spark, sf_dir), _MIXED).select("client_id", "row_id", "phase", F.col("pos").cast("long").alias("pos"))


@_query("win_dedup_first", f"WITH {X.SCORED} SELECT client_id, query, min(row_id) AS row_id FROM px_scored GROUP BY ALL")
def win_dedup_first(spark, sf_dir):
    return S.dedup_first(X.scored(spark, sf_dir), ["query"], order=c("row_id")).select("client_id", "query", "row_id")


@_query(
    "agg_select_stats",
    f"""WITH {_prepared(3)}, {_gated('prep')}, {_budget('gated', ROUND_3)},
d AS (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY client_id, query ORDER BY pos) = 1),
a AS (SELECT client_id, count(*) FILTER (origin = 'local') AS num_available_local, count(*) FILTER (origin = 'public') AS num_available_public FROM gated GROUP BY 1),
s AS (SELECT client_id, count(*) AS num_output, count(*) FILTER (origin = 'local') AS num_selected_local, count(*) FILTER (origin = 'public') AS num_selected_public, count(*) FILTER (margin_ < 0) AS negative_margin_count,
  round(avg(margin_), 6) AS mean_selected_margin, round(avg(score), 6) AS mean_selected_score, max(public_threshold) AS public_score_threshold, max(hard_threshold) AS hard_score_threshold,
  count(*) FILTER (difficulty = 'easy') AS num_easy, count(*) FILTER (difficulty = 'medium') AS num_medium, count(*) FILTER (difficulty = 'hard') AS num_hard FROM d GROUP BY 1)
SELECT * FROM a JOIN s USING (client_id)""",
)
def agg_select_stats(spark, sf_dir):
    rows = S.hard_gate(S.prepare(_pool(spark, sf_dir, 3), ROUND_3), 0.5)
    chosen = S.dedup_first(S.budgeted(rows, ROUND_3), ["query"])
    stats = S.selection_stats(rows, chosen).drop("mean_selected_bees_prob", "mean_selected_bees_source_count")
    return stats.withColumns({k: F.round(k, 6) for k in ("mean_selected_margin", "mean_selected_score")})


@_query("win_quantile_nearest", f"WITH {X.SCORED}, s AS (SELECT client_id, list_sort(list(client_margin)) AS s FROM px_scored GROUP BY 1) SELECT client_id, s[1 + CAST(round_even((len(s) - 1) * 3e-1, 0) AS BIGINT)] AS threshold FROM s")
def win_quantile_nearest(spark, sf_dir):
    return R.nearest_quantile(X.scored(spark, sf_dir), ["client_id"], "client_margin", 0.3)


@_query("win_quantile_linear", f"WITH {X.SCORED} SELECT client_id, round(quantile_cont(client_margin, 3e-1), 9) AS threshold FROM px_scored GROUP BY 1")
def win_quantile_linear(spark, sf_dir):
    return R.linear_quantile(X.scored(spark, sf_dir), ["client_id"], "client_margin", 0.3).withColumn("threshold", F.round("threshold", 9))


@_query("win_shard", f"WITH {X.SCORED}, n AS (SELECT client_id, row_id, row_number() OVER (PARTITION BY client_id ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY client_id) AS n FROM px_scored) SELECT client_id, row_id, CAST(i // CAST(ceil(n / 4) AS BIGINT) AS INTEGER) AS shard FROM n")
def win_shard(spark, sf_dir):
    return R.shards(X.scored(spark, sf_dir), [c("row_id")], 4, by=["client_id"]).select("client_id", "row_id", "shard")


@_query("fn_shard_bounds", f"WITH {X.SCORED}, n AS (SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY client_id) AS n FROM px_scored) SELECT client_id, CAST(i // CAST(ceil(n / 3) AS BIGINT) AS INTEGER) AS shard, min(i) AS first, max(i) AS last FROM n GROUP BY ALL")
def fn_shard_bounds(spark, sf_dir):
    """First and last place of each contiguous shard."""
    numbered = R.ranked(X.scored(spark, sf_dir), ["client_id"], [c("row_id")], "i")
    out = R.shards(numbered, [c("row_id")], 3, by=["client_id"]).groupBy("client_id", "shard")
    return out.agg((F.min("i") - 1).cast("long").alias("first"), (F.max("i") - 1).cast("long").alias("last"))


@_query("win_batch", f"WITH {X.SCORED} SELECT client_id, row_id, CAST((row_number() OVER (PARTITION BY client_id ORDER BY row_id) - 1) // 16 AS INTEGER) AS batch FROM px_scored")
def win_batch(spark, sf_dir):
    return R.batches(X.scored(spark, sf_dir), [c("row_id")], 16, by=["client_id"]).select("client_id", "row_id", "batch")


@_query("win_first_k_per_group", "WITH a AS (SELECT lang, doc_id FROM documents WHERE n_chars > 800 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 20), b AS (SELECT lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 20) SELECT 'after' AS kind, lang, doc_id FROM a UNION ALL SELECT 'before', lang, doc_id FROM b WHERE n_chars > 800")
def win_first_k_per_group(spark, sf_dir):
    d, good = X.documents(spark, sf_dir), c("n_chars") > 800
    after = R.limit_rows(d.where(good), ["lang"], 20, "doc_id").select(F.lit("after").alias("kind"), "lang", "doc_id")
    before = R.limit_rows(d, ["lang"], 20, "doc_id").where(good).select(F.lit("before").alias("kind"), "lang", "doc_id")
    return after.unionByName(before)


@_query("sort_score_desc_random_tie", f"WITH {X.SCORED} SELECT client_id, row_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY reward_gap DESC, {D.seeded('3', 'row_id')}, row_id) AS INTEGER) AS rn FROM px_scored")
def sort_score_desc_random_tie(spark, sf_dir):
    return R.ranked(X.scored(spark, sf_dir), ["client_id"], R.best_first("reward_gap", "row_id", 3)).select("client_id", "row_id", "rn")


@_query("sort_compound", f"WITH {X.METRICS} SELECT client_id, row_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY hardness_score, len_ratio DESC, row_id) AS INTEGER) AS rn FROM px_metrics")
def sort_compound(spark, sf_dir):
    return R.ranked(X.metrics(spark, sf_dir), ["client_id"], [c("hardness_score"), c("len_ratio").desc(), c("row_id")]).select("client_id", "row_id", "rn")


@_query("sort_stable_key", f"WITH {X.METRICS} SELECT client_id, row_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY sim_jacc NULLS FIRST, row_id) AS INTEGER) AS rn FROM px_metrics")
def sort_stable_key(spark, sf_dir):
    return R.ranked(X.metrics(spark, sf_dir), ["client_id"], [c("sim_jacc").asc_nulls_first(), c("row_id")]).select("client_id", "row_id", "rn")


@_query("shuffle_output", f"WITH {X.SCORED} SELECT client_id, row_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY {D.seeded('9', 'row_id')}, row_id) AS INTEGER) AS shuffle_pos FROM px_scored")
def shuffle_output(spark, sf_dir):
    return S.shuffled(X.scored(spark, sf_dir), ["client_id"], "row_id", 9).select("client_id", "row_id", "shuffle_pos")


@_query("limit_rows", f"WITH {X.SCORED} SELECT source, row_id FROM px_scored QUALIFY row_number() OVER (PARTITION BY source ORDER BY {D.seeded('5', 'row_id')}, row_id) <= 25")
def limit_rows(spark, sf_dir):
    return R.limit_rows(X.scored(spark, sf_dir), ["source"], 25, "row_id", 5).select("source", "row_id")


@_query("limit_prefix", f"WITH {X.SCORED} SELECT source, row_id FROM px_scored QUALIFY row_number() OVER (PARTITION BY source ORDER BY row_id) <= 25")
def limit_prefix(spark, sf_dir):
    return R.limit_rows(X.scored(spark, sf_dir), ["source"], 25, "row_id").select("source", "row_id")


@_query("topk_retrieval", f"WITH {X.SCORED}, t AS (SELECT client_id, row_id FROM px_scored QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY reward_gap DESC, row_id) <= 40) SELECT client_id, row_id FROM t QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY {D.seeded('1', 'row_id')}, row_id) <= 10")
def topk_retrieval(spark, sf_dir):
    top = R.top_k(X.scored(spark, sf_dir), ["client_id"], [c("reward_gap").desc(), c("row_id")], 40)
    return R.limit_rows(top, ["client_id"], 10, "row_id", 1).select("client_id", "row_id")


@_query("sample_holdout", f"WITH {X.SCORED}, n AS (SELECT client_id, row_id, row_number() OVER (PARTITION BY client_id ORDER BY {D.seeded('2', 'row_id')}, row_id) AS rn, count(*) OVER (PARTITION BY client_id) AS n FROM px_scored) SELECT client_id, row_id, CASE WHEN rn <= round_even(n * 15e-2, 0) THEN 'public' ELSE 'local' END AS origin FROM n")
def sample_holdout(spark, sf_dir):
    return R.holdout(X.scored(spark, sf_dir), ["client_id"], 0.15, "row_id", 2).select("client_id", "row_id", "origin")


@_query("agg_count_by", f"WITH {X.SCORED} SELECT coalesce(CASE WHEN row_id % 5 > 0 THEN source END, 'unknown') AS source, count(*) AS n FROM px_scored GROUP BY 1")
def agg_count_by(spark, sf_dir):
    return S.count_by(X.scored(spark, sf_dir).withColumn("source", F.when(c("row_id") % 5 > 0, c("source"))), "source")


@_query("agg_mean_nullable", f"WITH {X.SCORED} SELECT client_id, round(avg(CASE WHEN client_id <> 3 THEN client_margin END), 6) AS mean_margin FROM px_scored GROUP BY 1")
def agg_mean_nullable(spark, sf_dir):
    return X.scored(spark, sf_dir).groupBy("client_id").agg(F.round(F.avg(F.when(c("client_id") != 3, c("client_margin"))), 6).alias("mean_margin"))


@_query("agg_conditional_count", f"WITH {X.SCORED} SELECT client_id, count(*) FILTER (client_margin < 0) AS n_negative, count(*) FILTER (client_margin_valid = false) AS n_invalid, count(*) FILTER (client_truncated) AS n_truncated FROM px_scored GROUP BY 1")
def agg_conditional_count(spark, sf_dir):
    return X.scored(spark, sf_dir).groupBy("client_id").agg(F.count_if(c("client_margin") < 0).alias("n_negative"), F.count_if(~c("client_margin_valid")).alias("n_invalid"), F.count_if("client_truncated").alias("n_truncated"))


@_query("agg_build_stats", "SELECT coalesce(lang, 'total') AS lang, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def agg_build_stats(spark, sf_dir):
    return X.documents(spark, sf_dir).rollup("lang").agg(F.count("*").alias("n")).select(F.coalesce("lang", F.lit("total")).alias("lang"), "n")


@_query("agg_bayes_product", f"WITH {X.SCORED} SELECT query, client_id, CAST(count(*) AS BIGINT) AS n, round(product(p) / nullif(product(p) + product(1 - p), 0), 6) AS pooled FROM (SELECT *, {_P1} AS p FROM px_scored) GROUP BY ALL")
def agg_bayes_product(spark, sf_dir):
    p = M.margin_to_probability(c("client_margin"))
    out = X.scored(spark, sf_dir).withColumn("p", p).groupBy("query", "client_id").agg(F.count("*").alias("n"), F.product("p").alias("yes"), F.product(1.0 - c("p")).alias("no"))
    return out.select("query", "client_id", "n", F.round(F.try_divide(c("yes"), c("yes") + c("no")), 6).alias("pooled"))


@_query("agg_unique_count", "SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY 1")
def agg_unique_count(spark, sf_dir):
    return X.documents(spark, sf_dir).groupBy("lang").agg(F.count_distinct("source").alias("n"))


@_query("union_sources", f"WITH {X.SCORED} SELECT source, row_id, client_margin, CASE WHEN source = 'local_easy' THEN reward_gap END AS reward_gap FROM px_scored WHERE source IN ('local_easy', 'public_easy')")
def union_sources_(spark, sf_dir):
    rows = X.scored(spark, sf_dir)
    parts = {"local_easy": rows.where("source = 'local_easy'").select("row_id", "client_margin", "reward_gap"), "public_easy": rows.where("source = 'public_easy'").select("client_margin", "row_id")}
    return union_sources(parts).select("source", "row_id", "client_margin", "reward_gap")


@_query("semi_anti_leftover", f"WITH {X.SCORED} SELECT client_id, row_id FROM px_scored WHERE row_id NOT IN (SELECT row_id FROM px_scored QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY client_margin DESC, row_id) <= 25)")
def semi_anti_leftover(spark, sf_dir):
    """Rows that a first choice left over."""
    rows = X.scored(spark, sf_dir)
    taken = R.top_k(rows, ["client_id"], [c("client_margin").desc(), c("row_id")], 25).select("row_id")
    return rows.join(taken, "row_id", "left_anti").select("client_id", "row_id")


@_query("set_except_selected", f"WITH {_prepared(2)}, {_budget('prep', ROUND_2)} SELECT client_id, row_id FROM prep WHERE row_id NOT IN (SELECT row_id FROM fin)")
def set_except_selected(spark, sf_dir):
    pool = _pool(spark, sf_dir, 2)
    chosen = S.select_curriculum(pool, replace(ROUND_2, dedup=False)).select("row_id")
    return S.prepare(pool, ROUND_2).join(chosen, "row_id", "left_anti").select("client_id", "row_id")


@_query("semi_seen_keys", f"WITH {X.SCORED} SELECT DISTINCT query FROM px_scored WHERE query IN (SELECT query FROM px_scored WHERE source = 'public_easy')")
def semi_seen_keys(spark, sf_dir):
    rows = X.scored(spark, sf_dir)
    return rows.select("query").distinct().join(rows.where("source = 'public_easy'").select("query").distinct(), "query", "left_semi")


@_query("distinct_text", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def distinct_text(spark, sf_dir):
    return X.documents(spark, sf_dir).groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@_query("proj_training_columns", f"WITH {X.PAIRS} SELECT row_id, query, chosen FROM px_pair")
def proj_training_columns(spark, sf_dir):
    return S.training_rows(X.pairs(spark, sf_dir), ["row_id"])


@_query("proj_passthrough_extend", f"WITH {X.SCORED} SELECT *, CAST(row_id AS VARCHAR) || '/' || source AS tag FROM px_scored")
def proj_passthrough_extend(spark, sf_dir):
    return X.scored(spark, sf_dir).withColumn("tag", F.concat_ws("/", c("row_id").cast("string"), "source"))


@_query("scan_jsonl_lenient", "SELECT event_type, count(*) FILTER (event_id % 10 NOT IN (0, 1)) AS rows, count(*) FILTER (event_id % 10 = 1) AS bad_lines FROM events GROUP BY 1")
def scan_jsonl_lenient(spark, sf_dir):
    lines = parse_lines(X.raw_lines(spark, sf_dir), keep=["event_type"])
    return lines.groupBy("event_type").agg(F.count_if(~c("bad")).alias("rows"), F.count_if("bad").alias("bad_lines"))


@_query("scan_jsonl_strict", "SELECT event_id AS id, CASE event_id % 10 WHEN 3 THEN 25e-2 WHEN 4 THEN 1e0 WHEN 5 THEN NULL ELSE CAST(trunc(value) AS DOUBLE) END AS margin FROM events WHERE event_id % 10 > 2")
def scan_jsonl_strict(spark, sf_dir):
    """Objects only, with typed fields; other values are dropped."""
    parsed = parse_lines(X.raw_lines(spark, sf_dir).where(~c("value").endswith("0") | c("value").endswith("}")))
    objects = parsed.where(c("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    return typed(objects, {"id": "long", "margin": "double"}).drop("raw")
