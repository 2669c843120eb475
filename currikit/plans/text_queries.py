"""Queries for cleaning, predicates, projections and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from currikit.functions import similarity as S
from currikit.functions import text as T
from currikit.operators import pairs as P
from currikit.operators import pools
from currikit.plans import duck as D
from currikit.plans import proxies as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# A document dressed up so that every cleaning rule has something to do.
def dressed_text():
    return F.concat(F.lit("  /** # "), F.translate("text", ".", "\n"), F.lit(" \u00a0```py x```\n\n\n\n * end. "), F.col("source"), F.lit(" */ "))


DRESSED_SQL = "('  /** # ' || translate(text, '.', chr(10)) || ' ' || chr(160) || '```py x```' || chr(10) || chr(10) || chr(10) || chr(10) || ' * end. ' || source || ' */ ')"


def _scalar(name: str, column, sql: str, dressed: bool = False) -> None:
    def run(spark, sf_dir):
        d = X.documents(spark, sf_dir).select("doc_id", (dressed_text() if dressed else F.col("text")).alias("x"), "lang", "source")
        return d.select("doc_id", column(F.col("x")).alias("value"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH d AS (SELECT doc_id, {DRESSED_SQL if dressed else 'text'} AS x, lang, source FROM documents) SELECT doc_id, {sql} AS value FROM d"


_scalar("fn_normalize_text", lambda x: T.normalize_text(x), D.normalize("x"), True)
_scalar("fn_clean_docstring", lambda x: T.clean_docstring(x), D.clean("x"), True)
_scalar("fn_token_len", lambda x: T.token_len(x), D.token_len("x"))
_scalar("fn_word_tokens", lambda x: F.concat_ws(" ", T.word_tokens(x)), f"array_to_string({D.words('x')}, ' ')")
_scalar("fn_code_like_ratio", lambda x: T.code_like_ratio(x), f"(SELECT {D.code_ratio('n')} FROM (SELECT {D.normalize('x')} AS n))")
_scalar("fn_field_tokens", lambda x: F.concat_ws(" ", T.field_tokens(F.when(F.col("doc_id") % 2 == 0, F.split(x, " ")), x)), f"array_to_string(CASE WHEN doc_id % 2 = 0 THEN list_filter(list_transform(string_split(x, ' '), lambda w: lower({D.normalize('w')})), lambda w: w <> '') ELSE {D.words('x')} END, ' ')")
_scalar("fn_first_nonblank", lambda x: T.first_nonblank(F.when(F.col("doc_id") % 3 == 0, F.lit(" \n")).when(F.col("doc_id") % 3 == 1, F.col("lang")), F.col("source")), f"CASE WHEN doc_id % 3 = 1 THEN lang ELSE {D.strip('source')} END")
_scalar("fn_synthetic_candidates", lambda x: F.concat_ws(" / ", T.synthetic_candidates(F.concat_ws(" ", F.lit("It returns what create makes. Creates"), F.substring(x, 1, 60)))), "0")
ORACLES["fn_synthetic_candidates"] = f"WITH d AS (SELECT doc_id, {D.clean(D.lit('It returns what create makes. Creates ') + ' || substring(text, 1, 60)')} AS c FROM documents), e AS (SELECT doc_id, c, list_filter(regexp_split_to_array(c, {D.lit(T.WS + '+')}), lambda w: w <> '') AS w FROM d) SELECT doc_id, regexp_replace(c, 'returns', 'validates') || ' / ' || regexp_replace(c, 'create', 'deletes') || ' / ' || array_to_string(list_concat(w[1:len(w) - 2], [w[len(w)], w[len(w) - 1]]), ' ') AS value FROM e"
_scalar("fn_truncate_middle", lambda x: F.concat_ws(" ", T.truncate_middle(F.split(x, " "), (F.col("doc_id") % 40 + 10).cast("int"))), "0")
ORACLES["fn_truncate_middle"] = f"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS t, doc_id % 40 + 10 AS b FROM documents),
h AS (SELECT *, greatest(8, CAST(floor(b * 65e-2) AS BIGINT)) AS h FROM d), e AS (SELECT *, CASE WHEN h + greatest(8, b - h) > b THEN greatest(1, b - h) ELSE greatest(8, b - h) END AS k FROM h)
SELECT doc_id, array_to_string(CASE WHEN len(t) <= b THEN t WHEN b <= 16 THEN t[1:b] ELSE list_concat(t[1:h], [{D.lit(T.TRUNCATED)}], t[len(t) - k + 1:len(t)]) END, ' ') AS value FROM e"""
_scalar("fn_prompt_budget_fit", lambda x: T.fit_budget(F.size(F.split(x, " ")), (F.col("doc_id") % 100).cast("int"), 256, 8), "0")
ORACLES["fn_prompt_budget_fit"] = """WITH RECURSIVE d AS (SELECT doc_id, len(string_split(text, ' ')) AS n, doc_id % 100 AS o FROM documents),
s AS (SELECT doc_id, n, o, 1 AS k, greatest(32, 256 - o - 16) AS b FROM d WHERE n + o > 256
  UNION ALL SELECT doc_id, n, o, k + 1, greatest(32, CAST(floor(b * 85e-2) AS BIGINT)) FROM s WHERE k < 8 AND NOT (o + CASE WHEN n > b THEN b + 8 ELSE n END <= 256 OR b <= 32)),
f AS (SELECT doc_id, max_by(b, k) AS value FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(f.value AS INTEGER) AS value FROM d LEFT JOIN f USING (doc_id)"""
_scalar("fn_parse_csv_list", lambda x: F.concat_ws("/", T.csv_list(F.concat_ws(" , ", F.lit(""), "source", F.lit(""), "lang"))), "source || '/' || lang")
_scalar("fn_suffix_marker", lambda x: T.suffix_from_marker(F.concat(F.lit("base.model."), F.when(F.col("doc_id") % 4 == 0, "layers.1.lora_A.w").when(F.col("doc_id") % 4 == 1, "norm.x").when(F.col("doc_id") % 4 == 2, "a.lora_B.w").otherwise("none"))), "CASE doc_id % 4 WHEN 0 THEN 'layers.1.lora_A.w' WHEN 1 THEN 'norm.x' WHEN 2 THEN 'lora_B.w' ELSE 'base.model.none' END")
_KEY_SQL = "CASE doc_id % 3 WHEN 0 THEN 'l.lora_A.w' WHEN 1 THEN 'l.lora_B.w' ELSE 'l.norm' END"


def _key():
    return F.when(F.col("doc_id") % 3 == 0, "l.lora_A.w").when(F.col("doc_id") % 3 == 1, "l.lora_B.w").otherwise("l.norm")


_scalar("fn_is_lora_a", lambda x: T.is_lora_a(_key()), f"{_KEY_SQL} LIKE '%lora~_A%' ESCAPE '~'")
_scalar("fn_is_lora_b", lambda x: T.is_lora_b(_key()), f"{_KEY_SQL} LIKE '%lora~_B%' ESCAPE '~'")
_scalar("fn_parse_ids", lambda x: F.array_join(F.transform(T.csv_list(F.concat_ws(",", F.lit(" 0"), F.lit(""), (F.col("doc_id") % 9).cast("string"))), lambda i: (i.cast("int") + 1).cast("string")), "/"), "'1/' || (doc_id % 9 + 1)")
_scalar("flt_special_tokens", lambda x: T.has_special_tokens(F.concat(F.when(F.col("doc_id") % 5 == 0, "see www.x ").when(F.col("doc_id") % 5 == 1, "<a href> ").otherwise(""), x)), "doc_id % 5 < 2 OR " + D.matches(f"lower({D.normalize('x')})", T.SPECIAL))
_scalar("flt_probably_english", lambda x: T.is_probably_english(x), f"(SELECT {D.english('n')} FROM (SELECT {D.normalize('x')} AS n))")
_scalar("flt_bad_docstring_reason", lambda x: T.bad_docstring_reason(F.concat(F.when(F.col("doc_id") % 6 == 0, "We return x. ").when(F.col("doc_id") % 6 == 1, "I cannot say. ").when(F.col("doc_id") % 6 == 2, "<code>").otherwise(""), F.when(F.col("doc_id") % 17 != 0, x).otherwise(""))), "0")
ORACLES["flt_bad_docstring_reason"] = f"""WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'We return x. ' WHEN 1 THEN 'I cannot say. ' WHEN 2 THEN '<code>' ELSE '' END || CASE WHEN doc_id % 17 <> 0 THEN text ELSE '' END AS t FROM documents),
c AS MATERIALIZED (SELECT doc_id, {D.clean('t')} AS c FROM d) SELECT doc_id, {D.bad_reason('c')} AS value FROM c"""


@_query("flt_codexglue_doc", f"WITH d AS (SELECT doc_id, {D.clean('text')} AS c FROM documents) SELECT doc_id, c AS doc FROM d WHERE len({D.words('c')}) BETWEEN 3 AND 256 AND NOT {D.matches('lower(c)', T.SPECIAL)} AND {D.english('c')}")
def flt_codexglue_doc(spark, sf_dir):
    none = F.lit(None).cast("array<string>")
    cleaned = X.documents(spark, sf_dir).select("doc_id", F.explode(F.array(T.clean_docstring(F.col("text")))).alias("doc"))  # a generator's row is made once, and no filter goes below it
    return cleaned.where(T.is_fit_doc(F.col("doc"), none))


@_query("flt_nonempty_clean", f"WITH d AS (SELECT doc_id, {D.clean("CASE WHEN lang = 'es' THEN chr(9) || chr(10) ELSE text END")} AS c FROM documents) SELECT doc_id FROM d WHERE c <> ''")
def flt_nonempty_clean(spark, sf_dir):
    t = F.when(F.col("lang") == "es", "\t\n").otherwise(F.col("text"))
    return X.documents(spark, sf_dir).where(T.clean_docstring(t) != "").select("doc_id")


@_query("flt_language_in", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def flt_language_in(spark, sf_dir):
    return X.documents(spark, sf_dir).where(F.col("lang").isin(T.language_list("en, de", ["en", "de"]))).select("doc_id", "lang")


@_query("flt_markup_pages", f"SELECT page_id, {D.matches('lower(html)', T.SPECIAL)} AS special FROM pages")
def flt_markup_pages(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", F.rlike(F.lower("html"), F.lit(T.SPECIAL)).alias("special"))


@_query("fn_extract_text", f"SELECT conv_id, {D.strip('min_by(text, turn)')} AS value FROM conversations WHERE role = 'user' GROUP BY conv_id")
def fn_extract_text(spark, sf_dir):
    return X.messages(spark, sf_dir).where(F.exists("messages", lambda m: m["role"] == "user")).select("conv_id", T.extract_text(messages=F.col("messages")).alias("value"))


_PROMPT = " || chr(10) || ".join([*map(D.lit, T.PROMPT), "'Language: ' || lang", "'Function: f' || (doc_id % 20)", "''", "'Code:'", "'```' || lang", D.normalize("text"), "'```'", "''", "'Docstring:'"])


@_query("proj_build_query", f"SELECT doc_id, {_PROMPT} AS value FROM documents")
def proj_build_query(spark, sf_dir):
    name = F.concat(F.lit("f"), (F.col("doc_id") % 20).cast("string"))
    return X.documents(spark, sf_dir).select("doc_id", T.build_query(F.col("text"), name, F.col("lang")).alias("value"))


@_query("proj_chat_template", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<|im_start|>system' || chr(10) || lang || '<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS value FROM documents")
def proj_chat_template(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", T.chat_template(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("value"))


@_query("proj_sample_id", "SELECT doc_id, lang || ':train:' || CASE WHEN doc_id % 3 = 0 THEN '-1' ELSE CAST(doc_id AS VARCHAR) END AS value FROM documents")
def proj_sample_id(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", T.sample_id(F.col("lang"), F.lit("train"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")), F.lit(-1)).alias("value"))


@_query("proj_row_identity", "SELECT repo, path, func_name, id, count(*) AS n FROM (SELECT source AS repo, '' AS path, lang AS func_name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents) GROUP BY ALL")
def proj_row_identity(spark, sf_dir):
    own = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))
    return X.documents(spark, sf_dir).select(T.row_identity(F.col("source"), F.lit(None), F.col("lang"), own).alias("i")).groupBy("i").agg(F.count("*").alias("n")).select("i.*", "n")


@_query("fn_pair_key", f"WITH {X.PAIRS} SELECT chosen, query, reject, count(*) AS n FROM px_pair GROUP BY ALL")
def fn_pair_key(spark, sf_dir):
    keyed = X.pairs(spark, sf_dir).withColumn("k", T.pair_key(F.col("query"), F.col("chosen"), F.col("reject")))
    back = F.from_json("k", "chosen string, query string, rejected string")
    return keyed.groupBy("k").agg(F.count("*").alias("n")).select(back["chosen"].alias("chosen"), back["query"].alias("query"), back["rejected"].alias("reject"), "n")


@_query("fn_jaccard_text", f"WITH {X.PAIRS}, w AS (SELECT row_id, {D.found('lower(chosen)', T.WORD + '+')} AS a, {D.found('lower(reject)', T.WORD + '+')} AS b FROM px_pair WHERE reject IS NOT NULL) SELECT row_id, {D.jaccard('a', 'b')} AS value FROM w")
def fn_jaccard_text(spark, sf_dir):
    return X.pairs(spark, sf_dir).where("reject IS NOT NULL").select("row_id", S.jaccard_text(F.col("chosen"), F.col("reject")).alias("value"))


@_query("fn_jaccard_tokens", f"WITH {X.PAIRS}, w AS (SELECT row_id, string_split(query, ' ') AS a, string_split(chosen, ' ') AS b FROM px_pair) SELECT row_id, {D.jaccard('a', 'b')} AS value FROM w")
def fn_jaccard_tokens(spark, sf_dir):
    return X.pairs(spark, sf_dir).select("row_id", S.jaccard(F.split("query", " "), F.split("chosen", " ")).alias("value"))


@_query("set_intersect_tokens", f"WITH {X.PAIRS} SELECT row_id, CAST(len(list_distinct(list_intersect(string_split(query, ' '), string_split(chosen, ' ')))) AS INTEGER) AS n FROM px_pair")
def set_intersect_tokens(spark, sf_dir):
    return X.pairs(spark, sf_dir).select("row_id", F.size(F.array_intersect(F.split("query", " "), F.split("chosen", " "))).alias("n"))


@_query("set_union_tokens", f"WITH {X.PAIRS} SELECT row_id, CAST(len(list_distinct(list_concat(string_split(query, ' '), string_split(chosen, ' ')))) AS INTEGER) AS n FROM px_pair")
def set_union_tokens(spark, sf_dir):
    return X.pairs(spark, sf_dir).select("row_id", F.size(F.array_union(F.split("query", " "), F.split("chosen", " "))).alias("n"))


@_query("fn_ngrams", f"WITH {X.PAIRS}, w AS (SELECT row_id, string_split(chosen, ' ') AS t FROM px_pair) SELECT row_id, array_to_string(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')), '|') AS value FROM w")
def fn_ngrams(spark, sf_dir):
    return X.pairs(spark, sf_dir).select("row_id", F.array_join(S.ngrams(F.split("chosen", " "), 3), "|").alias("value"))


_BLEU = f"""WITH {X.PAIRS}, t AS (SELECT row_id, {D.words('chosen')} AS ref, {D.words('reject')} AS pred FROM px_pair WHERE reject IS NOT NULL),
g AS (SELECT row_id, n, side, array_to_string(ts[i:i + n - 1], ' ') AS gram FROM (SELECT row_id, 'r' AS side, ref AS ts FROM t UNION ALL SELECT row_id, 'p', pred FROM t), range(1, 5) a(n), unnest(range(1, greatest(1, len(ts) - n + 2))) b(i) WHERE i + n - 1 <= len(ts)),
c AS (SELECT row_id, n, gram, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'p') AS p FROM g GROUP BY ALL),
o AS (SELECT row_id, n, CAST(sum(least(r, p)) AS BIGINT) AS overlap, CAST(sum(p) AS BIGINT) AS total FROM c GROUP BY ALL)"""


@_query("agg_ngram_multiset", _BLEU + " SELECT row_id, CAST(n AS INTEGER) AS n, overlap, total FROM o WHERE total > 0")
def agg_ngram_multiset(spark, sf_dir):
    return S.ngram_overlap(_tokens(spark, sf_dir), "row_id", "ref", "pred")


@_query("fn_smoothed_bleu", _BLEU + """, s AS (SELECT t.row_id, ref, pred, (SELECT sum(ln((coalesce(o.overlap, 0) + 1e0) / (greatest(1, coalesce(o.total, 0)) + 1e0))) FROM range(1, 5) a(n) LEFT JOIN o ON o.row_id = t.row_id AND o.n = a.n) / 4 AS lp FROM t)
SELECT row_id, round(CASE WHEN len(ref) > 0 AND len(pred) > 0 THEN 100 * CASE WHEN len(pred) > len(ref) THEN 1e0 ELSE exp(1 - len(ref) / greatest(1, len(pred))) END * exp(lp) ELSE 0e0 END, 6) AS bleu FROM s""")
def fn_smoothed_bleu(spark, sf_dir):
    return S.smoothed_bleu(_tokens(spark, sf_dir), "row_id", "ref", "pred").select("row_id", F.round("bleu", 6).alias("bleu"))


def _tokens(spark, sf_dir):
    return X.pairs(spark, sf_dir).where("reject IS NOT NULL").select("row_id", T.word_tokens(F.col("chosen")).alias("ref"), T.word_tokens(F.col("reject")).alias("pred"))


@_query("fn_char_similarity")
def fn_char_similarity(spark, sf_dir):
    return X.pairs(spark, sf_dir).select("row_id", S.char_similarity(F.col("chosen"), F.col("reject")).alias("value"))


@_query("fn_len_ratio", f"WITH {X.PAIRS} SELECT row_id, least({D.token_len('query')}, {D.token_len('chosen')}) / nullif(greatest({D.token_len('query')}, {D.token_len('chosen')}), 0) AS value FROM px_pair")
def fn_len_ratio(spark, sf_dir):
    return X.pairs(spark, sf_dir).select("row_id", S.len_ratio(F.col("query"), F.col("chosen")).alias("value"))


_BAND = "1.2e0 * (1e0 - least(1e0, abs(bleu - 28e0) / 42e0)) + (8e-1 - abs(sim_char - 48e-2)) + (65e-2 - abs(sim_jacc - 22e-2)) + 35e-2 * len_ratio"


@_query("fn_hardness_score", f"WITH {X.METRICS} SELECT row_id, round({_BAND}, 9) AS value FROM px_metrics")
def fn_hardness_score(spark, sf_dir):
    c = F.col
    return X.metrics(spark, sf_dir).select("row_id", F.round(S.hardness_score(c("bleu"), c("sim_char"), c("sim_jacc"), c("len_ratio")), 9).alias("value"))


@_query("fn_mismatch_rank_score", "SELECT a.doc_id, round(a.n_chars / 1e6 + CASE WHEN a.lang = 'en' THEN 15e-2 ELSE 0e0 END - CASE WHEN a.source = 'src1' THEN 5e-2 ELSE 0e0 END, 9) AS value FROM documents a")
def fn_mismatch_rank_score(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", F.round(S.mismatch_rank(F.col("n_chars") / 1e6, F.col("lang") == "en", F.col("source") == "src1"), 9).alias("value"))


@_query("flt_hardness_guards")
def flt_hardness_guards(spark, sf_dir):
    out = S.with_hardness(X.pairs(spark, sf_dir), "chosen", "reject")
    return out.where(F.col("hardness").isNotNull()).select("row_id", "hardness.*")


@_query("flt_safe_pair", f"""WITH {X.PAIRS}, m AS (SELECT p.*, CASE WHEN row_id % 3 <> 0 THEN (row_id % 100) / 1e0 END AS bleu, CASE WHEN row_id % 5 <> 0 THEN (row_id % 13) / 10e0 END AS sim_char FROM px_pair p),
c AS (SELECT *, {D.strip("coalesce(chosen, '')")} AS a, {D.strip("coalesce(reject, '')")} AS b FROM m)
SELECT row_id FROM c WHERE a <> '' AND b <> '' AND a <> b AND ({D.bad_reason('a').replace(D.words('a'), D.found('lower(a)', T.WORD_TOKEN))}) IS NULL AND ({D.bad_reason('b').replace(D.words('b'), D.found('lower(b)', T.WORD_TOKEN))}) IS NULL
AND coalesce(bleu BETWEEN 0 AND 70, true) AND coalesce(sim_char BETWEEN 5e-2 AND 9e-1, true)""")
def flt_safe_pair(spark, sf_dir):
    none, r = F.lit(None).cast("double"), F.col("row_id")
    rows = X.pairs(spark, sf_dir).withColumns({"bleu": F.when(r % 3 != 0, (r % 100) / 1.0), "sim_char": F.when(r % 5 != 0, (r % 13) / 10.0)})
    return rows.where(pools.is_safe_pair(F.col("chosen"), F.col("reject"), F.col("bleu"), F.col("sim_char"), none, none)).select("row_id")


@_query("win_dedup_array", f"WITH {X.PAIRS}, a AS (SELECT row_id, list_filter([{D.clean('chosen')}, {D.clean('query')}, {D.clean('chosen')}, '', {D.clean('reject')}], lambda x: x <> '') AS xs FROM px_pair) SELECT row_id, CAST(len(list_distinct(xs)) AS INTEGER) AS n, xs[1] AS first FROM a")
def win_dedup_array(spark, sf_dir):
    values = P.dedup_array(F.array("chosen", "query", "chosen", F.lit(" "), "reject"))
    return X.pairs(spark, sf_dir).select("row_id", values.alias("v")).select("row_id", F.size("v").alias("n"), F.get("v", F.lit(0)).alias("first"))


@_query("join_candidates_by_sample_id", "WITH c AS (SELECT lang AS sample_id, max_by(source, doc_id) AS last FROM documents GROUP BY lang) SELECT d.doc_id, c.last FROM documents d LEFT JOIN c ON c.sample_id = CASE WHEN d.lang <> 'fr' THEN d.lang END")
def join_candidates_by_sample_id(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    generated = d.select(F.col("lang").alias("sample_id"), F.col("doc_id").alias("ordinal"), F.array("source").alias("generated_responses"))
    rows = d.select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("sample_id"))
    return P.join_candidates(rows, generated).select("doc_id", F.get("generated_responses", F.lit(0)).alias("last"))


_CODE = X.CODE + ", base AS (SELECT doc_id, lang, repo, func_name, docstring, list_distinct(code_tokens) AS t FROM px_code)"


@_query("join_mismatch_self", f"""WITH {_CODE}, tok AS (SELECT doc_id, lang, unnest(t) AS k FROM base), com AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS c FROM tok a JOIN tok b ON a.lang = b.lang AND a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
s AS (SELECT a.doc_id, b.doc_id AS other, CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN coalesce(c, 0) / (len(a.t) + len(b.t) - coalesce(c, 0)) ELSE 0e0 END AS code_similarity, a.func_name = b.func_name AS same_name, a.repo = b.repo AS same_repo
  FROM base a JOIN base b ON a.lang = b.lang AND a.doc_id <> b.doc_id LEFT JOIN com ON com.doc_id = a.doc_id AND com.other = b.doc_id),
r AS (SELECT *, code_similarity + CASE WHEN same_name THEN 15e-2 ELSE 0e0 END - CASE WHEN same_repo THEN 5e-2 ELSE 0e0 END AS rank_score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank_score DESC, other) AS rn FROM r)
SELECT doc_id, other, round(code_similarity, 9) AS code_similarity, round(rank_score, 9) AS rank_score, CAST(rn AS INTEGER) AS rn FROM k WHERE rn <= 8""")
def join_mismatch_self(spark, sf_dir):
    rows = X.code_samples(spark, sf_dir)
    out = P.retrieval_candidates(rows, "lang", "doc_id", "code_tokens", "func_name", "repo", 8, salts=4)
    return out.select("doc_id", "other", F.round("code_similarity", 9).alias("code_similarity"), F.round("rank_score", 9).alias("rank_score"), "rn")


@_query("win_argmax_mismatch")
def win_argmax_mismatch(spark, sf_dir):
    rows = X.code_samples(spark, sf_dir)
    near = P.retrieval_candidates(rows, "lang", "doc_id", "code_tokens", "func_name", "repo", 8, salts=4)
    return P.best_mismatch(rows, near, "doc_id", "docstring", 4).select("doc_id", "mismatch.*")


@_query("win_argmax_model")
def win_argmax_model(spark, sf_dir):
    rows = X.pairs(spark, sf_dir).withColumn("responses", F.array("reject", "query", "chosen"))
    return P.best_model_negative(rows, "row_id", "chosen", "responses").select("row_id", "model.*")


@_query("fn_synthetic_negative")
def fn_synthetic_negative(spark, sf_dir):
    return P.first_synthetic(X.pairs(spark, sf_dir), "row_id", "chosen").select("row_id", "synthetic.*")


@_query("construct_pairs")
def construct_pairs(spark, sf_dir):
    """The cascade model, then altered text, into pairs with metadata."""
    rows = X.pairs(spark, sf_dir).withColumn("responses", F.array("reject", "query"))
    model = P.best_model_negative(rows, "row_id", "chosen", "responses")
    altered = P.first_synthetic(rows, "row_id", "chosen")
    found = P.cascade(rows, "row_id", [("model_sample", model), ("synthetic", altered)])
    out = P.pair_rows(found, T.build_query(F.col("query"), F.lit(""), F.lit("en")), "chosen")
    return out.select("row_id", "query", "chosen_response", "reject_response", "chosen_length", "reject_length", "metadata.*")
