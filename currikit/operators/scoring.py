"""From token log-probabilities to margins, and the shells around external models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import MapType, StructType, TimestampNTZType, TimestampType

from currikit.functions import margins as M
from currikit.functions import text as T

#: Rows and bytes that a model gets at a time, at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20

def mark_missing(rows: DataFrame, query: str = "query", chosen: str = "chosen_response", rejected: str = "reject_response") -> DataFrame:
    """rows with client_margin_valid false and an error where a text is missing; none is dropped."""
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    missing = blank(F.col(query)) | blank(F.col(chosen)) | blank(F.col(rejected))
    return rows.withColumns({"client_margin_valid": ~missing, "client_margin_error": F.when(missing, "missing query/chosen/rejected")})


def examples(rows: DataFrame, row_id: str, prompt_tokens: str, chosen_tokens: str, rejected_tokens: str, max_len: int) -> DataFrame:
    """Two rows for each pair: ``(row_id, response_name, tokens, prompt_len, full_len, truncated)``, cut at max_len."""
    sides = F.array(F.struct(F.lit("chosen").alias("response_name"), F.col(chosen_tokens).alias("t")), F.struct(F.lit("rejected").alias("response_name"), F.col(rejected_tokens).alias("t")))
    out = rows.select(row_id, F.col(prompt_tokens).alias("p"), F.explode(sides).alias("s"))
    full = F.concat("p", "s.t")
    n = F.size(full)
    return out.select(row_id, "s.response_name", F.slice(full, 1, max_len).alias("tokens"), F.least(F.size("p"), F.lit(max_len)).alias("prompt_len"), F.least(n, F.lit(max_len)).alias("full_len"), (n > max_len).alias("truncated"))


def response_logprobs(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, logp, tokens, truncated, valid)``: sum and number of finite log-probabilities from prompt_len up to full_len.

    ``tokens`` has ``(keys, pos, logprob, prompt_len, full_len, truncated)``. Without any, logp is NaN and valid false.
    """
    lp = F.when((F.col("pos") >= F.col("prompt_len")) & (F.col("pos") < F.col("full_len")), M.safe_float(F.col("logprob")))
    out = tokens.groupBy(*keys).agg(F.sum(lp).alias("s"), F.count(lp).alias("tokens"), F.max("truncated").alias("truncated"))
    return out.select(*keys, F.coalesce("s", F.lit(float("nan"))).alias("logp"), "tokens", "truncated", (F.col("tokens") > 0).alias("valid"))


def margin_parts(logps: DataFrame, row_id: str, beta: float = 0.1, reference: bool = True) -> DataFrame:
    """``(row_id, four log-probabilities, tokens, client_margin, client_truncated, client_margin_valid)``.

    ``logps`` has ``(row_id, response_name, model, logp, tokens, truncated, valid)``. One
    grouping pivots the parts; no join. The margin is null where a part is missing.
    """
    parts = [(m, r) for m in (("policy", "ref") if reference else ("policy",)) for r in ("chosen", "rejected")]
    part = lambda c, m, r: F.max(F.when((F.col("model") == m) & (F.col("response_name") == r), F.col(c)))
    good = F.when(F.col("valid"), F.col("logp"))
    out = logps.withColumn("logp", good).groupBy(row_id).agg(
        *(part("logp", m, r).alias(f"client_{m}_{r}_logp") for m, r in parts),
        *(part("tokens", m, r).alias(f"client_{m}_{r}_tokens") for m, r in parts),
        F.max("truncated").alias("client_truncated"),
    )
    refs = [F.col(f"client_ref_{r}_logp") for r in ("chosen", "rejected")] if reference else []
    margin = M.dpo_margin(F.col("client_policy_chosen_logp"), F.col("client_policy_rejected_logp"), *refs, beta=beta)
    return out.withColumn("client_margin", margin).withColumn("client_margin_valid", F.col("client_margin").isNotNull())


def score_summary(rows: DataFrame, source: str = "source") -> DataFrame:
    """Rows, invalid rows and mean margin of each source."""
    return rows.groupBy(source).agg(F.count("*").alias("num_rows"), F.count_if(~F.col("client_margin_valid")).alias("num_invalid"), F.avg("client_margin").alias("mean_margin"))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of a model's rows and bytes, or of one row."""
    n = batch.num_rows
    if n <= 1 or n <= BATCH_ROWS and batch.nbytes <= BATCH_BYTES:
        yield batch
        return
    yield from _parts(batch.slice(0, n // 2))
    yield from _parts(batch.slice(n // 2))


def with_model(rows: DataFrame, model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """rows through an external model, batch by batch; ``model`` is called once in each task to load it.

    A batch has ``BATCH_ROWS`` rows and ``BATCH_BYTES`` at most (or one row), whatever Arrow's own batches
    have (10,000 rows or 64 MB), so that few texts at a time are Python strings.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    if any(isinstance(f.dataType, (StructType, MapType, TimestampType, TimestampNTZType)) for f in rows.schema):  # Spark has its own forms of these in pandas

        def run_pandas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score = model()
            for batch in batches:
                for i in range(0, len(batch), BATCH_ROWS):
                    yield score(batch.iloc[i : i + BATCH_ROWS].reset_index(drop=True))

        return rows.mapInPandas(run_pandas, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model()
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_pandas(score(part.to_pandas()), schema=kinds, preserve_index=False)

    return rows.mapInArrow(run, schema)


def generate_candidates(prompts: DataFrame, model: Callable[[], Callable[[list[str]], list[list[str]]]], row_id: str = "sample_id", prompt: str = "prompt") -> DataFrame:
    """``(row_id, generated_responses)``: what the model answers to each prompt, cleaned, without blank ones."""

    def load():
        answer = model()
        return lambda pdf: pd.DataFrame({row_id: pdf[row_id], "generated_responses": answer(list(pdf[prompt]))})

    kind = prompts.schema[row_id].dataType.simpleString()
    raw = with_model(prompts.select(row_id, prompt), load, f"{row_id} {kind}, generated_responses array<string>")
    cleaned = F.filter(F.transform("generated_responses", T.clean_docstring), lambda x: x != "")
    return raw.withColumn("generated_responses", cleaned)


def count_tokens(rows: DataFrame, tokenizer: Callable[[], Callable[[str], int]], text: str, out: str = "n_tokens") -> DataFrame:
    """rows with the length of a text by a tokenizer that each task loads once."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = tokenizer()
        for batch in texts:
            yield pd.Series([None if t is None else count(t) for t in batch], dtype="Int64")

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out, F.pandas_udf(run, "long")(F.col(text)))
