"""Selection of each client's training set: gates, budgets, caps and deduplication.

All clients run in one job. Top-k windows with a constant bound cut each
client's rows before the shuffle, so what a later window holds is bounded by the target
size and not by a client's share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from currikit.functions import margins as M
from currikit.functions import text as T
from currikit.operators import ranking as R

TRAINING_COLUMNS = ("query", "prompt", "chosen_response", "reject_response", "chosen", "rejected")


@dataclass(frozen=True)
class Config:
    """Settings of one selection."""

    target: int
    margin_fields: Sequence[str] = M.MARGIN_FIELDS
    pooling: M.Pooling = field(default_factory=M.Pooling)
    score_mode: str = "bees"
    tau: float = 0.25
    least_probability: float = 0.5
    min_sources: int = 1
    min_margin: float | None = None
    drop_truncated: bool = False
    gate_hard: bool = False
    hard_quantile: float = 0.5
    public_quantile: float = 0.25
    max_public_count: int = -1
    max_public_ratio: float = -1.0
    max_local_ratio: float = -1.0
    dedup: bool = False
    seed: int = 42


def prepare(pool: DataFrame, config: Config) -> DataFrame:
    """Rows with a margin and enough sources, with origin, difficulty, margin, bees_prob, n_sources and score.

    Everything is computed where the row is read.
    """
    fields = {n: F.col(n) for n in config.margin_fields if n in pool.columns}
    everything = {n: F.col(n) for n in M.MARGIN_FIELDS if n in pool.columns}
    valid = F.col("client_margin_valid") if "client_margin_valid" in pool.columns else None
    probabilities = [M.margin_to_probability(M.safe_float(c), config.pooling) for c in fields.values()]
    n_sources = sum((M.safe_float(c).isNotNull().cast("int") for c in fields.values()), F.lit(0))
    rows = pool.withColumns({"margin_": M.get_margin(everything, valid), "n_sources": n_sources, "bees_prob": M.bayes_pool(probabilities)})
    rows = rows.where(F.col("margin_").isNotNull() & (F.col("n_sources") >= config.min_sources))
    if config.min_margin is not None:
        rows = rows.where(F.col("margin_") >= config.min_margin)
    if config.drop_truncated and "client_truncated" in pool.columns:
        rows = rows.where(~F.col("client_truncated").eqNullSafe(F.lit(True)))
    score = M.score_margin(F.col("margin_"), F.col("bees_prob"), config.score_mode, config.tau, config.least_probability)
    return rows.withColumns({"origin": T.origin_of_source(F.col("source")), "difficulty": T.difficulty_of_source(F.col("source")), "score": score})


def hard_gate(rows: DataFrame, q: float, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """Drops hard rows that score below the quantile of the group's local rows that aren't hard; adds hard_threshold, null where there are none."""
    thresholds = R.nearest_quantile(rows.where("origin = 'local' AND difficulty <> 'hard'"), by, "score", q, "hard_threshold")
    joined = rows.join(thresholds, list(by), "left")  # a row a client
    return joined.where((F.col("difficulty") != "hard") | F.col("hard_threshold").isNull() | (F.col("score") >= F.col("hard_threshold")))


def budgeted(rows: DataFrame, config: Config, by: Sequence[str] = ("client_id",), row_id: str = "row_id") -> DataFrame:
    """Local rows first, then public ones above a quantile of the chosen local scores.

    Adds rn (rank within origin), public_threshold and pos (place in the selection).
    """
    best = R.best_first("score", row_id, config.seed)
    ranked = R.top_k(rows, [*by, "origin"], best, config.target)
    n_local = F.count_if(F.col("origin") == "local").over(Window.partitionBy(*by))
    rows = ranked.withColumn("n_local", n_local)
    # ranks descend: index i of the ascending list of n is rank n - i
    at = F.col("n_local") - F.rint((F.col("n_local") - 1) * F.lit(max(0.0, min(1.0, config.public_quantile))))
    threshold = F.max(F.when((F.col("origin") == "local") & (F.col("rn") == at), F.col("score"))).over(Window.partitionBy(*by))
    room = F.greatest(F.lit(0), F.lit(config.target) - F.col("n_local"))
    if config.max_public_count >= 0:
        room = F.least(room, F.lit(config.max_public_count))
    if config.max_public_ratio >= 0:
        room = F.least(room, F.lit(int(config.target * config.max_public_ratio)))
    rows = rows.withColumn("public_threshold", threshold)
    fits = (F.col("rn") <= room) & (F.col("public_threshold").isNull() | (F.col("score") >= F.col("public_threshold")))
    rows = rows.where((F.col("origin") == "local") | fits)
    return rows.withColumn("pos", F.when(F.col("origin") == "local", F.col("rn")).otherwise(F.col("n_local") + F.col("rn")))


def mixed_cap(rows: DataFrame, config: Config, by: Sequence[str] = ("client_id",), row_id: str = "row_id") -> DataFrame:
    """The best rows of either origin with a cap on local ones, then the best of the rest until the target is met.

    Adds phase (1 or 2) and pos. The best ``target`` rows of each origin are all that can be chosen.
    """
    best = R.best_first("score", row_id, config.seed)
    near = R.top_k(rows, [*by, "origin"], best, config.target)
    cap = int(config.target * config.max_local_ratio)
    admitted = (F.col("origin") != "local") | (F.col("rn") <= cap)
    first = R.ranked(near.withColumn("__in", admitted), [*by, "__in"], best, "__r1")
    phase = F.when(F.col("__in") & (F.col("__r1") <= config.target), 1).otherwise(2)
    placed = R.ranked(first.withColumn("phase", phase), by, [F.col("phase"), *best], "pos")
    return placed.where(F.col("pos") <= config.target).withColumn("public_threshold", F.lit(None).cast("double")).drop("__in", "__r1")


def dedup_first(rows: DataFrame, key: Sequence[str], by: Sequence[str] = ("client_id",), order: Column | None = None) -> DataFrame:
    """The first selected row of each key; the gaps aren't filled."""
    return R.first_by_key(rows, by, key, [F.col("pos") if order is None else order])


def select_curriculum(pool: DataFrame, config: Config, key: Sequence[str] = (), by: Sequence[str] = ("client_id",), row_id: str = "row_id") -> DataFrame:
    """The whole selection of every client: prepare, gate, budget or mixed cap, deduplicate."""
    rows = prepare(pool, config)
    rows = hard_gate(rows, config.hard_quantile, by) if config.gate_hard else rows.withColumn("hard_threshold", F.lit(None).cast("double"))
    chosen = mixed_cap(rows, config, by, row_id) if config.max_local_ratio >= 0 else budgeted(rows, config, by, row_id)
    return dedup_first(chosen, key, by) if config.dedup and key else chosen


def shuffled(rows: DataFrame, by: Sequence[str], row_id: str, seed: int) -> DataFrame:
    """A seeded place for each row of a group, for writers that order by it."""
    return R.ranked(rows, by, [R.seeded(seed, row_id), F.col(row_id)], "shuffle_pos")


def training_rows(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The columns that training reads, of those that there are."""
    return rows.select(*extra, *(c for c in TRAINING_COLUMNS if c in rows.columns))


def selection_stats(prepared: DataFrame, selected: DataFrame, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """One row a group: candidates, chosen rows, means, thresholds and counts by source, origin and difficulty."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    available = prepared.groupBy(*by).agg(is_("origin", "local").alias("num_available_local"), is_("origin", "public").alias("num_available_public"))
    chosen = selected.groupBy(*by).agg(
        F.count("*").alias("num_output"),
        is_("origin", "local").alias("num_selected_local"),
        is_("origin", "public").alias("num_selected_public"),
        F.count_if(F.col("margin_") < 0).alias("negative_margin_count"),
        F.avg("margin_").alias("mean_selected_margin"),
        F.avg("score").alias("mean_selected_score"),
        F.avg("bees_prob").alias("mean_selected_bees_prob"),
        F.avg("n_sources").alias("mean_selected_bees_source_count"),
        F.max("public_threshold").alias("public_score_threshold"),
        F.max("hard_threshold").alias("hard_score_threshold"),
        *(is_("difficulty", v).alias(f"num_{v}") for v in T.LEVELS),
    )
    counts = [c for c in chosen.columns if c.startswith("num_") or c.endswith("_count") and not c.startswith("mean")]
    return available.join(chosen, list(by), "left").fillna(0, counts)


def count_by(rows: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows for each value; a missing one is called unknown."""
    return rows.groupBy(*by, F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key)).agg(F.count("*").alias("n"))
