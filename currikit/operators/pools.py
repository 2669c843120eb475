"""Difficulty pools: safety filter, three ways of bucketing, annotation and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from currikit.functions import margins as M
from currikit.functions import text as T
from currikit.operators import ranking as R


@dataclass(frozen=True)
class Safety:
    """Metric ranges of a usable pair."""

    min_bleu: float = 0.0
    max_bleu: float = 70.0
    min_sim_char: float = 0.05
    max_sim_char: float = 0.90
    min_sim_jacc: float = 0.02
    max_sim_jacc: float = 0.70
    min_len_ratio: float = 0.25


def is_safe_pair(chosen: Column, rejected: Column, bleu: Column, sim_char: Column, sim_jacc: Column, len_ratio: Column, safety: Safety = Safety()) -> Column:
    """Two good and different texts with metrics in range; a missing metric never rejects."""
    a, b = T.strip(F.coalesce(chosen, F.lit(""))), T.strip(F.coalesce(rejected, F.lit("")))
    good = (a != "") & (b != "") & (a != b) & T.bad_docstring_reason(a, clean=False).isNull() & T.bad_docstring_reason(b, clean=False).isNull()
    inside = lambda c, lo, hi: F.coalesce(c.between(lo, hi), F.lit(True))
    return (
        good
        & inside(bleu, safety.min_bleu, safety.max_bleu)
        & inside(sim_char, safety.min_sim_char, safety.max_sim_char)
        & inside(sim_jacc, safety.min_sim_jacc, safety.max_sim_jacc)
        & F.coalesce(len_ratio >= safety.min_len_ratio, F.lit(True))
    )


def with_scores(pairs: DataFrame) -> DataFrame:
    """pairs with difficulty_score and quality from their metrics."""
    c = F.col
    return pairs.withColumns(
        {
            "difficulty_score": M.difficulty_score(c("bleu"), c("sim_char"), c("sim_jacc"), c("hardness_score")),
            "quality": M.pair_quality(c("bleu"), c("sim_char"), c("sim_jacc"), c("len_ratio")),
        }
    )


def _bucket(rn: Column, n_easy: Column, n_medium: Column) -> Column:
    return F.when(rn <= n_easy, "easy").when(rn <= n_easy + n_medium, "medium").otherwise("hard")


def ratio_buckets(rows: DataFrame, by: Sequence[str], score: str, row_id: str, easy: float = 0.4, medium: float = 0.4, descending: bool = False) -> DataFrame:
    """rows with rn and level: the first share of the ordered rows is easy, the next medium, the rest hard."""
    order = [F.col(score).desc() if descending else F.col(score).asc(), F.col(row_id)]
    rows = R.ranked(rows, by, order).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    n = F.col("__n")
    n_easy = F.greatest(F.lit(0), F.least(n, F.rint(n * easy)))
    n_medium = F.greatest(F.lit(0), F.least(n - n_easy, F.rint(n * medium)))
    return rows.withColumn("level", _bucket(F.col("rn"), n_easy, n_medium)).drop("__n")


def quality_floor(rows: DataFrame, by: Sequence[str], q: float = 0.05, min_bucket: int = 1) -> DataFrame:
    """Rows at or above the group's interpolated quality quantile, or all rows of a group where too few would stay."""
    floors = R.linear_quantile(rows, by, "quality", q, "__floor")
    rows = rows.join(floors, list(by)).withColumn("__above", F.col("quality") >= F.col("__floor"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.count_if("__above").alias("__kept"))
    rows = rows.join(sizes, list(by))
    few = F.col("__kept") < F.greatest(F.lit(3 * min_bucket), F.least(F.lit(12), F.col("__n")))
    return rows.where(F.col("__above") | few).drop("__floor", "__above", "__n", "__kept")


def balanced_buckets(rows: DataFrame, by: Sequence[str], row_id: str, easy: float = 0.4, medium: float = 0.35, q: float = 0.05, min_bucket: int = 1) -> DataFrame:
    """rows above the quality floor with rn and level: by difficulty, better quality first at ties; no bucket is starved."""
    rows = quality_floor(rows, by, q, min_bucket)
    rows = R.ranked(rows, by, [F.col("difficulty_score"), F.col("quality").desc(), F.col(row_id)]).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    n = F.col("__n")
    least = F.least(F.lit(max(1, min_bucket)), F.greatest(F.lit(1), F.floor(n / 3)))
    n_easy = F.greatest(least, F.least(n - 2 * least, F.rint(n * easy)))
    n_medium = F.greatest(least, F.least(n - n_easy - least, F.rint(n * medium)))
    level = F.when(n <= 2, F.when(F.col("rn") == 1, "easy").otherwise("medium")).otherwise(_bucket(F.col("rn"), n_easy, n_medium))
    return rows.withColumn("level", level).drop("__n")


@dataclass(frozen=True)
class Bands:
    easy_max: float = 0.16
    medium_min: float = 0.16
    medium_max: float = 0.30
    hard_min: float = 0.30
    hard_max: float = 0.45


def score_bands(rows: DataFrame, by: Sequence[str], row_id: str, bands: Bands = Bands(), score: str = "difficulty_score") -> DataFrame:
    """A row for each (row, level): levels by score, what is in no band goes; an empty level takes its share of all ordered rows.

    So a row may be in two levels.
    """
    s = F.col(score)
    level = F.when(s <= bands.easy_max, "easy").when(s.between(bands.medium_min, bands.medium_max), "medium").when(s.between(bands.hard_min, bands.hard_max), "hard")
    group = Window.partitionBy(*by)
    rows = R.ranked(rows.withColumn("__band", level), by, [s, F.col(row_id)])
    rows = rows.withColumn("__n", F.count("*").over(group))
    rows = rows.withColumns({f"__{v}": F.count_if(F.col("__band") == v).over(group) for v in T.LEVELS})
    n, at = F.col("__n"), F.col("rn") - 1
    cut = lambda x: F.rint(n * x)
    spare = {
        "easy": at < F.greatest(F.lit(1), cut(0.30)),
        "medium": (at >= cut(0.30)) & (at < F.greatest(cut(0.30) + 1, cut(0.65))),
        "hard": at >= cut(0.65),
    }
    levels = F.array(*(F.when((F.col("__band") == v) | (F.col(f"__{v}") == 0) & spare[v], v) for v in T.LEVELS))
    out = rows.withColumn("level", F.explode(F.filter(levels, lambda x: x.isNotNull())))
    return out.drop("__band", "__n", *(f"__{v}" for v in T.LEVELS))


def annotate(rows: DataFrame, origin: str = "origin") -> DataFrame:
    """rows with the names by which later stages know their pool."""
    return rows.withColumns(
        {
            "difficulty": F.col("level"),
            "source": F.concat_ws("_", F.col(origin), F.col("level")),
            "curriculum_level": T.level_id(F.col("level")),
            "metadata": F.struct(
                F.col("level").alias("curriculum_difficulty"),
                T.level_id(F.col("level")).alias("curriculum_level"),
                F.col(origin).alias("curriculum_origin"),
                F.col("client_id").alias("curriculum_client_id"),
                F.bround("difficulty_score", 6).alias("curriculum_difficulty_score"),
            ),
        }
    )


def split_stats(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, difficulty range and mean quality of each group's three levels; an empty level has 0 and nulls."""
    stats = rows.groupBy(*by, "level").agg(F.count("*").alias("n"), F.min("difficulty_score").alias("min_difficulty"), F.max("difficulty_score").alias("max_difficulty"), F.avg("quality").alias("mean_quality"))
    every = rows.select(*by).distinct().withColumn("level", F.explode(F.array(*map(F.lit, T.LEVELS))))
    return every.join(stats, [*by, "level"], "left").fillna(0, ["n"])


def discover_clients(rows: DataFrame, language: str = "lang", known: Sequence[str] = ()) -> DataFrame:
    """``(lang, client_id)``: the known languages that occur, in their order, or else all in alphabetical order, numbered from 0.

    There are as many rows as languages.
    """
    found = rows.select(F.col(language).alias("lang")).distinct()
    listed = F.array_position(F.array(*map(F.lit, known)), F.col("lang")) if known else F.lit(0)
    placed = found.withColumn("__at", listed).withColumn("__any", F.max("__at").over(Window.partitionBy()))
    kept = placed.where((F.col("__any") == 0) | (F.col("__at") > 0))
    return kept.select("lang", (F.row_number().over(Window.orderBy("__at", "lang")) - 1).alias("client_id"))


def stable_rows(rows: DataFrame, margin: str = "client_margin") -> DataFrame:
    """The training columns with source, difficulty, the margin (0 if it is no number) and the valid flag."""
    from currikit.operators.selection import TRAINING_COLUMNS

    key = F.col(margin) if margin in rows.columns else F.col("client_margin")
    value = M.safe_float(key, 0.0, finite=False)
    valid = F.coalesce("client_margin_valid", F.lit(True)) if "client_margin_valid" in rows.columns else F.lit(True)
    own = [c for c in ("row_id", "client_id", "source", "difficulty", *TRAINING_COLUMNS) if c in rows.columns]
    return rows.select(*own, value.alias("instruction_margin"), value.alias("client_margin"), valid.alias("client_margin_valid"))
