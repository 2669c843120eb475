"""Ranks, quantiles and rank-based choices within a group.

Every order is total: the score, then a seeded hash of the row's id, then the id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int | str | Column, row_id: str | Column) -> Column:
    """A hash that shuffles rows the same way in every engine."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat_ws("|", seed.cast("string"), row_id.cast("string")))


def best_first(score: str, row_id: str, seed: int | str | Column) -> list[Column]:
    return [F.col(score).desc_nulls_last(), seeded(seed, row_id).asc(), F.col(row_id).asc()]


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "rn") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """The first k rows of each group; a constant k lets every task drop the rest before the shuffle."""
    return ranked(df, by, order, out).where(F.col(out) <= k)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows with each value and the running count up to it; equal values are summed before the shuffle."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    running = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    return counted.withColumn("__upto", F.sum("__n").over(running)).withColumn("__all", F.sum("__n").over(whole))


def nearest_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, out: str = "threshold") -> DataFrame:
    """``(by, out)``: the value at index round-half-even((n - 1) q) of the ascending list, for groups that have any."""
    q = max(0.0, min(1.0, q))
    at = F.rint((F.col("__all") - 1) * F.lit(q)) + 1
    hit = value_counts(df, by, value).where((F.col("__upto") >= at) & (F.col("__upto") - F.col("__n") < at))
    return hit.select(*by, F.col(value).alias(out))


def linear_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, out: str = "threshold") -> DataFrame:
    """``(by, out)``: the exact interpolated quantile; 0 for groups of nulls."""
    return df.groupBy(*by).agg(F.coalesce(F.percentile(value, F.lit(q)), F.lit(0.0)).alias(out))


def first_by_key(df: DataFrame, by: Sequence[str], key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key within each group."""
    return top_k(df, [*by, *key], order, 1, "__rn").drop("__rn")


def argmax(df: DataFrame, by: Sequence[str], rank: Column, payload: Sequence[str]) -> DataFrame:
    """The payload of each group's row of highest rank, by partial maxima and without a sort."""
    best = df.groupBy(*by).agg(F.max_by(F.struct(*payload), rank).alias("__b"))
    return best.select(*by, "__b.*")


def shards(df: DataFrame, order: Sequence[Column], n_shards: int, out: str = "shard", by: Sequence[str] = ()) -> DataFrame:
    """Contiguous shards of ceil(n / n_shards) rows of the ordered list, within groups."""
    from currikit.functions.margins import shard_of

    whole = Window.partitionBy(*by)
    numbered = ranked(df, by, order, "__rn").withColumn("__n", F.count("*").over(whole))
    return numbered.withColumn(out, shard_of(F.col("__rn") - 1, F.col("__n"), n_shards)).drop("__rn", "__n")


def batches(df: DataFrame, order: Sequence[Column], size: int, out: str = "batch", by: Sequence[str] = ()) -> DataFrame:
    return ranked(df, by, order, "__rn").withColumn(out, F.floor((F.col("__rn") - 1) / size).cast("int")).drop("__rn")


def limit_rows(df: DataFrame, by: Sequence[str], n: int, row_id: str, seed: int | str | None = None) -> DataFrame:
    """The first n rows of each group by id, or n random ones; both are top-k plans."""
    order = [F.col(row_id)] if seed is None else [seeded(seed, row_id), F.col(row_id)]
    return top_k(df, by, order, n, "__rn").drop("__rn")


def holdout(df: DataFrame, by: Sequence[str], ratio: float, row_id: str, seed: int | str, out: str = "origin") -> DataFrame:
    """Marks round-half-even(n * ratio) random rows of each group as public and the others as local."""
    if ratio <= 0:
        return df.withColumn(out, F.lit("local"))
    n = F.count("*").over(Window.partitionBy(*by))
    numbered = ranked(df, by, [seeded(seed, row_id), F.col(row_id)], "__rn").withColumn("__n", n)
    return numbered.withColumn(out, F.when(F.col("__rn") <= F.rint(F.col("__n") * ratio), "public").otherwise("local")).drop("__rn", "__n")
