"""Writers of training sets, pools, statistics and parameter states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from currikit.functions import text as T


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """JSON lines, null fields left out; ``order`` sorts the rows over all parts (by ranges, without one task for all)."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").json(path)


def write_clients(df: DataFrame, path: str, by: Sequence[str] = ("client_id",), merged: str | None = None) -> None:
    """One folder a client (and level), and all together where ``merged`` names a path."""
    df.write.mode("overwrite").partitionBy(*by).json(path)
    if merged:
        df.write.mode("overwrite").json(merged)


def write_pools(df: DataFrame, path: str) -> None:
    """A client's three levels, its hard rows under a second name, and all in order of level."""
    df.write.mode("overwrite").partitionBy("client_id", "level").json(f"{path}/levels")
    df.where("level = 'hard'").write.mode("overwrite").partitionBy("client_id").json(f"{path}/hard")
    ordered = df.withColumn("__l", T.level_id(F.col("level"))).repartition("client_id").sortWithinPartitions("client_id", "__l", "rn").drop("__l")
    ordered.write.mode("overwrite").partitionBy("client_id").json(f"{path}/all")


def empty_pools(clients: DataFrame) -> DataFrame:
    """Zero statistics for clients without a public pool: ``(client_id, level, n)``."""
    return clients.select("client_id", F.explode(F.array(*map(F.lit, T.LEVELS))).alias("level")).withColumn("n", F.lit(0).cast("long"))


def write_stats(df: DataFrame, path: str) -> None:
    """Statistics, a row a client, as one small JSON file a partition."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def tensor_meta(state: DataFrame) -> DataFrame:
    """``(factor, n_tensors, n_values)`` of a state."""
    factor = F.when(T.is_lora_a(F.col("key")), "A").when(T.is_lora_b(F.col("key")), "B").otherwise("other")
    return state.groupBy(factor.alias("factor")).agg(F.count_distinct("key").alias("n_tensors"), F.count("*").alias("n_values"))


def write_state(state: DataFrame, root: str) -> None:
    """A state whole, its A and B parts, and how many tensors each has."""
    state.write.mode("overwrite").parquet(f"{root}/state")
    state.where(T.is_lora_a(F.col("key"))).write.mode("overwrite").parquet(f"{root}/lora_A")
    state.where(T.is_lora_b(F.col("key"))).write.mode("overwrite").parquet(f"{root}/lora_B")
    tensor_meta(state).write.mode("overwrite").json(f"{root}/meta")


def mapping_text(clients: DataFrame, path: str = "path") -> DataFrame:
    """``(mapping)``: ``client:path`` of all clients in order, joined by commas; a row a client at most is gathered."""
    pairs = F.sort_array(F.collect_list(F.struct("client_id", path)))
    return clients.agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["client_id"].cast("string"), x[path])), ",").alias("mapping"))


def first_available(files: DataFrame) -> DataFrame:
    """``(name, src)``: for each name the place of highest priority (least number) that has it."""
    return files.groupBy("name").agg(F.min_by("src", "priority").alias("src"))
