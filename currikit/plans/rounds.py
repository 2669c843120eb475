"""Round drivers: training rounds of a parameter state, and stages that are run once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from currikit.operators import federated as A
from currikit.sources.readers import path_exists


def run_rounds(state: DataFrame, train: Callable[[int, DataFrame], DataFrame], samples: DataFrame, server: A.Server, rounds: int, folder: str) -> DataFrame:
    """The state after some rounds; each round's is written to the shared folder, so that a lost executor costs one round at most.

    ``train(round, state)`` gives the clients' states ``(client_id, key, pos, value)``.
    """
    spark = state.sparkSession
    optimizer = None
    for k in range(rounds):
        A.aggregate(state, train(k, state), samples, server, k, optimizer).write.mode("overwrite").parquet(f"{folder}/round={k}")
        optimizer = state = spark.read.parquet(f"{folder}/round={k}")
    return state


def run_stages(spark: SparkSession, stages: Sequence[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], folder: str, start: int = 0, end: int | None = None, redo: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Runs stages ``start`` to ``end`` in order; a stage whose table is there is read instead, unless it is to be redone."""
    out: dict[str, DataFrame] = {}
    last = len(stages) - 1 if end is None else end
    for k, (name, stage) in enumerate(stages):
        path = f"{folder}/{name}"
        there = path_exists(spark, f"{path}/_SUCCESS")
        if start <= k <= last and (not there or name in redo):
            stage(out).write.mode("overwrite").parquet(path)
            there = True
        if there:
            out[name] = spark.read.parquet(path)
    return out
