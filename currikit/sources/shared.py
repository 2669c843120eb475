"""The folder that all executors share, and tables dealt out to all of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of spark.checkpoint.dir. Where none is set, a local session (tests) gets a temporary one, and a cluster an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="shared-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt out to all of them; others as they are.

    A small file of one row group is one task otherwise, however much work its
    rows are. Tables with a partition for each core are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
