"""Client drops as a stream: new pool rows are selected batch by batch.

An addition of this engine: each micro-batch is scored as it arrives and
appended to a table partitioned by client; a client's training set is made
from the table by ``select_curriculum``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from currikit.operators.selection import Config, prepare


def stream_pool(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Pool rows from JSON files as they are dropped into a folder."""
    return spark.readStream.schema(schema).json(folder)


def prepare_stream(stream: DataFrame, config: Config, table: str, checkpoint: str) -> StreamingQuery:
    """Scores each batch and appends it, once, to the table's folder of its batch number."""

    def append(batch: DataFrame, number: int) -> None:
        prepare(batch, config).write.mode("overwrite").partitionBy("client_id").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
