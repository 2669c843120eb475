"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from currikit.sources.shared import spread

#: A word of the base rules: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with work for every core, whatever its row groups; in no order that comes again."""
    return spread(table(spark, sf_dir, name))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where none is set, a local session (tests) gets a temporary one, and a cluster an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that rows share only if they have the same id and text."""
    return F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("a"), F.xxhash64(F.lit("second"), F.col(id_col), F.col(text_col)).alias("b"))


def fields(row: str, names, **changed: Column) -> list[Column]:
    """The fields of the struct column ``row`` as columns, some of them changed. Rows travel as one struct, so that no column of theirs clashes with those of an operator."""
    return [changed.get(c, F.col(row)[c]).alias(c) for c in names]


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file's bytes for the executors. Its size is that of the file (a few MB), whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def let(value: Column, body) -> Column:
    """body(value), with value computed once and not again wherever body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return let(F.trim(text, F.lit(" \t\n\x0b\x0c\r")), lambda t: F.when(t != "", F.split(t, SPACE)).otherwise(F.array().cast("array<string>")))
