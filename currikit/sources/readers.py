"""Readers of loosely typed JSON lines, named sources and parameter states."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from currikit.functions.margins import safe_float
from currikit.functions.text import strip


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever file system Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parse_lines(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """``(keep, v, bad)`` of each line that isn't blank: the record as a variant, or null and true."""
    text = strip(F.col(column))
    return lines.where(text != "").select(*keep, F.try_parse_json(text).alias("v")).withColumn("bad", F.col("v").isNull())


def typed(records: DataFrame, fields: Mapping[str, str], v: str = "v") -> DataFrame:
    """records with typed columns out of a variant; numbers also out of numeric texts and booleans, as safe_float has it."""

    def one(name: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return safe_float(F.try_variant_get(v, f"$['{name}']", "double"))
        return F.try_variant_get(v, f"$['{name}']", kind)

    return records.select(*(one(n, k).alias(n) for n, k in fields.items()), F.col(v).alias("raw"))


def read_jsonl(spark: SparkSession, path: str, fields: Mapping[str, str], strict: bool = False, missing_ok: bool = True) -> DataFrame:
    """Typed records with the whole record as ``raw``.

    Lenient: lines that are no JSON objects are dropped (``count_bad`` counts
    them). Strict: a line that is no JSON raises an error; other values than
    objects are dropped. A path that does not exist gives no rows, or an error.
    """
    if missing_ok and not path_exists(spark, path):
        empty = spark.createDataFrame([], T.StructType([T.StructField("v", T.VariantType())]))
        return typed(empty, fields)
    parsed = parse_lines(spark.read.text(path))
    if strict:
        parsed = parsed.withColumn("v", F.when(F.col("bad"), F.raise_error(F.lit(f"bad JSON in {path}"))).otherwise(F.col("v")))
    objects = parsed.where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    return typed(objects, fields)


def count_bad(spark: SparkSession, path: str) -> DataFrame:
    """``(rows, bad_lines)`` of a file."""
    return parse_lines(spark.read.text(path)).agg(F.count_if(~F.col("bad")).alias("rows"), F.count_if("bad").alias("bad_lines"))


def parse_source(spec: str) -> tuple[str, str]:
    """A source given as ``name=path``."""
    name, sep, path = spec.partition("=")
    if not sep or not name.strip():
        raise ValueError(f"expected name=path, not {spec!r}")
    return name.strip(), path.strip()


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All rows with their source's name; columns that a source lacks are null."""
    named = [df.withColumn("source", F.lit(n)) for n, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def read_named(spark: SparkSession, specs: Sequence[str], fields: Mapping[str, str], strict: bool = False) -> DataFrame:
    return union_sources({n: read_jsonl(spark, p, fields, strict) for n, p in map(parse_source, specs)})


def parse_client_map(text: str | None) -> dict[int, str]:
    """``0:/a,1:/b`` as a dict; blanks are skipped, an entry without a colon is an error."""
    out = {}
    for part in filter(None, map(str.strip, (text or "").split(","))):
        client, sep, path = part.partition(":")
        if not sep:
            raise ValueError(f"expected client:path, not {part!r}")
        out[int(client)] = path.strip()
    return out


def resolve_client_path(spark: SparkSession, root: str, client: int, round_: int, explicit: Mapping[int, str] = {}, name: str = "dpo_train.jsonl") -> str | None:
    """A client's data: the path given for it, or the usual places under the root, or the first match below it."""
    if client in explicit:
        path = explicit[client] if "/" == explicit[client][:1] or "://" in explicit[client] else f"{root}/{explicit[client]}"
        return path if path_exists(spark, path) else None
    for path in (f"{root}/client_{client}/{name}", f"{root}/iter_{round_}/client_{client}/{name}"):
        if path_exists(spark, path):
            return path
    if not path_exists(spark, root):
        return None
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path")
    for tail in (f"/iter_{round_}/client_{client}/{name}", f"/client_{client}/{name}"):
        first = found.where(F.endswith("path", F.lit(tail))).agg(F.min("path")).first()[0]
        if first:
            return first
    return None


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    return next((p for p in paths if path_exists(spark, p)), None)


def read_json_document(spark: SparkSession, path: str | None, default: dict | None = None) -> dict:
    """A small JSON document, or the default where there is none."""
    if not path or not path_exists(spark, path):
        return dict(default or {})
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one document


def read_split(spark: SparkSession, root: str, languages: Sequence[str], split: str) -> DataFrame:
    """A partitioned dataset's rows of some languages and one split, by partition pruning."""
    return spark.read.parquet(root).where(F.col("lang").isin(list(languages)) & (F.col("split") == split))


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """A parameter state: one table, or the tables of A and B together."""
    if path_exists(spark, f"{root}/state"):
        return spark.read.parquet(f"{root}/state").select("key", "pos", "value")
    parts = [spark.read.parquet(f"{root}/{p}").select("key", "pos", "value") for p in ("lora_A", "lora_B") if path_exists(spark, f"{root}/{p}")]
    if not parts:
        raise FileNotFoundError(f"no state in {root}")
    return reduce(DataFrame.unionByName, parts)


def blend(spark: SparkSession, parts: Sequence[DataFrame], max_samples: int) -> DataFrame:
    """The parts together, up to a number of rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).limit(max_samples)
