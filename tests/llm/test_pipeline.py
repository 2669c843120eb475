"""The pipeline stage by stage against plain versions."""

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from currikit.llm import byte_bpe, quality_rules, simhash
from currikit.llm.packing import SIZES
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_packing import whole
from tests.llm.test_secret_scan import plain as plain_secrets
from tests.llm.test_simhash import similar_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
    return [*out, docs]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(outputs):
    for df in outputs[1:-1]:
        assert df.dtypes == outputs[0].dtypes
        assert all(r.n_chars == len(r.text) for r in df.collect())
    counts = [df.select("doc_id").distinct().count() for df in outputs]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100 and counts[-1] == counts[-2]


def test_quality(outputs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE kept").fetchall()}
    assert texts(outputs[1]).keys() == kept


def test_lines(outputs):
    want = {i: t for i, (t, n) in plain_lines(list(texts(outputs[1]).items())).items() if n == 0 or t.strip(" \t\n\x0b\x0c\r")}
    assert texts(outputs[2]) == want


def test_near(outputs):
    before = texts(outputs[2])
    groups = similar_groups(before)
    assert texts(outputs[3]) == {i: before[i] for i in groups.values()}


def test_secrets(outputs):
    before, after = texts(outputs[3]), texts(outputs[4])
    assert before.keys() == after.keys()
    for i, t in after.items():
        assert plain_secrets(t)[2] == ""
        assert (t == before[i]) == (plain_secrets(before[i])[2] == "")


def test_packing(outputs):
    encoding = byte_bpe.encoding(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    lengths = {i: len(encoding.encode_ordinary(t)) + 1 for i, t in texts(outputs[4]).items()}
    whole(outputs[5].collect(), lengths, SIZES)


def test_run_agrees(spark, outputs):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, outputs[5].collect()))


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    prose = "\n".join(" ".join(f"w{i}{j}" for j in range(12)) + "." for i in range(6))
    rows = [(1, prose.replace("w", "v"), "en", "s", 3, "k"), (1, prose, "en", "s", 3, "k"), (1, prose, "en", "s", 3, "k"), (2, None, None, None, None, None), (None, prose + " token = abcdefghijklmnop", "en", "s", 0, "k"), (4, "", "en", "s", 0, "k"), (3, "x " * 9000 + ".", "en", "s", 1, "k")]
    clashing = ["__" + c for c in ("gone", "id", "found", "first", "clean", "row", "key")] + ["row", "gone", "found", "doc", "spans"]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = df = df.withColumns({c: F.lit(1) for c in clashing})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns
            docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs.cache()
            # two unlike documents share id 1: neither goes
            assert df.isEmpty() or {r.text for r in docs.where("doc_id = 1").collect()} >= {prose, prose.replace("w", "v")}
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    out = simhash.one_of_each(spark.createDataFrame(rows, schema).where(F.col("text").isNotNull()))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "key"]
