"""Readers, writers and the stream of client drops."""

import json

import pytest

from currikit.operators.selection import Config
from currikit.sources import readers, writers
from currikit.streaming.drops import prepare_stream, stream_pool

FIELDS = {"a": "double", "s": "string"}


@pytest.fixture
def lines(tmp_path):
    def write(*rows):
        path = tmp_path / "in.jsonl"
        path.write_text("\n".join(rows))
        return f"file://{path}"

    return write


def test_lenient(spark, lines):
    path = lines('{"a": "0.3", "s": "x"}', "", "  ", "not json", "[1, 2]", '{"a": true}', '{"s": 5, "extra": {"k": [1]}}', '{"a": null}')
    rows = readers.read_jsonl(spark, path, FIELDS)
    assert sorted((str(r.a), str(r.s)) for r in rows.collect()) == [("0.3", "x"), ("1.0", "None"), ("None", "5"), ("None", "None")]
    assert any(json.loads(str(r[0])).get("extra") == {"k": [1]} for r in rows.selectExpr("to_json(raw)").collect())
    assert tuple(readers.count_bad(spark, path).first()) == (5, 1)


def test_strict(spark, lines):
    assert readers.read_jsonl(spark, lines('{"a": 1}', "[1]", ""), FIELDS, strict=True).count() == 1
    with pytest.raises(Exception, match="bad JSON"):
        readers.read_jsonl(spark, lines('{"a": 1}', "oops"), FIELDS, strict=True).collect()


def test_missing(spark, tmp_path):
    assert readers.read_jsonl(spark, f"file://{tmp_path}/none", FIELDS).count() == 0
    with pytest.raises(Exception):
        readers.read_jsonl(spark, f"file://{tmp_path}/none", FIELDS, missing_ok=False).count()


def test_specs(spark, lines):
    assert readers.parse_source(" n = /p=q ") == ("n", "/p=q")
    for bad in ("n", "=/p", ""):
        with pytest.raises(ValueError):
            readers.parse_source(bad)
    assert readers.parse_client_map(" 0:/a, ,1:/b:c ") == {0: "/a", 1: "/b:c"} and readers.parse_client_map(None) == {}
    with pytest.raises(ValueError):
        readers.parse_client_map("0")
    assert {r.source for r in readers.read_named(spark, [f"one={lines('{}')}"], FIELDS).collect()} == {"one"}


def test_state_parts(spark, tmp_path):
    s = spark.createDataFrame([("x.lora_A", 0, 1.0), ("x.lora_B", 0, 2.0), ("y", 0, 3.0)], "key string, pos int, value double")
    root = f"file://{tmp_path}/state"
    writers.write_state(s, root)
    assert readers.read_state(spark, root).count() == 3
    import shutil

    shutil.rmtree(tmp_path / "state" / "state")
    assert sorted(r.key for r in readers.read_state(spark, root).collect()) == ["x.lora_A", "x.lora_B"]
    with pytest.raises(FileNotFoundError):
        readers.read_state(spark, f"file://{tmp_path}/nowhere")


def test_ordered_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else "é") for i in (3, 1, 2)], "i int, s string")
    writers.write_jsonl(df, f"file://{tmp_path}/out", ["i"])
    rows = [json.loads(x) for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text().splitlines()]
    assert rows == [{"i": 1}, {"i": 2, "s": "é"}, {"i": 3}]


def test_stream(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    schema = "row_id long, client_id int, source string, client_margin double"
    line = lambda i, m: json.dumps({"row_id": i, "client_id": i % 2, "source": "local_easy", "client_margin": m})
    run = lambda: prepare_stream(stream_pool(spark, f"file://{drop}", schema), Config(5, ("client_margin",)), f"file://{tmp_path}/table", f"file://{tmp_path}/cp").awaitTermination(60)
    (drop / "a.json").write_text(line(1, 0.1) + "\n" + line(2, None))
    assert run()
    (drop / "b.json").write_text(line(3, 0.4))
    assert run()
    got = spark.read.parquet(f"file://{tmp_path}/table")
    assert sorted((r.row_id, r.client_id, r.origin) for r in got.collect()) == [(1, 1, "local"), (3, 1, "local")]
