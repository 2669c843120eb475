"""The driver's entry points, with and without the optional parts."""

import importlib
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert oracles.keys() <= queries.keys() and len(queries) > 150
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in oracles.values())


def test_without_optional_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("currikit.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "currikit.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delattr("currikit.llm", raising=False)
    bare = importlib.reload(entry)
    try:
        assert not any(q.startswith("op") or q == "pipeline" for q in bare.queries()) and bare.oracle_sql()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
