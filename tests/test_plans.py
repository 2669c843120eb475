"""What the plans of headline queries look like."""

import re

import pytest

from currikit.plans import registry

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["win_public_fill", "curriculum_round_2", "win_mixed_cap"])
def test_selection_is_bounded_before_the_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert "WindowGroupLimit" in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 3
    assert not re.search("CartesianProduct|NestedLoop|Python|Pandas|Arrow|SinglePartition", plan)


def test_columns_are_pruned_and_filters_pushed(spark):
    plan = plan_of(spark, "win_public_fill")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert "ts:" not in schema and "user_id:" in schema
    assert "PushedFilters: [In(lang, [de,en])]" in plan_of(spark, "flt_language_in")


@pytest.mark.parametrize("name", [q for q in registry.ORACLES if not q.startswith(("ext_", "join_zip", "fed_fuse", "ctl_", "sink_", "scan_", "resolve_"))])
def test_checked_queries_stay_in_the_jvm(spark, name):
    plan = plan_of(spark, name)
    assert not re.search("MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|CartesianProduct|NestedLoop", plan), plan


def test_state_oracles_end_under_a_limit():
    """A limit above a join of a view with itself once kept DuckDB busy without end."""
    import threading

    import duckdb

    from currikit.plans import registry

    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    names = [n for n, sql in registry.ORACLES.items() if "px_state" in sql]
    assert len(names) > 20
    for name in names:
        timer = threading.Timer(20, con.interrupt)
        timer.start()
        con.execute(f"SELECT * FROM ({registry.ORACLES[name]}) t LIMIT 1000000").fetchall()
        timer.cancel()
