import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def digest(rows):
    return sorted(tuple(sorted(r.items())) for r in rows)


@pytest.fixture
def same_as_oracle(spark):
    """Holds a query against its DuckDB SQL on the smallest tables."""

    def check(name, sf=SF):
        from currikit.llm import queries

        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        got = digest(r.asDict() for r in queries.QUERIES[name](spark, sf).collect())
        want = con.sql(queries.ORACLES[name])
        names = want.columns
        assert got == digest(dict(zip(names, r, strict=True)) for r in want.fetchall())
        return got

    return check


@pytest.fixture
def docs(spark):
    """A table of documents with an extra column whose name clashes with internal ones."""

    def make(*texts, ids=None):
        rows = [(i, t, "en", f"src{i % 2}" if i is not None else None, len(t) if t is not None else None, "x") for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")

    return make
