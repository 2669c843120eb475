"""Removal of repeated passages by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from currikit.llm.common import WORD, fields, let

#: Consecutive lines to a window.
WINDOW = 3


def _lines(text: Column) -> Column:
    """The lines with a word, as structs of their place among all lines and their text without outer white space."""
    placed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(" \t\x0b\x0c\r")).alias("x")))
    return F.filter(placed, lambda p: p["x"] != "")


def windows(text: Column, size: int = WINDOW) -> Column:
    """The windows of a text: two 64-bit hashes of the lines, first and last place.

    A text of fewer lines has one window of all of them; one without words has none.
    """

    def of(lines: Column) -> Column:
        k = F.least(F.size(lines), F.lit(size))

        def window(j: Column) -> Column:
            xs = F.transform(F.slice(lines, j + 1, k), lambda p: p["x"])
            joined = F.array_join(xs, "\n")
            return F.struct(
                F.xxhash64(joined).alias("h1"),
                F.xxhash64(F.lit("second"), joined).alias("h2"),
                F.get(lines, j)["i"].alias("first"),
                F.get(lines, j + k - 1)["i"].alias("last"),
            )

        return F.when(F.size(lines) > 0, F.transform(F.sequence(F.lit(0), F.size(lines) - k), window)).otherwise(F.array())

    return let(_lines(text), of)


def _row_key(id_col: str, text_col: str) -> Column:
    """The id and a hash of the text: rows that share an id but not the text are documents of their own."""
    return F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``(key, ranges)``: the ranges of lines that later occurrences of windows cover, for documents that have any.

    Occurrences are counted by hash with partial sums, and hashes with one
    occurrence go no further. The others meet their occurrences in a join by
    hash, which adaptive execution splits where a passage is in very many
    documents; a document gathers its own ranges only. The first occurrence is
    that with the least (key, place).
    """
    found = docs.where(F.col(id_col).isNotNull()).select(_row_key(id_col, text_col).alias("key"), F.explode(windows(F.col(text_col), size)).alias("w")).select("key", "w.*")
    place = F.struct("key", "first")
    repeated = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("earliest")).where("n > 1").drop("n")
    later = found.join(repeated, ["h1", "h2"]).where(place > F.col("earliest"))
    return later.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("ranges"))


def _merged(ranges: Column) -> Column:
    """Ranges in order, joined where they meet. Windows that start later end later, so a range begins anew where it starts beyond the one before."""
    starts = F.filter(ranges, lambda r, j: (j == 0) | (F.get(ranges, j - 1)["last"] < r["first"] - 1))
    ends = F.filter(ranges, lambda r, j: (j == F.size(ranges) - 1) | (F.get(ranges, j + 1)["first"] > r["last"] + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["first"].alias("first"), b["last"].alias("last")))


def _without(lines: Column, gone: Column) -> Column:
    """The lines before the first range, between two, and after the last, as a text."""

    def between(j: Column) -> Column:
        begin = F.coalesce(F.get(gone, j - 1)["last"] + 1, F.lit(0))
        return F.slice(lines, begin + 1, F.coalesce(F.get(gone, j)["first"], F.size(lines)) - begin)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), between)), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with later occurrences of repeated three-line windows removed from their texts, and ``n_removed`` lines (long).

    Lines count when they have a word; they are compared without outer ASCII
    white space. A window is three consecutive such lines (a shorter text: all
    of them). Every occurrence of a window but the first in (doc_id, place)
    order is covered, with blank lines inside it; covered places of a document
    are merged and removed. The content of each removed line stays at an earlier
    place.

    All columns of docs stay (``n_removed`` replaces one of that name). A null
    text stays null, and a null id keeps its text: such rows neither give nor
    lose lines. Equal rows count as one document and come out equal; rows that
    share an id but not the text are documents of their own. An empty table
    gives an empty result.
    """
    ranges = covered_lines(docs, id_col, text_col, size).select("key", _merged(F.col("ranges")).alias("gone"))
    joined = docs.select(F.struct("*").alias("row"), _row_key(id_col, text_col).alias("key")).join(ranges, "key", "left")
    text = F.col("row")[text_col]
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(let(F.split(text, "\n"), lambda lines: _without(lines, F.col("gone"))))
    removed = F.aggregate(F.coalesce("gone", F.array().cast("array<struct<first:int,last:int>>")), F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return joined.select(*fields("row", [c for c in docs.columns if c != "n_removed"], **{text_col: cleaned}), removed.alias("n_removed"))


def oracle() -> str:
    """The same in DuckDB for ``documents``, without the hashes: windows are compared as texts."""
    return rf"""
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, i, trim(ls[i + 1], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x FROM l WHERE regexp_matches(ls[i + 1], '{WORD}')),
k AS (SELECT doc_id, x, i, row_number() OVER o AS j, count(*) OVER (PARTITION BY doc_id) AS n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT doc_id, i AS first, list(x) OVER o AS xs, max(i) OVER o AS last, j, n FROM k
        WINDOW o AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
full_win AS (SELECT doc_id, first, last, array_to_string(xs, chr(10)) AS xs FROM win WHERE j + {WINDOW - 1} <= n OR (n < {WINDOW} AND j = 1)),
later AS (SELECT doc_id, first, last FROM full_win QUALIFY row_number() OVER (PARTITION BY xs ORDER BY doc_id, first) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later),
kept AS (SELECT l.doc_id, string_agg(l.ls[l.i + 1], chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(g.i) AS n_removed
         FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_removed, 0) AS n_removed, CASE WHEN k.n_removed > 0 THEN coalesce(k.text, '') ELSE d.text END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""
