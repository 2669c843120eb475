"""All queries of the library's own operators, with the DuckDB SQL that checks them."""

from __future__ import annotations

from currikit.plans import selection_queries, state_queries, text_queries

PARTS = (text_queries, selection_queries, state_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
FLAGSHIP = "win_public_fill"
