"""The registry of the core's queries and of their SQL."""

from __future__ import annotations

from twinweave.plans import reference_queries, skewed

FLAGSHIP = "clone_pairs_normalised"

QUERIES = {**reference_queries.QUERIES, **skewed.QUERIES}
SQL = {**reference_queries.SQL, **skewed.SQL}
