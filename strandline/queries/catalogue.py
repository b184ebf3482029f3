"""All queries of the core and their SQL."""

from __future__ import annotations

from strandline.queries import codecs, engine, problems  # noqa: F401 - codecs registers with engine

FLAGSHIP = "aggregate_distribution_q"
QUERIES = {**problems.QUERIES, **engine.QUERIES}
SQL: dict[str, str] = {**problems.SQL, **engine.SQL}
