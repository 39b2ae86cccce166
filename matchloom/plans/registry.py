"""All queries of the engine and their SQL."""

from __future__ import annotations

from matchloom.plans import corpus, features, reports, service, splitting, state

_PARTS = (corpus, features, reports, service, splitting, state)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
