"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from . import aggregates, changes, extensions, joins, meta, scalars, scans, search

QUERIES: dict = {}
ORACLES: dict = {}
for family in (scans, aggregates, joins, scalars, search, changes, meta, extensions):
    QUERIES.update(family.q.queries)
    ORACLES.update(family.q.oracles)
