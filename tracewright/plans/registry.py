"""The registered queries of the graph engine and their SQL oracles."""

from __future__ import annotations

from . import analysis, edge_checks, fragments, ingest, packages, releases, stored, traversals, worker

_PARTS = (traversals, releases, packages, ingest, analysis, edge_checks, fragments, stored, worker)
QUERIES: dict = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
