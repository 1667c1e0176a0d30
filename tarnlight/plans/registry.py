"""Registered queries of the core and their SQL."""

from __future__ import annotations

from tarnlight.plans import aggregates, catalog, extras, search, streams
from tarnlight.plans.base import Query

_MODULES = [catalog, aggregates, search, streams, extras]
QUERIES: dict[str, Query] = {n: q for m in _MODULES for n, q in m.catalogue.queries.items()}
SQL: dict[str, str] = {n: s for m in _MODULES for n, s in m.catalogue.sql.items()}
