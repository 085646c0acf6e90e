"""Registered queries of the alignment operators and their SQL."""

from __future__ import annotations

from twinroute.plans import cohort_queries, position_queries, read_queries, route_queries

QUERIES: dict = {**read_queries.QUERIES, **position_queries.QUERIES, **cohort_queries.QUERIES, **route_queries.QUERIES}

ORACLES: dict[str, str] = {**read_queries.ORACLES, **position_queries.ORACLES, **cohort_queries.ORACLES, **route_queries.ORACLES}
