"""All registered queries and their oracle SQL."""

from __future__ import annotations

from opsight.plans import cost, failures, maintenance, planning, root_cause, router, serving, sinks, storage, utilization

GROUPS = [failures, cost, utilization, serving, maintenance, router, root_cause, planning, sinks, storage]


def all_queries() -> dict:
    return {name: q for group in GROUPS for name, q in group.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLE.items()}
