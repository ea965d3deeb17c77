"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from . import change_queries, composite_sql, graph_queries, hierarchy_queries, ledger_queries, scalar_queries  # noqa: F401

FLAGSHIP = "p4_found"
MODULES = (scalar_queries, graph_queries, ledger_queries, change_queries)


def queries() -> dict:
    out = dict(hierarchy_queries.queries())
    for m in MODULES:
        out |= m.R.queries
    return out


def oracle_sql() -> dict[str, str]:
    out = dict(hierarchy_queries.oracle_sql())
    for m in MODULES:
        out |= m.R.sql
    return out
