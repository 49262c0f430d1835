"""All registered queries of the engine."""

from __future__ import annotations

from .plans import graphs, knowledge, numeric, structures

_ALL = {**numeric.QUERIES, **graphs.QUERIES, **knowledge.QUERIES, **structures.QUERIES}


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
