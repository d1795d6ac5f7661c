"""Registered queries and their SQL."""

from __future__ import annotations

from .plans import canonical, model, ranking, report, support, survival

_MODULES = (canonical, survival, model, support, ranking, report)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
