"""Registered queries over the given tables, each with the SQL that an independent engine can check it by."""

from __future__ import annotations

from . import layout, lines, shapes, work

_PARTS = (lines, shapes, layout, work)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
