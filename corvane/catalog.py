"""Registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from corvane.plans import answers, evidence, judging, operations, retrieval, routing, stores

FLAGSHIP = "ret4_bm25_topk"
_MODULES = (retrieval, routing, evidence, operations, answers, judging, stores)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
