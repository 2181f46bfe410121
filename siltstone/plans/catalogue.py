"""Registered queries of the library and their SQL."""

from __future__ import annotations

from siltstone.plans import aggregates, code, governance, graphs, isolations, joins, projects, records, security, texts

FAMILIES = (joins, aggregates, graphs, texts, records, governance, isolations, code, security, projects)
QUERIES = {name: f for family in FAMILIES for name, f in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in FAMILIES for name, sql in family.ORACLE_SQL.items()}
