"""Registered queries of the library's own operators, with the SQL they are checked against."""

from __future__ import annotations

from .plans import msa_queries, pair_queries, stage_queries

MODULES = (msa_queries, pair_queries, stage_queries)


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
