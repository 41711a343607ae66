"""Operators for training-data pipelines.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
gather what its modules register.
"""

from __future__ import annotations

from . import bpe_codec, collocations, filter_audit, language_id, line_dedup, media_columns, minhash_forest, packing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_rollup

MODULES = (quality_rules, suffix_dedup, packing, line_dedup, substring_dedup, token_rollup, language_id, simhash_dedup, media_columns, bpe_codec, minhash_forest, collocations, filter_audit)


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
