"""Queries of the subpackage and their SQL twins."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}
for _m in ("percentile_queries", "packing_queries", "confusable_queries", "leak_queries", "quality_queries", "lexicon_queries"):
    _mod = importlib.import_module(f"weftline.llm.{_m}")
    QUERIES.update(_mod.QUERIES)
    SQL.update(_mod.SQL)
