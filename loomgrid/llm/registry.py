"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import importlib

import corpus_pipeline

MODULES = ("sharding", "quality_model", "substrings", "mixing", "html_text", "simhash", "quality_rules", "pii", "language_id", "decontaminate", "lattice", "collocations", "prefix_trie")


def _modules():
    return [importlib.import_module(f"loomgrid.llm.{m}") for m in MODULES]


def queries():
    return {name: q for m in _modules() for name, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    sql = {name: text for m in _modules() for name, text in m.ORACLE_SQL.items()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
