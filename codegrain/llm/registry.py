"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

import importlib

MODULES = ("chat", "topk", "secret_scan", "toxicity", "mixing", "simhash", "nbsvm", "suffix", "packing", "outliers")
_LOADED = [importlib.import_module(f"codegrain.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _LOADED for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _LOADED for k, q in m.ORACLE.items()}
