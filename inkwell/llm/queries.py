"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("terms", "sentences", "lookalike", "markup", "codetext", "packing", "mixing", "quality")


def _parts():
    return [import_module(f"inkwell.llm.{m}") for m in _MODULES]


def queries():
    return {k: v for m in _parts() for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _parts() for k, v in m.SQL.items()}
