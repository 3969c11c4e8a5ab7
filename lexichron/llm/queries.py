"""Queries over the problems tagged llm, by name, and their SQL where there is one."""

from __future__ import annotations

from importlib import import_module

_PARTS = ("terms_queries", "name_queries", "token_queries", "sentence_queries", "language_queries")

QUERIES: dict = {}
SQL: dict = {}
for _part in _PARTS:
    _module = import_module(f"lexichron.llm.{_part}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
