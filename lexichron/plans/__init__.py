"""Registered queries: ``QUERIES`` by name, and ``SQL`` with the same result in DuckDB's dialect."""
