"""Registered queries (``catalog``) and their DuckDB oracles (``oracle``)."""
