"""The registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from .base import QUERIES, SQL

for _part in ("select", "joining", "grouping", "scalars", "models", "streams", "builder"):
    import_module(f"{__name__}.{_part}")

__all__ = ["QUERIES", "SQL"]
