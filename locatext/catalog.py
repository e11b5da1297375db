"""All registered queries of the library, each with its SQL oracle where one exists."""

from __future__ import annotations

from importlib import import_module

from locatext.registry import ORACLE_SQL, QUERIES

for _name in ("text", "search", "relations", "measures", "ranking", "graphs", "folds", "resolution", "documents", "answers", "extensions", "forms", "mails", "projects", "provenance"):
    import_module(f"locatext.plans.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
