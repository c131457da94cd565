"""Every registered query and, where SQL can say it, its DuckDB statement."""

from __future__ import annotations

from . import file_queries, graph_queries, model_queries, text_queries

_MODULES = (text_queries, graph_queries, model_queries, file_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
