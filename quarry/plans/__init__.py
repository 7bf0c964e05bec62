"""Registered queries of the engine's own operators."""

from . import code_queries, context_queries, graph_queries, selection_queries, state_queries, store_queries

_MODULES = (graph_queries, state_queries, code_queries, selection_queries, store_queries, context_queries)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
