"""All queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from . import execution_queries, graph_queries, market_queries, message_queries, reaction_queries, research_queries, source_queries, strategy_queries, stream_queries, wallet_queries

MODULES = (wallet_queries, market_queries, research_queries, strategy_queries, execution_queries, message_queries, graph_queries, reaction_queries, source_queries, stream_queries)
QUERIES: dict = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: query for m in MODULES for name, query in m.ORACLE_SQL.items()}
FLAGSHIP = "top_wallets"
