"""Registered queries and their reference SQL, both over the given tables."""

from urlrisk.queries.oracles import oracle_sql
from urlrisk.queries.registry import queries

__all__ = ["oracle_sql", "queries"]
