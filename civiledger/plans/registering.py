"""How a module of queries lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: The ledger in SQL.
LEDGER = """(SELECT o_orderkey AS entry_id, o_custkey AS payee_id, o_orderstatus AS kind, CAST(o_totalprice AS DECIMAL(18,2)) AS value,
 CAST(o_orderdate AS DATE) AS entry_date, CAST(year(o_orderdate) AS INT) AS fiscal_year, o_orderpriority AS unit FROM orders)"""
CONDITIONAL = """CAST(coalesce(sum(CASE WHEN coalesce(kind, '') NOT ILIKE 'P%' AND coalesce(kind, '') NOT ILIKE 'O%' THEN value ELSE 0 END), 0) AS DOUBLE) AS ordinary_sum,
 CAST(coalesce(sum(CASE WHEN coalesce(kind, '') ILIKE 'O%' THEN value ELSE 0 END), 0) AS DOUBLE) AS estimate_sum,
 count(*) FILTER (WHERE coalesce(kind, '') NOT ILIKE 'P%' AND coalesce(kind, '') NOT ILIKE 'O%') AS n_ordinary"""


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[query.__name__] = query
            if oracle is not None:
                self.oracles[query.__name__] = oracle
            return query

        return keep
