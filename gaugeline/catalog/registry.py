"""Registration of queries next to their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.functions.numbers import half_up


class Registry:
    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def __call__(self, name: str, oracle: str | None = None):
        def keep(query):
            self.queries[name] = query
            if oracle is not None:
                self.oracles[name] = oracle
            return query

        return keep


def named(ctes: str, query: str) -> str:
    """A query with subqueries of its own; the shared views go before them."""
    return f"/*with*/{ctes}/*end*/{query}"


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: half_up(F.col(c), digits) for c in columns})
