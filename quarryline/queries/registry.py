"""A table of queries; each is registered with its SQL counterpart, if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql is not None:
                self.oracles[function.__name__] = sql
            return function

        return add


#: The first delivery of each file, as SQL.
FILES = "files AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ingested_at) AS delivery FROM dataset WHERE file_id IS NOT NULL) WHERE delivery = 1)"
FRAGMENTS = "fragments AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY emb_id ORDER BY ingested_at) AS delivery FROM embedding WHERE emb_id IS NOT NULL) WHERE delivery = 1)"
#: The latest record of each file, as SQL.
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC, status NULLS LAST) AS n FROM source_evidence WHERE file_id IS NOT NULL AND scanned_at IS NOT NULL) WHERE n = 1)"
