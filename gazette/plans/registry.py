"""All reference queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gazette.plans import board_queries, calendar_queries, card_queries, completeness_queries, feed_queries, notice_queries, page_queries, record_queries, review_queries, sink_queries, site_queries, state_queries, stream_queries, table_queries, text_queries, title_queries

_ALL = {**text_queries.QUERIES, **table_queries.QUERIES, **state_queries.QUERIES, **board_queries.QUERIES, **notice_queries.QUERIES, **review_queries.QUERIES, **record_queries.QUERIES, **sink_queries.QUERIES, **stream_queries.QUERIES, **completeness_queries.QUERIES, **page_queries.QUERIES, **site_queries.QUERIES, **feed_queries.QUERIES, **card_queries.QUERIES, **title_queries.QUERIES, **calendar_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
