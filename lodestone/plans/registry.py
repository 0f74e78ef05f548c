"""All registered queries: name -> (query(spark, sf_dir), the same result as SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from . import case_queries, job_queries, page_queries, rule_queries, search_queries, store_queries

    return page_queries.QUERIES | rule_queries.QUERIES | case_queries.QUERIES | job_queries.QUERIES | search_queries.QUERIES | store_queries.QUERIES
