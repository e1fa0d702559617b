"""Named queries over the driver's tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.plans import exchange, feeds, fusion, places, reports, state, texts

Query = Callable[[SparkSession, str], DataFrame]

_PARTS = (state, exchange, fusion, texts, places, reports, feeds)
QUERIES: dict[str, Query] = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
