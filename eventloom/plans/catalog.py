"""All registered queries of the event engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import composites, events, landing, scalars, trends

Query = Callable[[SparkSession, str], DataFrame]
PARTS = [trends, scalars, events, landing, composites]


def _widened(query: Query) -> Query:
    """Whole numbers of a result as long ones, as the SQL twins have them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.select(*[F.col(f"`{c}`").cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(f"`{c}`") for c, kind in out.dtypes])

    return run


def queries() -> dict[str, Query]:
    return {name: _widened(query) for part in PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.ORACLE.items()}
