"""What the operators share: table access, shared-folder tables, Arrow streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, stash, unstash  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsigned_crc32(column: Column) -> Column:
    """crc32 of the UTF-8 bytes; null counts as the empty text."""
    return F.crc32(F.coalesce(column, F.lit("")))


def hidden(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have."""
    name = f"__{stem}"
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches cut to at most so many rows, so that what Python builds from one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
