"""Writers: raw documents and comments, report tables, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stash, unstash


def save_raw(df: DataFrame, path: str, *partitions: str) -> None:
    """Append, laid out by partition columns so that later reads prune."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


#: Folders of a table of events.
PARTS = 64


def save_events(df: DataFrame, path: str, key: str = "event_id") -> None:
    """Put the rows in place of those with the same keys. The table is laid out by a hash of the key; only what holds a key of ``df`` is read and written anew."""
    spark = df.sparkSession
    new = stash(df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")), "events-new")
    out = new
    if exists(spark, path):
        stored = spark.read.parquet(path)
        touched = F.broadcast(new.select("part").distinct())  # PARTS numbers at most
        out = stored.join(touched, "part", "left_semi").join(new.select(key).distinct(), key, "left_anti").unionByName(new)
        out = stash(out, "events-merged")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    unstash(new, out)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """The events table and its three child tables of nested reports; rank is the position; blank names are skipped.

    ``reports``: event_id, title, heat, keywords array<struct<word,weight>>, platforms
    array<struct<platform,ratio>>, trend array<struct<date,cnt>>, future
    array<struct<date,predict_count>>.
    """
    words = reports.select("event_id", F.posexplode("keywords").alias("rank", "k")).where("k.word <> ''").select("event_id", "k.word", "k.weight", "rank")
    platforms = reports.select("event_id", F.posexplode("platforms").alias("rank", "p")).where("p.platform <> ''").select("event_id", "p.platform", "p.ratio", "rank")
    actual = reports.select("event_id", F.explode("trend").alias("t")).select("event_id", "t.date", F.col("t.cnt").cast("double").alias("count"), F.lit(False).alias("is_predicted"))
    future = reports.select("event_id", F.explode("future").alias("t")).select("event_id", "t.date", F.col("t.predict_count").alias("count"), F.lit(True).alias("is_predicted"))
    nested = {"keywords", "platforms", "trend", "future"}
    return {"events": reports.select(*[c for c in reports.columns if c not in nested]), "event_keywords": words, "event_platforms": platforms, "event_trend_daily": actual.unionByName(future)}


def export_events(events: DataFrame, least_heat: float = 5.0) -> DataFrame:
    """Events of at least so much heat, numbered through over their files."""
    from ..operators.lookups import numbered

    return numbered(events.where(F.col("heat") >= least_heat), "file_ix", "pos", name="export_id")
