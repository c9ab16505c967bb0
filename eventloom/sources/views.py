"""The driver's tables as posts, comments, activity and labelled texts, with the SQL of the same views.

Columns that the tables lack (times, platforms, tiers, counts) follow from the ids by the
same arithmetic in both dialects. Times are epoch seconds in UTC, so that no session time
zone plays a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, SPAN = 1704067200, 2592000
AS_OF = START + 20 * 86400
PLATFORMS = ["微博", "知乎", "新浪新闻", "人民网", "澎湃新闻"]
TIERS = ["官方平台", "认证机构", "头部认证个人", "认证个人", "普通用户", None, "官方机构"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(column, values):
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        if v is not None:
            out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        i.alias("seq"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        (F.lit(START).cast("long") + i * 2220 % SPAN).alias("publish_s"),
        "source",
        F.col("source").alias("event_id"),
        _pick(i % 5, PLATFORMS).alias("platform"),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("user"), (i % 97).cast("string"))).alias("author"),
        _pick(i % 7, TIERS).alias("verification_type"),
        (i % 11).alias("repost_count"),
        (i % 23).alias("like_count"),
        (i % 3).alias("comment_count"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns; each is a comment on the post whose id is the conversation's."""
    return (
        table(spark, sf_dir, "conversations")
        .where("role = 'user'")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"), F.col("conv_id").alias("parent_post_id"), F.col("text").alias("content"))
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post times by event."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("e"), (F.col("user_id") % 40).cast("string")).alias("event_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("publish_s"))


def _case(column: str, values) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v is not None) + " END"


VIEWS = {
    "posts": f"""posts AS (SELECT doc_id, doc_id AS seq, split_part(text, chr(10), 1) AS title, text AS content,
  {START}::BIGINT + doc_id * 2220 % {SPAN} AS publish_s, source, source AS event_id, {_case("doc_id % 5", PLATFORMS)} AS platform,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'user' || (doc_id % 97)::VARCHAR END AS author, {_case("doc_id % 7", TIERS)} AS verification_type,
  doc_id % 11 AS repost_count, doc_id % 23 AS like_count, doc_id % 3 AS comment_count FROM documents)""",
    "comments": "comments AS (SELECT conv_id * 1000 + turn AS comment_id, conv_id AS parent_post_id, text AS content FROM conversations WHERE role = 'user')",
    "activity": "activity AS (SELECT 'e' || (user_id % 40)::VARCHAR AS event_id, floor(epoch(ts))::BIGINT AS publish_s FROM events)",
}


def sql(views: list[str], body: str, *ctes: str) -> str:
    """A query over views and further common table expressions."""
    return "WITH RECURSIVE " + ", ".join([*(VIEWS[v] for v in views), *ctes]) + " " + body
