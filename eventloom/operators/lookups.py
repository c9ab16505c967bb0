"""List, search and detail queries over stored events, and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import windows_of
from ..sources.tables import stash


def like(column: Column, q: str, escape: bool = False) -> Column:
    """LIKE %q%; wildcards in q are live unless escaped."""
    return column.contains(q) if escape else column.like(f"%{q}%")


def numbered(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """``df`` with the number of each row, from 1, in an order over all rows.

    Rows are dealt by ranges of the order and counted by range; only the counts meet in one place.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    dealt = stash(dealt, "numbered")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    out = dealt.join(F.broadcast(before), "__part").withColumn(name, at + F.col("__before") + 1).drop("__part", "__at", "__before")
    out.stashed_at = dealt.stashed_at
    return out


#: Characters of the index' grams, and folders that its rows are dealt over by gram.
GRAM, GRAM_PARTS = 3, 64


def grams_of(texts: DataFrame, key: str, column: str) -> DataFrame:
    """part, gram, key: each three characters in a row of a text, once a key."""
    grams = F.array_distinct(windows_of(F.coalesce(column, F.lit("")), GRAM))
    return texts.select(F.col(key).alias("key"), F.explode(grams).alias("gram")).distinct().select(_part("gram").alias("part"), "gram", "key")


def _part(gram) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_PARTS)).cast("int")


def save_grams(grams: DataFrame, path: str) -> None:
    """A search then reads only the folders of the grams that it looks for, and in these their row groups."""
    grams.repartition(GRAM_PARTS, "part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(path)


def gram_search(grams: DataFrame, q: str, escape: bool = False) -> DataFrame | None:
    """Keys of texts that have all grams of q, so may hold it; None if q has no three plain characters in a row. Unless escaped, % and _ are wildcards and a backslash makes the next character plain."""
    runs = [""]
    at = 0
    while at < len(q):
        if escape or q[at] not in "%_\\":
            runs[-1] += q[at]
        elif q[at] == "\\" and at + 1 < len(q):
            at += 1
            runs[-1] += q[at]
        else:
            runs.append("")
        at += 1
    found = sorted({r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)})
    if not found:
        return None
    spark = grams.sparkSession
    parts = [r[0] for r in spark.createDataFrame([(g,) for g in found], "gram string").select(_part("gram")).distinct().collect()]
    hits = grams.where(F.col("part").isin(parts) & F.col("gram").isin(found))
    return hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(found)).select("key")


def list_filter(events: DataFrame, keywords: DataFrame, risk: str | None = None, q: str | None = None, escape: bool = False, title_grams: DataFrame | None = None, word_grams: DataFrame | None = None) -> DataFrame:
    """Events of a risk level whose title or any keyword holds q.

    With the indexes of titles by event_id and of keywords by word (``grams_of``), only rows that
    they name are compared with q; results are the same.
    """
    out = events.where(F.col("risk_level") == risk) if risk else events
    if q:
        titled = gram_search(title_grams, q, escape) if title_grams is not None else None
        worded = gram_search(word_grams, q, escape) if word_grams is not None else None
        if worded is not None:
            keywords = keywords.join(worded.withColumnRenamed("key", "word"), "word", "left_semi")
        named = keywords.where(like(F.col("word"), q, escape)).select("event_id").distinct()
        if titled is not None:
            found = out.join(titled.withColumnRenamed("key", "event_id"), "event_id", "left_semi").where(like(F.col("title"), q, escape)).select("event_id")
            return out.join(found.unionByName(named).distinct(), "event_id", "left_semi")
        named = named.withColumn("__named", F.lit(True))
        out = out.join(named, "event_id", "left").where(like(F.col("title"), q, escape) | F.col("__named")).drop("__named")
    return out


def list_filter_demo(events: DataFrame, q: str | None = None, risk: str | None = None, since_s: int | None = None) -> DataFrame:
    """As shown in the demo: q also in category and location, "high" takes in "mid_high", and a time range."""
    out = events
    if q:
        out = out.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")).contains(q) for c in ("title", "category", "location")]))
    if risk:
        out = out.where(F.col("risk_level").isin(["high", "mid_high"] if risk == "high" else [risk]))
    return out.where(F.col("time_end_s") >= since_s) if since_s is not None else out


def high_risk(events: DataFrame) -> DataFrame:
    """Events of the two upper levels with their order: by level, then heat."""
    tier = F.when(F.col("risk_level") == "high", 0).otherwise(1)
    return numbered(events.where(F.col("risk_level").isin("high", "mid_high")), tier, F.desc("heat"), "event_id")


def min_heat(events: DataFrame, least: float = 5.0) -> DataFrame:
    return events.where(F.col("heat") >= least)


def list_events(events: DataFrame, keywords: DataFrame, page: int = 1, size: int = 10, sort: str = "heat") -> DataFrame:
    """One page of events, largest ``sort`` first and nulls last, each with the total, the pages and its first eight keywords."""
    order = [F.desc_nulls_last({"heat": "heat", "time": "time_end_s", "negative": "negative"}[sort]), F.asc("event_id")]
    total = events.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"))
    rows = events.orderBy(*order).offset((page - 1) * size).limit(size)
    words = keywords.where("rank < 8").join(rows.select("event_id"), "event_id", "left_semi").groupBy("event_id")
    words = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    return rows.join(words, "event_id", "left").join(F.broadcast(total)).withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def event_detail(events: DataFrame, keywords: DataFrame, platforms: DataFrame, trend: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each event with its children as ordered arrays; ``trend_daily`` has the actual days, then the predicted ones."""

    def children(df: DataFrame, order: str, name: str, *columns: str) -> DataFrame:
        kept = F.transform(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))), lambda x: F.struct(*[x[c].alias(c) for c in columns]))
        return df.groupBy("event_id").agg(kept.alias(name))

    actual = trend.select("event_id", "date", F.col("cnt").cast("double").alias("count"), F.lit(False).alias("is_predicted"))
    future = predicted.select("event_id", "date", F.col("predict_count").alias("count"), F.lit(True).alias("is_predicted"))
    days = actual.unionByName(future).withColumn("order", F.struct("is_predicted", "date"))
    out = events.join(children(keywords, "rank", "keywords", "word", "weight"), "event_id", "left").join(children(platforms, "rank", "platforms", "platform", "ratio"), "event_id", "left")
    return out.join(children(days, "order", "trend_daily", "date", "count", "is_predicted"), "event_id", "left")


def similar_reason(pairs: DataFrame) -> DataFrame:
    """Why two events are alike: overlap of titles, keywords and contents (arrays ``x`` and ``x_b``)."""
    parts = [F.when(F.arrays_overlap(c, f"{c}_b"), F.lit(label)) for c, label in (("title_tokens", "标题"), ("keyword_tokens", "关键词"), ("content_tokens", "内容"))]
    joined = F.concat_ws("、", *parts)
    return pairs.withColumn("reason", F.when(joined != "", F.concat(joined, F.lit("相似"))).otherwise("文本特征相似"))


def comments_of_docs(comments: DataFrame, docs: DataFrame) -> DataFrame:
    return comments.join(docs.select(F.col("doc_id").alias("parent_post_id")), "parent_post_id", "left_semi")


def new_rows(rows: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Distinct key values of ``rows`` that ``stored`` lacks."""
    return rows.select(*keys).distinct().join(stored.select(*keys).distinct(), list(keys), "left_anti")


def accuracy_by(pairs: DataFrame, kind: str = "kind") -> DataFrame:
    """Share of rows of each kind whose ``predicted`` is their ``label``: how a model fares on data that it was not made for."""
    return pairs.groupBy(kind).agg(F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 4).alias("accuracy"))


def conv_history(messages: DataFrame) -> DataFrame:
    """conv_id, history: role and text of each turn, in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("history"))


def pending_batch(docs: DataFrame, most: int = 100) -> DataFrame:
    """The next raw documents, oldest first, then by id."""
    return docs.where("clean_status = 'raw'").orderBy("publish_s", "doc_id").limit(most)


def profile_prefs(users: DataFrame, prefs: DataFrame, sources: DataFrame) -> DataFrame:
    """Users with their preferences (empty where there are none) and counts of their sources by status."""
    none = F.array().cast("array<string>")
    counts = sources.groupBy("user_id").agg(F.count_if(F.col("status") == "normal").alias("n_normal"), F.count_if(F.col("status") == "limited").alias("n_limited"), F.count(F.lit(1)).alias("n_sources"))
    out = users.join(prefs, "user_id", "left").join(counts, "user_id", "left")
    return out.withColumns({"fields": F.coalesce("fields", none), **{c: F.coalesce(c, F.lit(0)) for c in ("n_normal", "n_limited", "n_sources")}})


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_trend(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Actual and predicted days with a flag and their position: the actual ones first."""
    both = union_all(actual.withColumn("is_predicted", F.lit(False)), predicted.withColumn("is_predicted", F.lit(True)))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("event_id").orderBy("is_predicted", "date")))


def classif_metrics(pairs: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 and the accuracy of ``label`` against ``predicted``; 0 where nothing is to divide by."""
    cells = pairs.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    by = lambda c: cells.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(f"of_{c}"))
    hits = cells.where("label = predicted").select(F.col("label").alias("k"), F.col("n").alias("hit"))
    all_ = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    t = by("label").join(by("predicted"), "k", "full_outer").join(hits, "k", "left").na.fill(0).join(F.broadcast(all_))
    p, r = F.when(F.col("of_predicted") > 0, F.col("hit") / F.col("of_predicted")).otherwise(0.0), F.when(F.col("of_label") > 0, F.col("hit") / F.col("of_label")).otherwise(0.0)
    t = t.withColumns({"p": p, "r": r})
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return t.select(F.col("k").alias("label"), F.col("of_label").alias("support"), F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"), F.round(F.col("right") / F.col("total"), 4).alias("accuracy"))


def run_stats(results: DataFrame) -> DataFrame:
    """success, skip and fail by platform and keyword, with totals (null) above."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("success", "skip", "fail")]
    return results.rollup("platform", "keyword").agg(*counts, F.grouping_id().cast("long").alias("level"))


def zero_streaks(runs: DataFrame, warn: int = 3) -> DataFrame:
    """Runs (``pos``, ``n``) that end a streak of at least so many without results."""
    groups = runs.withColumn("g", F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(Window.partitionBy("platform").orderBy("pos")))
    z = groups.where("n = 0").withColumn("streak", F.row_number().over(Window.partitionBy("platform", "g").orderBy("pos")))
    return z.where(F.col("streak") >= warn).select("platform", "pos", F.col("streak").cast("long").alias("streak"))
