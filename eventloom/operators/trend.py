"""Counts over time by event: heat, trends, lifecycle, change-points and forecasts.

All operators take ``event_id`` and ``publish_s`` (epoch seconds) or a count series
(``event_id``, ``ix``, ``cnt``; ix from 0) and are partitioned by the event. Raw rows are
reduced by partial aggregation first; windows then run over an event's buckets only,
whose number the recent window bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stash
from ..values import STAGES

DAY, HOUR = 86400, 3600


def recent_window(posts: DataFrame, days: float = 45) -> DataFrame:
    """Rows within so many days of their event's last one."""
    # Written, so that its size is known and posts aren't exchanged by event, with their texts, for a row an event.
    last = stash(posts.groupBy("event_id").agg((F.max("publish_s") - int(days * DAY)).alias("__from")), "last")
    return posts.join(last, "event_id").where("publish_s >= __from").drop("__from")


def time_span(posts: DataFrame) -> DataFrame:
    return posts.groupBy("event_id").agg(*span_columns())


def span_columns() -> list[Column]:
    return [F.min("publish_s").alias("time_start_s"), F.max("publish_s").alias("time_end_s")]


def heat(posts: DataFrame, as_of: int, half_life_hours: float = 24) -> DataFrame:
    """Sum of decayed weights; posts after ``as_of`` count 1."""
    return posts.groupBy("event_id").agg(heat_column(as_of, half_life_hours))


def heat_column(as_of: int, half_life_hours: float = 24) -> Column:
    """The aggregate of ``heat``, so that it can share a pass with others."""
    return F.round(F.sum(decayed(as_of, half_life_hours)), 3).alias("heat")


def decayed(as_of: int, half_life_hours: float = 24) -> Column:
    age = F.greatest(F.lit(as_of) - F.col("publish_s"), F.lit(0)) / float(HOUR)
    return F.exp(-F.log(F.lit(2.0)) * age / half_life_hours)


def day_facts(posts: DataFrame, as_of: int, half_life_hours: float = 24) -> DataFrame:
    """event_id, platform, day, n, weight: counts and decayed weights, from which heat, platforms and days follow without another pass over the posts."""
    return posts.groupBy("event_id", "platform", F.floor(F.col("publish_s") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(decayed(as_of, half_life_hours)).alias("weight"))


def heat_of(facts: DataFrame) -> DataFrame:
    return facts.groupBy("event_id").agg(F.round(F.sum("weight"), 3).alias("heat"))


def daily_trend(posts: DataFrame) -> DataFrame:
    """event_id, ix, date, cnt for each calendar day from the first to the last, days without posts included."""
    return daily_of(posts.groupBy("event_id", F.floor(F.col("publish_s") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n")))


def daily_of(facts: DataFrame) -> DataFrame:
    """``daily_trend`` of counts ``n`` by event_id, day and perhaps more."""
    days = facts.groupBy("event_id", "day").agg(F.sum("n").alias("cnt"))
    span = days.groupBy("event_id").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    grid = span.select("event_id", "first", F.explode(F.sequence("first", "last")).alias("day"))
    out = grid.join(days, ["event_id", "day"], "left")
    return out.select("event_id", (F.col("day") - F.col("first")).alias("ix"), F.date_from_unix_date(F.col("day").cast("int")).alias("date"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def bucket_counts(posts: DataFrame, hours: int = 6, now: int | None = None) -> DataFrame:
    """event_id, ix, start_s, cnt: buckets of fixed width from the event's first post to ``now`` or its last post.

    Posts past the last bucket fall into it.
    """
    width = hours * HOUR
    span = posts.groupBy("event_id").agg(F.min("publish_s").alias("first"), F.max("publish_s").alias("last"))
    end = F.lit(now) if now is not None else F.col("last")
    span = span.withColumn("n", F.greatest(((end - F.col("first")) / width).cast("long") + 1, F.lit(1)))
    span = stash(span, "span")  # its size is known then, so posts are counted before they are exchanged by event
    ix = F.least(F.floor((F.col("publish_s") - F.col("first")) / width), F.col("n") - 1)
    cnt = posts.join(span, "event_id").groupBy("event_id", ix.alias("ix")).agg(F.count(F.lit(1)).alias("cnt"))
    grid = span.select("event_id", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("ix"))
    return grid.join(cnt, ["event_id", "ix"], "left").select("event_id", "ix", (F.col("first") + F.col("ix") * width).alias("start_s"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def changepoints(counts: DataFrame, z: float = 1.5) -> DataFrame:
    """event_id, ix of buckets whose step from the one before is so many deviations off the mean step."""
    w = Window.partitionBy("event_id")
    steps = counts.withColumn("diff", F.col("cnt") - F.lag("cnt").over(w.orderBy("ix"))).withColumn("n", F.count(F.lit(1)).over(w))
    steps = steps.withColumn("mean", F.avg("diff").over(w)).withColumn("sd", F.stddev_pop("diff").over(w))
    return steps.where((F.col("n") >= 3) & (F.col("sd") > 0) & (F.abs(F.col("diff") - F.col("mean")) / F.col("sd") >= z)).select("event_id", "ix")


def lifecycle_stage(counts: DataFrame, quiet: int = 1, decline: float = 0.5) -> DataFrame:
    """event_id, n, stage: latent, growth, peak or decline."""
    w = Window.partitionBy("event_id").orderBy("ix")
    shape = (
        counts.withColumn("before", F.lag("cnt").over(w))
        .groupBy("event_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("cnt").alias("peak"),
            F.max_by("ix", F.struct("cnt", -F.col("ix"))).alias("peak_ix"),
            F.max("ix").alias("last_ix"),
            F.max_by("cnt", "ix").alias("latest"),
            F.max_by("before", "ix").alias("before"),
        )
    )
    stage = (
        F.when(F.col("peak") <= quiet, "latent")
        .when((F.col("peak_ix") < F.col("last_ix")) & (F.col("latest") <= F.col("peak") * decline), "decline")
        .when(F.col("peak_ix") < F.col("last_ix"), "peak")
        .when(F.col("latest") > F.col("before"), "growth")
        .otherwise("peak")
    )
    return shape.select("event_id", "n", stage.alias("stage"))


def lifecycle_proba(stages: DataFrame) -> DataFrame:
    """Confidence by the number of buckets; what is left goes to the neighbouring stages."""
    sure = F.least(F.lit(0.5) + 0.1 * F.col("n"), F.lit(0.9))
    at = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int")
    rest = (1 - sure) / F.when(at.isin(1, len(STAGES)), 1).otherwise(2)
    shares = [F.round(F.when(at == k, sure).when(F.abs(at - k) == 1, rest).otherwise(0.0), 3).alias(f"p_{s}") for k, s in enumerate(STAGES, 1)]
    return stages.select("event_id", "stage", F.round(sure, 3).alias("confidence"), *shares)


def forecast(daily: DataFrame, horizon: int = 3) -> DataFrame:
    """event_id, step, date, predict_count: the slope of the last three days carried on."""
    w = Window.partitionBy("event_id").orderBy(F.desc("ix"))
    last = (
        daily.withColumn("rn", F.row_number().over(w))
        .where("rn <= 3")
        .groupBy("event_id")
        .agg(F.max("date").alias("last_date"), F.max_by("cnt", "ix").alias("latest"), F.min_by("cnt", "ix").alias("oldest"), F.count(F.lit(1)).alias("n"))
    )
    slope = (F.col("latest") - F.col("oldest")) / F.greatest(F.col("n") - 1, F.lit(1))
    steps = last.withColumn("slope", slope).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select("event_id", "step", F.date_add("last_date", F.col("step")).alias("date"), F.round(F.greatest(F.lit(0.0), F.col("latest") + F.col("slope") * F.col("step")), 1).alias("predict_count"))


def event_time(daily: DataFrame) -> DataFrame:
    """Noon of the first day with most posts."""
    return daily.groupBy("event_id").agg(F.concat(F.max_by("date", F.struct("cnt", -F.col("ix"))).cast("string"), F.lit("T12:00:00")).alias("event_time"))


def trend_trim(series: DataFrame, context: int = 1, least: int = 6) -> DataFrame:
    """The series without its flat head: ``context`` points stay before the first move, at least ``least`` in all."""
    w = Window.partitionBy("event_id")
    o = w.orderBy("ix")
    s = series.withColumns({"n": F.count(F.lit(1)).over(w), "top": F.max("cnt").over(w), "low": F.min("cnt").over(w), "base": F.first("cnt").over(o), "before": F.lag("cnt").over(o)})
    span, ref = F.col("top") - F.col("low"), F.greatest(F.abs("top"), F.abs("base"), F.lit(1))
    moved = (span > 0) & (F.col("ix") > 0)
    moved &= (F.abs(F.col("cnt") - F.col("base")) >= F.greatest(span * 0.06, ref * 0.01, F.lit(1.0))) | (F.abs(F.col("cnt") - F.col("before")) >= F.greatest(span * 0.08, ref * 0.015, F.lit(1.0)))
    s = s.withColumn("first", F.min(F.when(moved, F.col("ix"))).over(w))
    start = F.greatest(F.lit(0), F.col("first") - context)
    start = F.when(F.col("n") - start < F.least(F.lit(least), F.col("n")), F.greatest(F.lit(0), F.col("n") - F.least(F.lit(least), F.col("n")))).otherwise(start)
    start = F.when(F.col("first").isNull() | (start < 2), 0).otherwise(start)
    return s.withColumn("start", start).where("ix >= start").select("event_id", "ix", "cnt")


def trend_percent(series: DataFrame) -> DataFrame:
    """Each point as a percentage of the largest, whether it is the first peak, and the bounds of the stages around it."""
    w = Window.partitionBy("event_id")
    s = series.withColumn("percent", F.floor(F.col("cnt") * 100 / F.greatest(F.max("cnt").over(w), F.lit(1)) + 0.5))
    s = s.withColumn("peak_ix", F.min_by("ix", F.struct(-F.col("percent"), F.col("ix"))).over(w)).withColumn("last_ix", F.max("ix").over(w))
    latent = F.greatest(F.lit(1), F.least("last_ix", F.col("peak_ix") - 2))
    growth = F.greatest(latent + 1, F.least("last_ix", "peak_ix"))
    peak = F.greatest(growth + 1, F.least(F.col("last_ix"), F.col("peak_ix") + 1))
    return s.select("event_id", "ix", "percent", "peak_ix", latent.alias("latent_end"), growth.alias("growth_end"), peak.alias("peak_end"))


def stage_curve(points: DataFrame) -> DataFrame:
    """Three heuristic percentages at 2, 4 and 6 hours on; ``points``: event_id, stage, last_percent, clock (HH:mm)."""
    v = F.col("last_percent")
    rules = {
        "latent": [F.least(F.lit(82), v + 14), F.least(F.lit(92), v + 24), F.greatest(F.lit(62), v + 16)],
        "growth": [F.least(F.lit(96), v + 12), F.least(F.lit(100), v + 20), F.greatest(F.lit(72), v + 8)],
        "peak": [F.greatest(F.lit(76), v - 4), F.greatest(F.lit(48), v - 18), F.greatest(F.lit(32), v - 34)],
    }
    out = F.array(F.greatest(F.lit(24), v - 12), F.greatest(F.lit(14), v - 24), F.greatest(F.lit(8), v - 34))
    for stage, values in rules.items():
        out = F.when(F.col("stage") == stage, F.array(*values)).otherwise(out)
    p = points.select("event_id", "clock", F.posexplode(out).alias("pos", "value"))
    hour = F.pmod(F.substring("clock", 1, 2).cast("int") + 2 * (F.col("pos") + 1), F.lit(24))
    return p.select("event_id", (F.col("pos") + 1).alias("step"), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.substring("clock", 3, 3)).alias("clock"), F.col("value").cast("long").alias("value"))
