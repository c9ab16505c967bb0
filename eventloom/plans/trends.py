"""Registered queries on counts over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trend
from ..sources.views import AS_OF, activity, posts, sql

DAILY = """days AS (SELECT event_id, publish_s // 86400 AS day, count(*) AS cnt FROM activity GROUP BY ALL),
daily AS (SELECT g.event_id, g.day - g.first AS ix, (DATE '1970-01-01' + g.day::INTEGER) AS date, coalesce(cnt, 0) AS cnt
  FROM (SELECT event_id, min(day) AS first, unnest(range(min(day), max(day) + 1)) AS day FROM days GROUP BY event_id) g LEFT JOIN days d ON g.event_id = d.event_id AND g.day = d.day)"""
BUCKETS = """spans AS (SELECT event_id, min(publish_s) AS first, greatest((max(publish_s) - min(publish_s)) // 21600 + 1, 1) AS n FROM activity GROUP BY event_id),
hits AS (SELECT a.event_id, least((publish_s - first) // 21600, n - 1) AS ix, count(*) AS cnt FROM activity a JOIN spans s USING (event_id) GROUP BY ALL),
buckets AS (SELECT g.event_id, g.ix, g.first + g.ix * 21600 AS start_s, coalesce(cnt, 0) AS cnt FROM (SELECT event_id, first, unnest(range(n)) AS ix FROM spans) g LEFT JOIN hits h ON g.event_id = h.event_id AND g.ix = h.ix)"""
STAGE = """shape AS (SELECT event_id, count(*) AS n, max(cnt) AS peak, arg_min(ix, (-cnt, ix)) AS peak_ix, max(ix) AS last_ix, arg_max(cnt, ix) AS latest, arg_max(before, ix) FILTER (ix > 0) AS before
  FROM (SELECT *, lag(cnt) OVER (PARTITION BY event_id ORDER BY ix) AS before FROM buckets) GROUP BY event_id),
stages AS (SELECT event_id, n, CASE WHEN peak <= 1 THEN 'latent' WHEN peak_ix < last_ix AND latest <= peak * 0.5 THEN 'decline' WHEN peak_ix < last_ix THEN 'peak'
  WHEN latest > before THEN 'growth' ELSE 'peak' END AS stage FROM shape)"""


def _daily(s, d):
    return trend.daily_trend(activity(s, d))


def _buckets(s, d):
    return trend.bucket_counts(activity(s, d))


def _last_points(s, d):
    p = trend.trend_percent(_daily(s, d)).groupBy("event_id").agg(F.max_by("percent", "ix").alias("last_percent"))
    return p.join(trend.lifecycle_stage(_buckets(s, d)).select("event_id", "stage"), "event_id").withColumn("clock", F.lit("21:30"))


QUERIES = {
    "recent_window": lambda s, d: trend.recent_window(posts(s, d), 10).select("doc_id", "event_id", "publish_s"),
    "time_span": lambda s, d: trend.time_span(trend.recent_window(posts(s, d), 10)),
    "heat": lambda s, d: trend.heat(posts(s, d), AS_OF),
    "daily_trend": lambda s, d: _daily(s, d).withColumn("date", F.col("date").cast("string")),
    "bucket_counts": _buckets,
    "changepoints": lambda s, d: trend.changepoints(_buckets(s, d)),
    "lifecycle_stage": lambda s, d: trend.lifecycle_stage(_buckets(s, d)),
    "lifecycle_proba": lambda s, d: trend.lifecycle_proba(trend.lifecycle_stage(_buckets(s, d))),
    "forecast": lambda s, d: trend.forecast(_daily(s, d)).withColumn("date", F.col("date").cast("string")),
    "event_time": lambda s, d: trend.event_time(_daily(s, d)),
    "trend_trim": lambda s, d: trend.trend_trim(_daily(s, d)),
    "trend_percent": lambda s, d: trend.trend_percent(_daily(s, d)),
    "stage_curve": lambda s, d: trend.stage_curve(_last_points(s, d)),
}

_MOVED = """marked AS (SELECT *, count(*) OVER w AS n, max(cnt) OVER w - min(cnt) OVER w AS span, greatest(abs(max(cnt) OVER w), abs(first(cnt) OVER (PARTITION BY event_id ORDER BY ix)), 1) AS ref,
  first(cnt) OVER (PARTITION BY event_id ORDER BY ix) AS base, lag(cnt) OVER (PARTITION BY event_id ORDER BY ix) AS before FROM daily WINDOW w AS (PARTITION BY event_id)),
found AS (SELECT *, min(CASE WHEN span > 0 AND ix > 0 AND (abs(cnt - base) >= greatest(span * 0.06, ref * 0.01, 1) OR abs(cnt - before) >= greatest(span * 0.08, ref * 0.015, 1)) THEN ix END) OVER (PARTITION BY event_id) AS f FROM marked),
begun AS (SELECT *, CASE WHEN f IS NULL THEN 0 WHEN n - greatest(0, f - 1) < least(6, n) THEN greatest(0, n - least(6, n)) ELSE greatest(0, f - 1) END AS s FROM found)"""
_PERCENT = """pct AS (SELECT event_id, ix, floor(cnt * 100 / greatest(max(cnt) OVER (PARTITION BY event_id), 1) + 0.5)::BIGINT AS percent FROM daily),
peaks AS (SELECT event_id, arg_min(ix, (-percent, ix)) AS peak_ix, max(ix) AS last_ix, arg_max(percent, ix) AS last_percent FROM pct GROUP BY event_id)"""
_CURVE = "CASE stage " + " ".join(
    f"WHEN '{s}' THEN [{', '.join(v)}]"
    for s, v in {
        "latent": ["least(82, v + 14)", "least(92, v + 24)", "greatest(62, v + 16)"],
        "growth": ["least(96, v + 12)", "least(100, v + 20)", "greatest(72, v + 8)"],
        "peak": ["greatest(76, v - 4)", "greatest(48, v - 18)", "greatest(32, v - 34)"],
    }.items()
) + " ELSE [greatest(24, v - 12), greatest(14, v - 24), greatest(8, v - 34)] END"

ORACLE = {
    "recent_window": sql(["posts"], "SELECT doc_id, event_id, publish_s FROM (SELECT *, max(publish_s) OVER (PARTITION BY event_id) AS last FROM posts) WHERE publish_s >= last - 864000"),
    "time_span": sql(["posts"], "SELECT event_id, min(publish_s) AS time_start_s, max(publish_s) AS time_end_s FROM (SELECT *, max(publish_s) OVER (PARTITION BY event_id) AS last FROM posts) WHERE publish_s >= last - 864000 GROUP BY event_id"),
    "heat": sql(["posts"], f"SELECT event_id, round(sum(exp(-ln(2.0::DOUBLE) * greatest({AS_OF} - publish_s, 0) / 3600.0 / 24)), 3) AS heat FROM posts GROUP BY event_id"),
    "daily_trend": sql(["activity"], "SELECT * REPLACE (date::VARCHAR AS date) FROM daily", DAILY),
    "bucket_counts": sql(["activity"], "SELECT * FROM buckets", BUCKETS),
    "changepoints": sql(
        ["activity"],
        "SELECT event_id, ix FROM (SELECT *, count(*) OVER w AS n, avg(diff) OVER w AS m, stddev_pop(diff) OVER w AS sd FROM (SELECT *, cnt - lag(cnt) OVER (PARTITION BY event_id ORDER BY ix) AS diff FROM buckets) WINDOW w AS (PARTITION BY event_id)) WHERE n >= 3 AND sd > 0 AND abs(diff - m) / sd >= 1.5",
        BUCKETS,
    ),
    "lifecycle_stage": sql(["activity"], "SELECT * FROM stages", BUCKETS, STAGE),
    "lifecycle_proba": sql(
        ["activity"],
        "SELECT event_id, stage, round(c, 3) AS confidence, "
        + ", ".join(f"round(CASE WHEN pos = {k} THEN c WHEN abs(pos - {k}) = 1 THEN (1 - c) / (CASE WHEN pos IN (1, 4) THEN 1 ELSE 2 END) ELSE 0 END, 3) AS p_{n}" for k, n in enumerate(["latent", "growth", "peak", "decline"], 1))
        + " FROM (SELECT *, least(0.5::DOUBLE + 0.1::DOUBLE * n, 0.9::DOUBLE) AS c, list_position(['latent', 'growth', 'peak', 'decline'], stage) AS pos FROM stages)",
        BUCKETS,
        STAGE,
    ),
    "forecast": sql(
        ["activity"],
        "SELECT event_id, step::BIGINT AS step, (last_date + step::INTEGER)::VARCHAR AS date, round(greatest(0, latest + (latest - oldest)::DOUBLE / greatest(n - 1, 1) * step), 1) AS predict_count FROM (SELECT event_id, max(date) AS last_date, arg_max(cnt, ix) AS latest, arg_min(cnt, ix) AS oldest, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ix DESC) AS rn FROM daily) WHERE rn <= 3 GROUP BY event_id), range(1, 4) t(step)",
        DAILY,
    ),
    "event_time": sql(["activity"], "SELECT event_id, arg_min(date, (-cnt, ix))::VARCHAR || 'T12:00:00' AS event_time FROM daily GROUP BY event_id", DAILY),
    "trend_trim": sql(["activity"], "SELECT event_id, ix, cnt FROM begun WHERE ix >= CASE WHEN s < 2 THEN 0 ELSE s END", DAILY, _MOVED),
    "trend_percent": sql(
        ["activity"],
        "SELECT event_id, ix, percent, peak_ix, l AS latent_end, g AS growth_end, greatest(g + 1, least(last_ix, peak_ix + 1)) AS peak_end FROM (SELECT *, greatest(l + 1, least(last_ix, peak_ix)) AS g FROM (SELECT *, greatest(1, least(last_ix, peak_ix - 2)) AS l FROM pct JOIN peaks USING (event_id)))",
        DAILY,
        _PERCENT,
    ),
    "stage_curve": sql(
        ["activity"],
        "SELECT event_id, step::BIGINT AS step, lpad(((21 + 2 * step) % 24)::VARCHAR, 2, '0') || ':30' AS clock, vals[step]::BIGINT AS value FROM (SELECT event_id, " + _CURVE + " AS vals FROM (SELECT event_id, stage, last_percent AS v FROM peaks JOIN stages USING (event_id))), range(1, 4) t(step)",
        DAILY,
        _PERCENT,
        BUCKETS,
        STAGE,
    ),
}
