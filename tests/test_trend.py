"""Exact values on tiny series."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators import trend

T0 = 1704067200


def posts(spark, *hours, event="e"):
    return spark.createDataFrame([(event, T0 + int(h * 3600)) for h in hours], "event_id string, publish_s long")


def series(spark, counts, event="e"):
    return spark.createDataFrame([(event, i, c) for i, c in enumerate(counts)], "event_id string, ix long, cnt long")


def values(df, column):
    return [r[column] for r in df.orderBy(*[c for c in ("event_id", "ix", "step") if c in df.columns]).collect()]


def test_buckets_by_first_post(spark):
    assert values(trend.bucket_counts(posts(spark, 0, 1, 7)), "cnt") == [2, 1]
    assert values(trend.bucket_counts(posts(spark, 0), now=T0 + 18 * 3600), "cnt") == [1, 0, 0, 0]


def test_buckets_before_first_post_are_one(spark):
    assert values(trend.bucket_counts(posts(spark, 10, 30), now=T0), "cnt") == [2]


def test_days_without_posts_are_filled(spark):
    out = trend.daily_trend(posts(spark, 0, 1, 48))
    assert values(out, "cnt") == [2, 0, 1]
    assert [str(x) for x in values(out, "date")] == ["2024-01-01", "2024-01-02", "2024-01-03"]


@pytest.mark.parametrize("counts, stage", [([0, 1, 0, 0], "latent"), ([1, 2, 4, 8], "growth"), ([1, 3, 5, 5], "peak"), ([5, 3, 1], "decline"), ([4], "peak")])
def test_stage(spark, counts, stage):
    assert trend.lifecycle_stage(series(spark, counts)).first()["stage"] == stage


def test_probabilities_sum_to_one(spark):
    row = trend.lifecycle_proba(trend.lifecycle_stage(series(spark, [5, 3, 1]))).first()
    shares = [row[f"p_{s}"] for s in ("latent", "growth", "peak", "decline")]
    assert sum(shares) == pytest.approx(1, abs=0.002) and max(shares) == row["p_decline"]


def daily(spark, counts):
    return series(spark, counts).withColumn("date", F.date_from_unix_date((F.col("ix") + 19723).cast("int")))


def test_forecast(spark):
    up = values(trend.forecast(daily(spark, [1, 2, 4]), 2), "predict_count")
    assert up[0] > 4 and up[1] > up[0]
    assert min(values(trend.forecast(daily(spark, [5, 1, 0]), 3), "predict_count")) >= 0


@pytest.mark.parametrize("counts, found", [([4, 1, 0, 1, 1, 0], [1]), ([1, 1], []), ([3, 3, 3, 3], [])])
def test_changepoints(spark, counts, found):
    assert values(trend.changepoints(series(spark, counts)), "ix") == found


def test_heat_decays(spark):
    def heat(*hours):
        return trend.heat(posts(spark, *hours), T0 + 100 * 3600).first()["heat"]

    assert heat(*[99] * 5) > 4 > heat(*[0] * 5)
    assert heat(200) == 1.0
    assert trend.heat(posts(spark), T0).count() == 0


def test_recent_window_is_by_event(spark):
    rows = posts(spark, 0, 2000).unionByName(posts(spark, 0, event="old"))
    assert sorted((r.event_id, r.publish_s) for r in trend.recent_window(rows, 45).collect()) == [("e", T0 + 2000 * 3600), ("old", T0)]


def test_trim_keeps_flat_and_short_series(spark):
    assert values(trend.trend_trim(series(spark, [3, 3, 3])), "ix") == [0, 1, 2]
    assert values(trend.trend_trim(series(spark, [0] * 20 + [50, 60, 70, 80, 90])), "ix") == list(range(19, 25))
