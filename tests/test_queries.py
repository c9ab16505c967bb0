"""Registered queries against their SQL twins, plans and streams."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventloom.plans import catalog
from eventloom.sources import sinks
from eventloom.streaming import jobs


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, db, name):
    df = catalog.queries()[name](spark, sf)
    expected = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(expected.columns, expected.fetchall())


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "heat" in out.columns


def test_no_cartesian_products(spark, sf):
    for name in ("cosine_sparse", "near_dup_pairs", "similar_events", "cand_cap", "assign_nearest"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_reports_and_duplicates_add_up(spark, sf):
    out = catalog.queries()["analyze_event"](spark, sf)
    n = out.agg(F.sum(F.col("report_count") + F.col("duplicate_count"))).first()[0]
    assert n == spark.read.parquet(f"{sf}/documents.parquet").count()
    row = out.first()
    assert row.positive + row.neutral + row.negative == pytest.approx(1, abs=0.002)


def test_stream_buckets_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{i % 2}", i) for i in range(40)], "event_id string, n long").withColumn("publish_time", F.timestamp_seconds(F.col("n") * 3600))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = jobs.ingest(spark, str(tmp_path / "in"), rows.schema, 1)
    q = jobs.bucket(stream.withWatermark("publish_time", "1 hour")).writeStream.format("memory").queryName("b").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("b").agg(F.sum("cnt")).first()[0] == 40
    apply = jobs.report(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda p: p.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")))
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"e0": 20, "e1": 20}


def test_stream_comment_counts(spark, tmp_path):
    apply = jobs.comment_dup(spark, str(tmp_path / "t"))
    apply(spark.createDataFrame([(1, 7), (2, 7), (3, 1 << 50)], "seq long, fingerprint long"), 0)
    apply(spark.createDataFrame([(4, 6), (5, (1 << 50) | (1 << 20) | (1 << 30) | (1 << 35) | (1 << 8))], "seq long, fingerprint long"), 1)
    counts = {1: 3, 3: 1, 5: 1}
    assert {r.seq: r.duplicate_count for r in jobs.comment_counts(spark, str(tmp_path / "t")).collect()} == counts
    # A batch that comes again changes nothing.
    apply(spark.createDataFrame([(4, 6), (5, (1 << 50) | (1 << 20) | (1 << 30) | (1 << 35) | (1 << 8))], "seq long, fingerprint long"), 1)
    assert {r.seq: r.duplicate_count for r in jobs.comment_counts(spark, str(tmp_path / "t")).collect()} == counts


def test_stream_leaves_late_posts_out(spark, tmp_path):
    apply = jobs.keep_recent(spark, str(tmp_path / "t"), 45)
    day = lambda rows: spark.createDataFrame(rows, "id int, d int").select("id", F.timestamp_seconds(F.col("d") * 86400).alias("publish_time"))
    apply(day([(1, 100), (2, 40), (3, 60)]), 0)
    apply(day([(4, 56), (5, 54), (6, 101)]), 1)
    apply(day([(7, 57), (8, 55)]), 2)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t/rows")).collect()) == [1, 3, 4, 6, 7]


def test_stream_clusters_live_on(spark, tmp_path):
    flood, phone = ["flood", "river", "rescue"], ["phone", "screen", "chip"]
    idf = spark.createDataFrame([(t, 1.0) for t in flood + phone + ["bridge"]], "term string, idf double")
    apply = jobs.live_clusters(spark, str(tmp_path / "t"), idf, 0.3)
    shape = "seq long, publish_s long, tokens array<string>"
    apply(spark.createDataFrame([(1, 1, flood), (2, 2, phone), (3, 3, flood[:2])], shape), 0)
    second = spark.createDataFrame([(4, 4, flood + ["bridge"]), (5, 5, ["unknown"]), (6, 6, phone), (7, 7, ["bridge"])], shape)
    apply(second, 1)
    apply(second, 1)
    out = {r.seq: r.cluster_id for r in jobs.clusters_of(spark, str(tmp_path / "t")).collect()}
    assert out[1] == out[3] == out[4] == 0 and out[2] == out[6] == 1 and len({0, 1, out[5], out[7]}) == 4
    # A store with one cluster opens the next beside it.
    other = jobs.live_clusters(spark, str(tmp_path / "u"), idf, 0.3)
    other(spark.createDataFrame([(1, 1, flood)], shape), 0)
    other(spark.createDataFrame([(2, 2, phone)], shape), 1)
    assert {r.seq: r.cluster_id for r in jobs.clusters_of(spark, str(tmp_path / "u")).collect()} == {1: 0, 2: 1}
    # The flood's centroid has moved: the bridge is part of it now.
    sums = spark.read.parquet(str(tmp_path / "t/sums")).where("cluster_id = 0 and term = 'bridge'")
    assert sums.count() == 1


def test_stored_events_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "events")
    sinks.save_events(spark.createDataFrame([(f"e{i}", i) for i in range(200)], "event_id string, n int"), path)
    sinks.save_events(spark.createDataFrame([("e3", -3), ("new", 7)], "event_id string, n int"), path)
    out = {r.event_id: r.n for r in spark.read.parquet(path).collect()}
    assert len(out) == 201 and out["e3"] == -3 and out["new"] == 7 and out["e4"] == 4
    assert len(glob.glob(f"{path}/part=*")) <= sinks.PARTS
    merge = lambda new, old: new if old is None else new.unionByName(old.select("event_id", "n")).groupBy("event_id").agg(F.sum("n").cast("int").alias("n"))
    jobs.upsert(spark, path, "event_id", merge)(spark.createDataFrame([("e4", 10), ("e9", 1)], "event_id string, n int"), 0)
    out = {r.event_id: r.n for r in spark.read.parquet(path).collect()}
    assert len(out) == 201 and out["e4"] == 14 and out["e9"] == 10


def test_stream_buckets_begin_at_the_first_post(spark, tmp_path):
    """Batch after batch: an earlier post moves the buckets until the watermark has passed, later ones fall into the first; ended events have no state."""
    hour, rows = 3600, []
    batches = [
        [("a", 100), ("a", 107), ("b", 101)],
        [("a", 96), ("a", 130), ("b", 101)],  # an earlier first post
        [("a", 131), ("c", 150), ("b", 125)],
        [("a", 99), ("a", 160), ("d", 161)],  # behind the watermark: left out
        [("c", 150), ("d", 170)],
    ]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "event_id string, h long").select("event_id", F.timestamp_seconds(F.col("h") * hour).alias("publish_time")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.ingest(spark, str(tmp_path / "in"), "event_id string, publish_time timestamp", 1)
        jobs.run_batches(jobs.event_buckets(stream, delay="24 hours", idle_days=1), jobs.keep_batches(str(tmp_path / "out")), str(tmp_path / "c"), "update").awaitTermination()
        rows += batch
    want = {}
    kept = [r for r in rows if r != ("a", 99)]
    for name in "abcd":
        times = [h for e, h in kept if e == name]
        for ix in range((max(times) - min(times)) // 6 + 1):
            want[name, ix] = (min(times) + 6 * ix, sum((h - min(times)) // 6 == ix for h in times))
    out = {(r.event_id, r.ix): (r.start_s // hour, r.cnt) for r in jobs.bucket_table(spark, str(tmp_path / "out")).collect()}
    assert out == want
