"""Incremental forms of the batch operators on Structured Streaming.

Sources are folders of files; checkpoints replace status columns. Sinks that update use
``foreachBatch`` and overwrite only what a batch touches, so a repeated batch does no harm.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery

from ..operators import cluster, dedup, vectors
from ..sources import sinks
from ..sources.tables import stash, unstash


def ingest(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    """New rows of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take what is there and stop; a later call goes on from the checkpoint."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def dedup_url(stream: DataFrame, url: str = "source_url", time: str = "publish_time", delay: str = "7 days") -> DataFrame:
    """The first row of each URL within the delay; older state is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([url])


def run_batches(df: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """As ``run_available``, with a function of each batch and its number."""
    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What batches before this one left in a folder of batches."""
    if not number or not sinks.exists(spark, path):
        return None
    return spark.read.parquet(path).where(F.col("batch") < number)


def keep_recent(spark: SparkSession, path: str, days: int = 45, time: str = "publish_time") -> Callable[[DataFrame, int], None]:
    """Batches to a table without posts that are more than so many days behind the newest post of all so far, the batch's own included.

    The newest time is kept beside the table, one row a batch, so that a repeated batch gives the same rows.
    """

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.agg(F.max(time).alias("newest"))
        before = _written(spark, f"{path}/newest", number)
        if before is not None:
            newest = newest.unionByName(before.select("newest")).agg(F.max("newest").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/newest/batch={number}")
        limit = spark.read.parquet(f"{path}/newest/batch={number}").select((F.col("newest") - F.expr(f"INTERVAL {days} DAYS")).alias("__limit"))
        # One row.
        batch.join(F.broadcast(limit)).where(F.col(time) >= F.col("__limit")).drop("__limit").write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return apply


def bucket(stream: DataFrame, time: str = "publish_time", width: str = "6 hours") -> DataFrame:
    """Posts by event and bucket. Buckets are aligned to the epoch, not to the event's first post as in the batch form."""
    w = F.window(time, width)
    return stream.groupBy("event_id", w.alias("w")).agg(F.count(F.lit(1)).alias("cnt")).select("event_id", F.col("w.start").alias("start"), "cnt")


BUCKET_ROWS = "event_id string, anchor_s long, ix long, cnt long"


def _event_buckets(width: int, idle_ms: int):
    """An event's state: its first post, whether no earlier one can come, the counts of its buckets, and until then the counts of its times."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {"anchor": None, "final": False, "times": {}, "counts": []}
        new = Counter(int(t) for frame in frames for t in frame["publish_s"])
        if not new:
            return
        before, known = held["anchor"], len(held["counts"])
        if not held["final"]:
            for t, n in new.items():
                held["times"][str(t)] = held["times"].get(str(t), 0) + n
            held["anchor"] = min(map(int, held["times"]))
            moved = held["anchor"] != before
            fresh = Counter({int(t): n for t, n in held["times"].items()}) if moved else new
            if moved:
                held["counts"] = []
        else:
            moved, fresh = False, new
        touched = set(range(len(held["counts"]))) if moved else set()
        for t, n in fresh.items():
            # What comes too late for the first bucket falls into it.
            ix = max(0, (t - held["anchor"]) // width)
            held["counts"] += [0] * (ix + 1 - len(held["counts"]))
            held["counts"][ix] += n
            touched.add(ix)
        touched |= set(range(0 if moved else known, len(held["counts"])))
        watermark = state.getCurrentWatermarkMs()
        if watermark > held["anchor"] * 1000:
            held["final"], held["times"] = True, {}
        last = held["anchor"] + len(held["counts"]) * width
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(watermark, last * 1000) + idle_ms)
        rows = [(key[0], held["anchor"], ix, held["counts"][ix]) for ix in sorted(touched)]
        yield pd.DataFrame(rows, columns=["event_id", "anchor_s", "ix", "cnt"])

    return run


def event_buckets(stream: DataFrame, hours: int = 6, delay: str = "1 day", idle_days: int = 45) -> DataFrame:
    """event_id, anchor_s, ix, cnt: buckets of events (``event_id``, ``publish_time``) from their first post on, those that a batch changes or opens, empty ones between included.

    Posts may come out of order by the delay; until the watermark has passed an event's first post
    its times are kept, as an earlier one may still move the buckets. An event without posts for ``idle_days`` ends and
    its state goes; one that comes back begins anew. ``bucket_table`` reads what ``keep_batches`` wrote of it.
    """
    timed = stream.withWatermark("publish_time", delay).select("event_id", "publish_time", F.unix_seconds("publish_time").alias("publish_s"))
    run = _event_buckets(hours * 3600, idle_days * 86_400_000)
    return timed.groupBy("event_id").applyInPandasWithState(run, BUCKET_ROWS, "held string", "update", GroupStateTimeout.EventTimeTimeout)


def keep_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch's rows in a folder of its own, so that one that comes again overwrites itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def bucket_table(spark: SparkSession, path: str, hours: int = 6) -> DataFrame:
    """event_id, ix, start_s, cnt as ``trend.bucket_counts`` has them: of each bucket the last batch's count, by the event's last first post."""
    rows = spark.read.parquet(path)
    anchors = rows.groupBy("event_id").agg(F.max_by("anchor_s", "batch").alias("anchor_s"))
    last = rows.join(anchors, ["event_id", "anchor_s"]).groupBy("event_id", "anchor_s", "ix").agg(F.max_by("cnt", "batch").alias("cnt"))
    return last.select("event_id", "ix", (F.col("anchor_s") + F.col("ix") * (hours * 3600)).alias("start_s"), "cnt")


def upsert(spark: SparkSession, path: str, key: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch function that merges into a table of ``save_events``; only what holds keys of the batch is read and rewritten."""

    def apply(batch: DataFrame, _: int) -> None:
        now = stash(batch, "batch")
        keys = now.select(key, F.pmod(F.xxhash64(key), F.lit(sinks.PARTS)).cast("int").alias("part")).distinct()
        stored = spark.read.parquet(path).join(keys, ["part", key], "left_semi").drop("part") if sinks.exists(spark, path) else None
        sinks.save_events(merge(now, stored), path, key)
        unstash(now)

    return apply


def comment_dup(spark: SparkSession, path: str, k: int = 3) -> Callable[[DataFrame, int], None]:
    """Batches of comments (seq, fingerprint) to kept ones and counts of their copies; ``comment_counts`` reads them.

    A batch writes only its own kept comments and what it adds to counts, so the work of writing
    does not grow with what is stored, and a repeated batch overwrites its own part.
    """

    def apply(batch: DataFrame, number: int) -> None:
        fresh = stash(dedup.comment_dup_count(batch.select("seq", "fingerprint"), k), "fresh")
        added = fresh.select("seq", F.col("duplicate_count").cast("long").alias("n"))
        stored = _written(spark, f"{path}/kept", number)
        if stored is not None:
            # Kept comments of this batch that are near a stored one add their count to it.
            a = dedup.band_rows(stored.select(F.col("seq").alias("of"), "fingerprint"), k).select("band", "bits", "of", F.col("fingerprint").alias("own"))
            b = dedup.band_rows(fresh.select("seq", "fingerprint"), k)
            near = b.join(a, ["band", "bits"]).where(dedup.hamming(F.col("fingerprint"), F.col("own")) <= k).groupBy("seq").agg(F.min("of").alias("of"))
            near = stash(near, "near")
            added = added.join(near, "seq", "left").groupBy(F.coalesce("of", "seq").alias("seq")).agg(F.sum("n").alias("n"))
            fresh = fresh.join(near, "seq", "left_anti")
        added.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        fresh.select("seq", "fingerprint").write.mode("overwrite").parquet(f"{path}/kept/batch={number}")

    return apply


def comment_counts(spark: SparkSession, path: str) -> DataFrame:
    """seq, fingerprint and duplicate_count of the comments kept by ``comment_dup``."""
    counts = spark.read.parquet(f"{path}/counts").groupBy("seq").agg(F.sum("n").alias("duplicate_count"))
    return spark.read.parquet(f"{path}/kept").drop("batch").join(counts, "seq")


def live_clusters(spark: SparkSession, path: str, idf: DataFrame, threshold: float = 0.04) -> Callable[[DataFrame, int], None]:
    """Batches (seq, publish_s, tokens) to the nearest live cluster, or to a new one that they open; weights are those of a snapshot.

    A cluster is the sum of its vectors and their number, kept as what each batch added; its
    centroid is the mean so far and moves with every document, by the rule of the batch form. ``clusters_of``
    reads the assignment. Documents without a known term open a cluster of their own.
    """

    ids = cluster.term_ids(idf)

    def apply(batch: DataFrame, number: int) -> None:
        bags = stash(vectors.term_bags(batch, "seq", "publish_s"), "batch")
        before = _written(spark, f"{path}/sums", number)
        found = cluster.settle(bags, bags, ids, threshold, None if before is None else before.select("cluster_id", "term", "s"))
        assigned = spark.createDataFrame([], "seq long, cluster_id long") if found is None else found.assigned.select("seq", "cluster_id")
        entries = spark.createDataFrame([], "cluster_id long, term string, s double") if found is None else found.entries()
        entries.write.mode("overwrite").parquet(f"{path}/sums/batch={number}")
        assigned.write.mode("overwrite").parquet(f"{path}/assigned/batch={number}")
        if found is not None:
            found.drop()
        unstash(bags)

    return apply


def clusters_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/assigned").drop("batch")


def report(spark: SparkSession, posts_path: str, out_path: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """After each batch the events that it touches are reported anew, in place of what was stored of them."""

    def apply(batch: DataFrame, _: int) -> None:
        touched = batch.select("event_id").distinct()
        every = spark.read.parquet(posts_path).join(touched, "event_id", "left_semi")
        sinks.save_events(make(every), out_path)

    return apply
