"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names. In local mode, where all is one machine, a temporary one if none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="eventloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: written as Parquet and read again, so that loops keep short plans and survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/eventloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores where the input has fewer splits than there are cores, before costly work on its texts; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def unstash(*tables: DataFrame | None) -> None:
    """Delete what ``stash`` wrote for these; nothing may read them any more. Other frames are left alone."""
    for df in tables:
        path = getattr(df, "stashed_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
