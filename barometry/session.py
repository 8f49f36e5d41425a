"""Session settings and the shared folder for intermediate tables."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "barometry", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Indicator windows cost far more per byte than scans: keep small shuffles spread over tasks.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Sessions of a hot key are merged in every task before they are shuffled.
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        # The feature plan compiles more classes than the default cache of 100 holds.
        .config("spark.sql.codegen.cache.maxEntries", "1000")
    )
    if master:
        builder = builder.master(master)
    else:
        # On a cluster: many shuffle partitions to begin with. Adaptive execution merges small ones at run time.
        builder = builder.config("spark.sql.shuffle.partitions", "4000")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder the cluster names in ``spark.checkpoint.dir``.

    A session on one machine may leave the setting out and gets a temporary folder; on a cluster, where the
    executors would not see it, a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/barometry/{name}-{uuid.uuid4().hex}"


#: Whether shuffle files go as soon as their query has ended, not only when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df, name: str):
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    No later query reads the shuffle files of the write, so they go with its end.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
