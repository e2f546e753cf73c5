"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: run-time settings; rows and bytes of an Arrow batch bound what a Python worker and its buffers hold at once
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    # split a skewed join input even where a later step reuses its partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def build_session(name: str = "hazegrid", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings this package relies on.

    On a cluster leave ``master`` unset and pass sizes through ``spark-submit``;
    adaptive execution sizes the shuffles from the data at run time.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        **RUNTIME,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Put the run-time settings on a session, wherever it was built; every query starts with it."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


#: temporary folders of local applications that name none
_LOCAL_ROOTS: dict[str, str] = {}


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder, once per
    application; a cluster without it is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_ROOTS.get(context.applicationId)
    if not named:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="hazegrid-")
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared root."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write the rows to a fresh folder under the shared root and read them back.

    The table outlives lost executors, and several later steps can read it
    without repeating the work that made it.
    """
    path = scratch_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    The copy outlives lost executors, and later steps do not repeat the work.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
