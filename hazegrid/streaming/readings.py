"""Streams of readings: the batch expressions over arriving files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import cpcb_aqi, cpcb_category
from ..operators.stats import steady_mean
from ..session import scratch_path


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_aqi(readings: DataFrame, hours: int = 6, late: str = "1 hour") -> DataFrame:
    """Mean PM2.5 and index per cell and tumbling window; works on streams and tables.

    On a stream, readings later than ``late`` behind the newest one are dropped.
    The mean is the same in whatever order readings arrive.
    """
    rows = readings.withWatermark("datetime", late) if readings.isStreaming else readings
    grouped = rows.groupBy(F.window("datetime", f"{hours} hours"), "cell_lat", "cell_lon").agg(
        steady_mean("pm2_5").alias("mean_pm"), F.count("pm2_5").alias("count"))
    return grouped.select(
        F.col("window.start").alias("window_start"), "cell_lat", "cell_lon", "mean_pm", "count",
        cpcb_aqi("mean_pm").alias("aqi"), cpcb_category("mean_pm").alias("category"))


#: state that outgrows an executor's heap stays on its disk, with changes in the checkpoint folder
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, mode: str = "append", out: str | None = None, state: str | None = None) -> DataFrame:
    """Work through what has arrived, write it below the shared folder, read it back.

    With the same ``out`` and ``state`` folders a later call goes on where the
    last one, ended or broken off, stood.
    """
    spark = stream.sparkSession
    out, state = out or scratch_path(spark, "stream"), state or scratch_path(spark, "stream-state")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest_per_location(snapshots: DataFrame, location: list[str], ts: str) -> DataFrame:
    """Newest row of every location, of equal times the largest row, by a combinable maximum."""
    rest = [c for c in snapshots.columns if c not in location]
    newest = F.max(F.struct(F.col(ts).alias("_t"), F.struct(*rest).alias("_r")))
    return snapshots.groupBy(*location).agg(newest.alias("_m")).select(
        *location, *[F.col(f"_m._r.{c}").alias(c) for c in rest])


#: parts of the table of latest rows
BUCKETS = 32


def latest_rows(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The table below ``root`` as its last complete batch left it; empty before the first."""
    versions = _versions(spark, root)
    paths = [f"{root}/rows/batch={batch}/bucket={bucket}" for bucket, batch in versions.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """For each bucket the batch that wrote it last, by the newest list (older than batch ``before``)."""
    try:
        lists = spark.read.schema("bucket int, version long, batch long").parquet(f"{root}/lists")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    known = lists if before is None else lists.where(F.col("batch") < before)
    newest = known.agg(F.max("batch")).scalar()
    return {r["bucket"]: r["version"] for r in known.where(F.col("batch") == newest).collect() if r["bucket"] is not None}


def upsert_latest(stream: DataFrame, location: list[str], ts: str, root: str | None = None,
                  state: str | None = None) -> DataFrame:
    """Keep the newest row per location over all batches, of equal times the largest row.

    The table lies in buckets by a hash of the location.  A batch reads and
    rewrites only the buckets it touches, each as a new version, and then writes a
    list of the versions that count (``BUCKETS`` rows at most); a batch that is run
    again starts from the list before it.  No watermark drops rows: a late first
    row of a location is its newest, and repeated rows change nothing.  With the
    same ``root`` and ``state`` a later call goes on.  A stream without rows gives
    an empty table.
    """
    spark = stream.sparkSession
    root, state = root or scratch_path(spark, "latest"), state or scratch_path(spark, "latest-state")
    schema = stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*location), F.lit(BUCKETS)).cast("int"))
        versions = _versions(session, root, number)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        old = [f"{root}/rows/batch={versions[b]}/bucket={b}" for b in touched if b in versions]
        if old:
            kept = session.read.schema(schema).parquet(*old)
            rows = rows.unionByName(kept.withColumn("bucket", F.pmod(F.xxhash64(*location), F.lit(BUCKETS)).cast("int")))
        if touched:
            # null locations hash like others
            latest_per_location(rows, [*location, "bucket"], ts).select(*schema.fieldNames(), "bucket").repartition(
                len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/rows/batch={number}")
        versions |= dict.fromkeys(touched, number)
        session.createDataFrame(list(versions.items()) or [(None, number)], "bucket int, version long").coalesce(1).write.mode(
            "overwrite").parquet(f"{root}/lists/batch={number}")

    query = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return latest_rows(spark, root, schema)
