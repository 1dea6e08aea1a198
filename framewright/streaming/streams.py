"""Structured Streaming: windowed counts with a watermark, upserts of points, results in two phases.

The reference has no event-time streams; the windowed counts are an addition, the other two carry its streamed calls.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.points import upsert
from framewright.operators.search import exact_topk, sq8_coarse
from framewright.session import ensure_checkpoint_dir


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str = "2 days", slide: str | None = None) -> DataFrame:
    """start, key, n: counts in tumbling (or sliding) windows; rows more than ``late`` behind are dropped as late."""
    timed = stream.where(F.col(time).isNotNull()).withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    window = F.window("__t", width, slide) if slide else F.window("__t", width)
    return timed.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_counts(stream: DataFrame, time: str, key: str, gap: str, late: str = "2 days") -> DataFrame:
    """key, start, end, n: sessions that end after ``gap`` without an event."""
    timed = stream.where(F.col(time).isNotNull()).withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(key, F.session_window("__t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts_once(spark: SparkSession, folder: str, table: str, time: str, key: str, width: str) -> DataFrame:
    """``windowed_counts`` over the files of a table that are there now; the batch ends when all are read.

    The stream's state and its result are kept in the shared checkpoint folder; the result, a table there, has a row for
    each window and key and never passes through the driver.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/{table}.parquet*")
    ntz = dict(stream.dtypes)[time] == "timestamp_ntz"
    if ntz:  # windows follow UTC days; times without a zone are taken as UTC whatever the session's zone
        stream = stream.withColumn(time, F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(time)).cast("timestamp"))
    where = f"{ensure_checkpoint_dir(spark)}/counts-{uuid.uuid4().hex}"
    counted = windowed_counts(stream, time, key, width)

    def put(batch: DataFrame, n: int) -> None:  # complete mode: the last batch has every window
        batch.write.mode("overwrite").parquet(f"{where}/rows/v={n:09d}")

    counted.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    rows = current_version(spark, f"{where}/rows")
    rows = rows if rows is not None else spark.createDataFrame([], counted.schema)
    return rows.withColumn("start", F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("start").cast("timestamp_ntz"))) if ntz else rows


def upsert_stream(stream: DataFrame, target: str, key: list[str], version: str, checkpoint: str | None = None):
    """Upserts each micro-batch of points into a versioned Parquet table: v=<batch>; the newest folder is the table.

    A batch that is run again writes the same folder again, so a restart changes nothing. The stream's state is kept
    beside the table unless ``checkpoint`` names another folder, so a restart goes on where it stopped.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = current_version(spark, target, before=n)
        merged = upsert(old, batch, key, version) if old is not None else upsert(batch.limit(0), batch, key, version)
        merged.write.mode("overwrite").parquet(f"{target}/v={n:09d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint or f"{target}/_state").trigger(availableNow=True).start()


def current_version(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest complete folder v=<n> below ``target`` (of those before a batch), or None."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    done = sorted(p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) and (before is None or int(p.getName()[2:]) < before))
    return spark.read.parquet(f"{target}/{done[-1]}") if done else None


def search_stream(points: DataFrame, query, k: int, rerank: int = 800):
    """Two results, one after the other: the coarse ranking at once (is_final = false), then the exact one."""
    coarse = sq8_coarse(points, query, k).select("point_id", F.col("code_score").cast("double").alias("score"))
    yield coarse.withColumn("is_final", F.lit(False))
    yield exact_topk(points, query, k).select("point_id", "score").withColumn("is_final", F.lit(True))
