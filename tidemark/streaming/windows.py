"""Event-time windows over an event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    w = F.window("at", size)
    return events.withWatermark("at", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


def sliding(events: DataFrame, late: str = "1 hour", size: str = "2 days", step: str = "1 day") -> DataFrame:
    w = F.window("at", size, step)
    return events.withWatermark("at", late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("at", gap)
    return events.withWatermark("at", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """What a stream gives for all that is there now, written as files and read back as a batch table.

    In append mode an event-time window comes out once the watermark has passed its end, and rows later than the watermark
    are dropped; folder (with the stream's place in it) lets a later call go on from there. In other modes each batch's
    rows are written in a folder of its own, again with the same result if the batch is run again.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/tidemark/streams/{uuid.uuid4().hex}"
    out = f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/place").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        q = writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows.select(*stream.columns)
