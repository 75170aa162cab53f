"""Incremental ingest: new page files are taken up once, resumed from a checkpoint. An addition for resumable runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def take_up(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform=lambda df: df) -> DataFrame:
    """Everything in ``source`` that no run before has taken up goes through ``transform`` into ``sink``; returns the sink."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)


def windowed_counts(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and kind, late ones up to a watermark, beyond which state is dropped.

    Each batch writes the counts that it changed into a folder of its own, so a batch that runs twice writes the same; of
    each window and kind the latest counts. Nothing goes through the driver."""
    events = spark.readStream.schema(schema).parquet(source).withColumn(time, F.col(time).cast("timestamp"))
    counts = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
    written = lambda df, batch: df.write.mode("overwrite").parquet(f"{sink}/batch={batch}")
    query = counts.writeStream.foreachBatch(written).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.schema(f"start timestamp, {kind} string, n long, batch long").parquet(sink)
    return every.groupBy("start", kind).agg(F.max_by("n", "batch").alias("n"))
