"""Queries over the event stream, by Structured Streaming run to the end of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossmotif.runtime import scratch
from crossmotif.streaming.tag_join import stream_tag_pairs, windowed_event_counts


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run the stream over what is there and return the rows that it wrote to the shared folder."""
    spark = stream.sparkSession
    out = scratch(spark, f"stream-{uuid.uuid4().hex[:6]}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _finished(windowed_event_counts(_source(spark, sf_dir)), "update")
    last = counts.groupBy("window", "event_type").agg(F.max(F.struct("n", "total")).alias("x"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "x.n", F.round("x.total", 4).alias("total"))


def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _source(spark, sf_dir).select(F.col("event_type").alias("tag"), (F.col("user_id") % 5).cast("string").alias("party"), F.col("event_id").alias("tx"), "ts")
    return _finished(stream_tag_pairs(rows.where("tx % 2 = 0"), rows.where("tx % 2 = 1"), "10 minutes"), "append").select("tag", "party_s", "party_r", "tx_s", "tx_r")


QUERIES = {"stream_event_counts": stream_event_counts, "stream_tag_pairs": stream_pairs}
#: Both streams see all their input, so they equal the batch results.
ORACLES = {
    "stream_event_counts": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_tag_pairs": """SELECT s.event_type AS tag, CAST(s.user_id % 5 AS VARCHAR) AS party_s, CAST(r.user_id % 5 AS VARCHAR) AS party_r, s.event_id AS tx_s, r.event_id AS tx_r
        FROM events s JOIN events r ON s.event_type = r.event_type AND s.user_id % 5 <> r.user_id % 5 AND r.ts BETWEEN s.ts - INTERVAL 10 MINUTE AND s.ts + INTERVAL 10 MINUTE
        WHERE s.event_id % 2 = 0 AND r.event_id % 2 = 1""",
}
