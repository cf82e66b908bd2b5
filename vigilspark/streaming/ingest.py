"""Streams: reports into tables once per run, detections over events, verdicts that only rise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilspark import schemas
from vigilspark.functions.tables import VERDICT_RANK, rank
from vigilspark.operators import behaviour, triage


def report_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Run documents (one JSON report per line or file) as they arrive."""
    return spark.readStream.schema(schemas.REPORT).option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_trigger).option("multiLine", True).json(path)


def ingest(stream: DataFrame, table_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each run once, whether it arrives twice in a batch, in two batches, or again after a restart."""

    def save(batch: DataFrame, _batch_id: int) -> None:
        rows = batch.where("_corrupt is null and scan.run_id is not null").select(F.col("scan.run_id").alias("run_id"), F.col("scan.host").alias("host"), "verdict", "coverage", "findings")
        spark = batch.sparkSession
        try:
            have = spark.read.schema(rows.schema).parquet(table_path).select("run_id")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = spark.createDataFrame([], "run_id string")
        triage.ingest(have, rows).write.mode("append").parquet(table_path)

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def detections(events: DataFrame) -> DataFrame:
    """The behavioural detectors have no state and run on a stream as they are."""
    return behaviour.detect(events)


def running_verdicts(findings: DataFrame) -> DataFrame:
    """host, rank, score so far: both only rise, so update mode needs no retractions. findings: host, tier, score."""
    return findings.groupBy("host").agg(F.max(rank("tier", VERDICT_RANK)).alias("rank"), F.max("score").alias("score"))


def event_rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per host, channel and window; what is later than the watermark no longer counts."""
    return events.withWatermark("time", late).groupBy(F.window("time", window), "host", "channel").agg(F.count(F.lit(1)).alias("events"))
