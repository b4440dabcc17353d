"""A folder as a stream: new files are converted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.conf import Settings
from docmill.plans import pipeline
from docmill.sources import files


def fresh(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Files that were not delivered before within the delay, by path and bytes."""
    return stream.withColumn("sha1", F.sha1("content")).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["path", "sha1"]).drop("sha1")


def start(spark: SparkSession, source: str, target: str, checkpoint: str, mode: str | None = None, settings: Settings | None = None, dead_letters: str | None = None, per_trigger: int = 1000, once: bool = True):
    """A running query; with `once` it ends when all files that are there have been converted. A batch that is run again
    after a failure replaces what it wrote before."""

    def convert(batch: DataFrame, number: int) -> None:
        results = pipeline.convert(batch, mode, settings)
        results.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if dead_letters:
            pipeline.dead_letters(batch.sparkSession.read.parquet(f"{target}/batch={number}")).write.mode("overwrite").json(f"{dead_letters}/batch={number}")

    writer = fresh(files.stream(spark, source, per_trigger)).writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
