"""Streaming extension: documents that arrive are compared with a static corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import overlap


def arrivals(spark: SparkSession, path: str, schema: str = "doc_id long, text string, arrived timestamp", lateness: str = "1 hour") -> DataFrame:
    """New rows of a folder of Parquet files, each text once within ``lateness``."""
    rows = spark.readStream.schema(schema).parquet(path).withWatermark("arrived", lateness)
    return rows.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicatesWithinWatermark(["hash"]).drop("hash")


def scan(rows: DataFrame, corpus: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Start the query: matches of each micro-batch are appended to ``out``, a folder for each batch, so a batch that runs again replaces itself."""

    def batch(frame: DataFrame, number: int) -> None:
        found = overlap.passages(overlap.paragraphs(frame)).where("kind = 'scored'")
        overlap.matches(overlap.alignments(found, corpus)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
