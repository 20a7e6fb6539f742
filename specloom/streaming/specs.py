"""The rules over a stream of documents, and an event count with a watermark. Neither has a counterpart to match; both reuse the batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import report, validate
from ..sources.specs import parse_specs


def validate_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Reports on files as they appear in a folder. Rules look only inside a document, so each batch is complete in itself; a batch that is run again overwrites its own output."""
    files = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))

    def batch(df: DataFrame, number: int) -> None:
        docs = parse_specs(df)
        report(docs, validate(docs)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; state older than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))
