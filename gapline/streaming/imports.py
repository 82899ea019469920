"""Review files that arrive in a folder, imported as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gapline.operators.imports import reviews_of

SCHEMA = "row_no long, place_name string, place_category string, review_text string, review_rating double, latitude double, longitude double, review_date string"


def import_batch(rows: DataFrame, root: str, batch: int) -> None:
    """One micro-batch as a run. The run's folder is named by the batch and overwritten, so a batch that is done again stays one run."""
    run = f"imp-stream-{batch:06d}"
    reviews_of(rows, run).drop("import_id").write.mode("overwrite").parquet(f"{root.rstrip('/')}/import_id={run}")


def start(spark: SparkSession, folder: str, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Import every file of ``folder`` (JSON lines) exactly once; ``once`` ends when all files are in."""
    rows = spark.readStream.schema(SCHEMA).json(folder)
    writer = rows.writeStream.foreachBatch(lambda df, batch: import_batch(df, root, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def published(spark: SparkSession, root: str) -> DataFrame:
    """All imported runs, a review once."""
    return spark.read.parquet(root).dropDuplicates(["import_id", "review_id"])


def event_rates(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and sums per window and type of a stream of events, late ones counted within ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
