"""Incremental ingest as a stream: new files are taken once, in micro-batches, and written without duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stores import exists


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: Sequence[str], order: str, files_a_batch: int = 100) -> StreamingQuery:
    """Appends rows of new Parquet files in `source` to `target`, the first row of each key alone, and ends when all
    present files are taken. Runs again from its checkpoint; a batch that is tried again gives the same table."""
    def write(batch: DataFrame, number: int) -> None:
        first = batch.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")
        path = f"{target}/batch={number}"
        if exists(spark, target):
            # Only the keys of what is there are read; this batch's own earlier try isn't.
            old = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(target).where(~F.input_file_name().contains(f"/batch={number}/"))
            first = first.join(old.select(*key), list(key), "left_anti")
        first.write.mode("overwrite").parquet(path)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: Sequence[str], width: str, late: str) -> DataFrame:
    """Counts by time window; rows later than `late` behind the newest are left out when it runs as a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), *by, "n")
