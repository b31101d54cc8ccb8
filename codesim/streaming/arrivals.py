"""Submissions as they arrive: an extension, the engine itself is a batch engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codesim.operators.records import latest


def read_arrivals(spark: SparkSession, folder: str, schema: StructType, files_a_trigger: int = 100) -> DataFrame:
    """Parquet files of submissions as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def newest(batch: DataFrame) -> DataFrame:
    """One row a submission: that with the latest submitted_at, then arrived_at."""
    return latest(batch, [F.col("sub_id")], [F.desc_nulls_last("submitted_at"), F.desc_nulls_last("arrived_at"), F.desc_nulls_last("artifact_id")])


def arrivals_by_window(stream: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Numbers of arrivals a window and status; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark("arrived_at", late).groupBy(F.window("arrived_at", window), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def each_batch(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str):
    """Give each micro-batch's newest rows to ``process``; a batch that is repeated after a failure has the same number."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: process(newest(df), n)).trigger(availableNow=True).start()
