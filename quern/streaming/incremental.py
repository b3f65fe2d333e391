"""Micro-batch runs: each takes what has arrived, then ends (availableNow)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.dedup import first_by
from quern.sources.readers import exists
from quern.sources.sinks import append_batch


def merge_new(spark: SparkSession, source: DataFrame, target: str, key: str, order: str, checkpoint: str) -> None:
    """Append the first row of each key that the target doesn't have.

    The target is the state: keys live in its files, not in a state store that
    grows with all history. A batch that runs again replaces its own rows only.
    """

    def one(batch: DataFrame, number: int) -> None:
        fresh = first_by(batch, key, order)
        if exists(spark, f"{target}/batch_id=*"):
            known = spark.read.parquet(target).where(F.col("batch_id") != number).select(key)
            fresh = fresh.join(known, key, "left_anti").select(*batch.columns)
        append_batch(fresh, target, number)

    source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def judge_stream(spark: SparkSession, source: DataFrame, judge: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Judge records as they arrive; records that the target has are left out, so an interrupted run goes on where it stopped."""

    def one(batch: DataFrame, number: int) -> None:
        if exists(spark, f"{target}/batch_id=*"):
            batch = batch.join(spark.read.parquet(target).where(F.col("batch_id") != number).select("id"), "id", "left_anti")
        append_batch(judge(batch), target, number)

    source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_seen(source: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key within a watermark: state ends with the delay."""
    return source.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
