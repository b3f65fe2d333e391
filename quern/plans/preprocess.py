"""Cleaning a merged table: null filter, image check, exact and near deduplication, new ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import blank_to_null
from quern.operators.dedup import exact_marked, near_marked, numbered
from quern.session import stored


def null_marked(df: DataFrame) -> DataFrame:
    """``df`` and is_kept: neither text nor image_path is null or blank."""
    return df.withColumn("is_kept", blank_to_null(F.col("text")).isNotNull() & blank_to_null(F.col("image_path")).isNotNull())


def with_files(df: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is in the listing."""
    return df.join(listing.select(F.col("path").alias(path)).distinct(), path, "left_semi").select(*df.columns)


def staged(df: DataFrame, listing: DataFrame | None = None, near: bool = True, threshold: float = 0.85) -> DataFrame:
    """``df`` and drop_stage: null, image, exact or near, or null for rows that stay. Cheap stages come first; each sees only what is left."""
    d = null_marked(df)
    out = d.where(~F.col("is_kept")).drop("is_kept").withColumn("drop_stage", F.lit("null"))
    left = d.where("is_kept").drop("is_kept")
    if listing is not None:
        files = listing.select(F.col("path").alias("image_path")).distinct()
        out = out.unionByName(left.join(files, "image_path", "left_anti").select(*df.columns).withColumn("drop_stage", F.lit("image")))
        left = left.join(files, "image_path", "left_semi").select(*df.columns)
    e = stored(exact_marked(left), "exact")
    out = out.unionByName(e.where(~F.col("is_kept")).drop("is_kept").withColumn("drop_stage", F.lit("exact")))
    left = e.where("is_kept").drop("is_kept")
    if near:
        n = near_marked(left, threshold=threshold)
        return out.unionByName(n.select(*df.columns, F.when(~F.col("is_kept"), "near").alias("drop_stage")))
    return out.unionByName(left.withColumn("drop_stage", F.lit(None).cast("string")))


def kept(df: DataFrame, **options) -> DataFrame:
    """The rows that stay, with new ids from 1 in the order of the old ones."""
    d = staged(df, **options).where("drop_stage is null").drop("drop_stage")
    return numbered(d, "id", "new_id").withColumnRenamed("id", "old_id").withColumnRenamed("new_id", "id")


def stage_report(df: DataFrame, **options) -> DataFrame:
    return staged(df, **options).groupBy(F.coalesce("drop_stage", F.lit("kept")).alias("stage")).agg(F.count(F.lit(1)).alias("n_rows"))
