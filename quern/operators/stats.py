"""Counts and rates of routed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(df: DataFrame, value: Column, domain: list[str]) -> DataFrame:
    """(value, n_rows) for each value of the domain, 0 where there is none."""
    spark = df.sparkSession
    base = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], "__i int, value string")
    n = df.groupBy(value.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return base.join(n, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n_rows"))


def null_bucket(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 4))


def routed_stats(routed: DataFrame, n_input: int | None = None) -> DataFrame:
    """One row of totals, rates and distributions, in one pass. Label, emoji and check counts are there for each value, also 0."""
    c = lambda x: F.count_if(x)
    by = lambda col, values: F.create_map(*[y for v in values for y in (F.lit(v), c(null_bucket(F.col(col)) == v))])
    reasons = ["high_conf", "low_conf", "uncertain", "missing_image", "invalid_json", "audit_sampled"]
    d = routed.agg(
        F.count(F.lit(1)).alias("total"),
        c(F.col("need_review")).alias("need_review"),
        by("round1_label", ["sarcastic", "non_sarcastic", "invalid"]).alias("labels"),
        F.map_filter(by("route_reason", reasons), lambda k, v: v > 0).alias("reasons"),
        by("has_emoji", ["0", "1", "null"]).alias("has_emoji"),
        by("needs_human_check", ["0", "1", "null"]).alias("needs_human_check"),
    )
    t = F.col("total")
    bad = (F.lit(n_input) if n_input is not None else t) - t
    return d.select("total", bad.alias("bad_count"), "need_review", (t - F.col("need_review")).alias("auto_accepted"), rate(F.col("need_review"), t).alias("review_rate"), rate(t - F.col("need_review"), t).alias("auto_rate"), "labels", "reasons", "has_emoji", "needs_human_check")
