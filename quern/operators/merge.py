"""Incremental merging of scraped rows and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import blank_to_null, clean_threads, file_name, image_id, post_image_name
from quern.operators.dedup import first_by, numbered
from quern.session import stored


def next_id(df: DataFrame, key: str = "id", empty: int = 1) -> int:
    """The greatest id and one, or ``empty`` for an empty table."""
    top = df.agg(F.max(key).alias("m")).first()["m"]
    return empty if top is None else top + 1


def watermark(target: DataFrame, mode: str = "count", source: str = "threads", key: str = "id") -> int:
    """Where a merge goes on: the number of merged rows of the source ('count') or their greatest id ('max_id')."""
    of = F.col("source") == source
    what = F.count_if(of) if mode == "count" else F.coalesce(F.max(F.when(of, F.col(key))), F.lit(0))
    return target.agg(what.alias("w")).first()["w"]


def above(rows: DataFrame, mark: int, key: str = "id") -> DataFrame:
    return rows.where(F.col(key) > mark)


def new_by_key(rows: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key that isn't in ``seen``; null and blank keys are left out."""
    fresh = rows.where(blank_to_null(F.col(key)).isNotNull())
    return first_by(fresh.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*rows.columns), key, order)


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def skip_reason(text: Column, image: Column, listing_found: Column) -> Column:
    """Why a row isn't merged: the first of empty_text, no_image, missing_image; null if it is."""
    return F.when(blank_to_null(text).isNull(), "empty_text").when(blank_to_null(image).isNull(), "no_image").when(~F.coalesce(listing_found, F.lit(False)), "missing_image")


def stage_counts(df: DataFrame, stage: Column) -> DataFrame:
    return df.groupBy(F.coalesce(stage, F.lit("kept")).alias("stage")).agg(F.count(F.lit(1)).alias("n_rows"))


def image_list(images: Column) -> Column:
    """The non-blank paths, in order; null counts as none."""
    return F.filter(F.coalesce(images, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")


def merged_threads(sessions: DataFrame, seen: DataFrame | None = None, start: int = 1) -> DataFrame:
    """Cleaned posts of scraped sessions: one row a link (its first session and time), with images, numbered from ``start``.

    Rows without a link, without an image or without text after cleaning are
    left out before numbering. image_paths is null unless there is more than one image.
    """
    order = F.struct("session", F.coalesce("scraped_at", F.lit("")), F.coalesce("text", F.lit("")))
    d = sessions.withColumn("__o", order)
    d = first_by(d.where(blank_to_null(F.col("post_link")).isNotNull()), "post_link", "__o")
    if seen is not None:
        d = d.join(seen.select("post_link").distinct(), "post_link", "left_anti")
    d = d.withColumn("__i", image_list(F.col("image_local"))).where(F.size("__i") > 0)
    # written before the filter, which would else be pushed below the cleaning with a copy of all of it
    d = stored(clean_threads(d, "text", "__c").drop("__o"), "clean").where("__c is not null")
    d = numbered(d.withColumn("__key", F.struct("session", "post_link")), "__key", "id", start)
    paths = F.transform(F.col("__i"), lambda x, i: F.concat(F.lit("images/"), post_image_name(F.col("id"), file_name(x), i + 1)))
    return d.select("id", F.col("__c").alias("text"), paths[0].alias("image_path"), F.when(F.size(paths) > 1, paths).alias("image_paths"), "post_link", "username", "keyword", "mode", "scraped_at")


def image_plan(merged: DataFrame, sessions: DataFrame) -> DataFrame:
    """(id, n, source, target) of the copies a merge needs; running it is left to a side step."""
    src = first_by(sessions.withColumn("__o", F.struct("session", F.coalesce("scraped_at", F.lit("")), F.coalesce("text", F.lit("")))), "post_link", "__o")
    d = merged.select("id", "post_link").join(src.select("post_link", image_list(F.col("image_local")).alias("i")), "post_link")
    e = d.select("id", F.posexplode("i").alias("p", "source"))
    return e.select("id", (F.col("p") + 1).alias("n"), "source", F.concat(F.lit("images/"), post_image_name(F.col("id"), F.col("source"), F.col("p") + 1)).alias("target"))


def rename_plan(records: DataFrame, listing: DataFrame, leftovers: DataFrame | None = None) -> DataFrame:
    """(id, current, target, state) for image names that follow ids: no_change, renamed, recovered or missing.

    ``records``(id, image_path), ``listing``(path), ``leftovers``(id, path). An
    equal name is no_change whether or not the file is there.
    """
    d = records.where(blank_to_null(F.col("image_path")).isNotNull()).select("id", file_name(F.col("image_path")).alias("current"))
    d = d.withColumn("target", post_image_name(F.col("id"), F.col("current")))
    files = listing.select(file_name(F.col("path")).alias("current"), F.lit(True).alias("there")).distinct()
    d = d.join(files, "current", "left")
    if leftovers is None:
        d = d.withColumn("left_path", F.lit(None).cast("string"))
    else:
        d = d.join(leftovers.groupBy("id").agg(F.min("path").alias("left_path")), "id", "left")
    state = F.when(F.col("current") == F.col("target"), "no_change").when(F.col("there"), "renamed").when(F.col("left_path").isNotNull(), "recovered").otherwise("missing")
    return d.select("id", "current", "target", state.alias("state"))


def leftover_ids(listing: DataFrame) -> DataFrame:
    """(id, path) of interrupted renames, files named tmp_<id>.<suffix>; other names are left out."""
    name = file_name(F.col("path"))
    return listing.select(F.regexp_extract(name, r"^tmp_(\d+)\.[^.]{3,}$", 1).try_cast("bigint").alias("id"), "path").where("id is not null")


def feed_rows(posts: DataFrame, least_text: int, least_side: int = 250, seen: DataFrame | None = None) -> DataFrame:
    """Scraped candidates to keep: no data address, text of some length, a picture large enough, no video; one row (the first id) of each image id that ``seen``(image_id) doesn't have."""
    ok = ~F.col("image_url").startswith("data:") & (F.length("text") >= least_text) & (F.col("width") >= least_side) & (F.col("height") >= least_side) & ~F.coalesce(F.col("is_video"), F.lit(False))
    kept = posts.where(ok)
    if seen is None:
        return kept
    d = kept.withColumn("__i", image_id(F.col("image_url"))).join(seen.select(F.col("image_id").alias("__i")).distinct(), "__i", "left_anti")
    return first_by(d, "__i", "id").drop("__i").select(*posts.columns)
