"""Readers of the files that the pipelines exchange."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INPUT = "id STRING, text STRING, image_path STRING, image_paths ARRAY<STRING>, ocr_text STRING"
SESSION = "post_link STRING, username STRING, text STRING, keyword STRING, mode STRING, scraped_at STRING, image_local STRING"
JUDGE = "id BIGINT, label_llm1 STRING, has_emoji INT, needs_human_check INT, notes STRING, reasoning MAP<STRING,STRING>, parse_error BOOLEAN, image_missing BOOLEAN"
TASK = "id BIGINT, inner_id STRING, data STRUCT<image:STRING,text:STRING>, annotations ARRAY<STRUCT<was_cancelled:BOOLEAN,result:ARRAY<STRUCT<value:STRUCT<choices:ARRAY<STRING>>>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None and len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)) > 0


def is_array_file(spark: SparkSession, path: str) -> bool:
    """Whether the first character that isn't blank opens a JSON array; only the first bytes are read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [x.getPath() for s in fs.globStatus(p) for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    for f in files:
        stream = fs.open(f)
        try:
            while head := bytes(stream.readNBytes(1 << 12)):
                if text := head.decode("utf-8", "ignore").lstrip("\ufeff \t\r\n"):
                    return text.startswith("[")
        finally:
            stream.close()
    return False


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file that is one JSON array (or one object); a broken file raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank and broken lines are left out."""
    d = spark.read.schema(f"{schema}, _corrupt_record STRING").option("mode", "PERMISSIVE").json(path)
    return d.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def input_records(spark: SparkSession, path: str) -> DataFrame:
    """Records to judge, from an array file (an id that is no number raises) or JSON lines (such lines are left out)."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if is_array_file(spark, path):
        d = json_array(spark, path, INPUT).withColumn("id", F.col("id").cast("bigint"))
    else:
        d = json_lines(spark, path, INPUT).withColumn("id", F.expr("try_cast(id as bigint)")).where("id is not null and text is not null")
    return d.withColumn("image_paths", F.when(F.size("image_paths") > 0, F.col("image_paths")))


def session_rows(spark: SparkSession, root: str) -> DataFrame:
    """Scraped rows of root/<session>/<file>.json: of each session the first file by name; bad files count as empty."""
    d = spark.read.schema(f"{SESSION}, _corrupt_record STRING").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/*.json")
    d = d.withColumns({"path": F.col("_metadata.file_path")}).withColumn("session", F.element_at(F.split("path", "/"), -2))
    first = d.groupBy("session").agg(F.min("path").alias("path"))
    d = d.join(first, ["session", "path"]).where(F.col("_corrupt_record").isNull())
    images = F.coalesce(F.from_json("image_local", "array<string>"), F.when(F.trim("image_local") != "", F.array("image_local")))
    return d.withColumn("image_local", images).drop("_corrupt_record", "path")


def checkpointed(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each id of a JSON-lines checkpoint; none if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], JUDGE)
    d = json_lines(spark, path, JUDGE).withColumn("__at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    row = F.struct(*[c for c in d.columns if c != "__at"])
    return d.where("id is not null").groupBy("id").agg(F.max_by(row, "__at").alias("r")).select("r.*")


def target_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written before, or an empty one."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def labelling_export(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, TASK)


def labelling_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks to import; an empty file raises."""
    d = json_array(spark, path, "data STRUCT<image:STRING,text:STRING>")
    if d.isEmpty():
        raise ValueError(f"no tasks in {path}")
    return d


def file_listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length) of files; their content isn't read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def big_enough(listing: DataFrame, least: int = 10_001) -> DataFrame:
    return listing.where(F.col("length") >= least)


def resolved(records: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """(id, path, n_missing): the first place under the roots where an image of the record is, and how many images aren't anywhere."""
    d = records.select("id", F.posexplode_outer(F.coalesce("image_paths", F.array("image_path"))).alias("p", "name")).where(F.trim("name") != "")
    tries = d.select("id", "p", "name", F.posexplode(F.array(*[F.concat(F.lit(r), F.col("name")) for r in ["", *roots]])).alias("k", "path"))
    hit = tries.join(listing.select("path", F.lit(True).alias("there")), "path", "left")
    per = hit.groupBy("id", "p").agg(F.min(F.when(F.col("there"), F.struct("k", "path"))).alias("h"))
    return per.groupBy("id").agg(F.min(F.when(F.col("h").isNotNull(), F.struct("p", "h.path")))["path"].alias("path"), F.count_if(F.col("h").isNull()).alias("n_missing"))


_MAGIC = {b"\xff\xd8\xff", b"\x89PNG", b"RIFF", b"GIF8"}


def opens(content: Column) -> Column:
    """Whether bytes begin as a JPEG, PNG, WebP or GIF file does; pixels aren't decoded."""
    return F.coalesce(F.greatest(*[content.substr(1, len(m)) == F.lit(bytearray(m)) for m in sorted(_MAGIC)]), F.lit(False))


def loaded_images(records: DataFrame, listing: DataFrame, roots: list[str], sees_images: bool = True) -> DataFrame:
    """(id, images, image_missing) of ``records``(id, image_path, image_paths): the first place under the roots of each image that is there, in order.

    image_missing: images are named, the model looks at images, and none is
    there. ``listing``(path[, opens]): an image that doesn't open counts as absent.
    """
    named = F.when(F.size("image_paths") > 0, F.col("image_paths")).when(F.trim("image_path") != "", F.array("image_path"))
    d = records.select("id", named.alias("named"))
    if not sees_images:
        return d.select("id", F.array().cast("array<string>").alias("images"), F.lit(False).alias("image_missing"))
    places = lambda n: F.when(n.startswith("/"), F.array(n)).otherwise(F.array(*[F.concat(F.lit(r), n) for r in roots]))
    e = d.where("named is not null").select("id", F.posexplode("named").alias("p", "name")).select("id", "p", F.posexplode(places(F.col("name"))).alias("k", "path"))
    there = listing.where("opens") if "opens" in listing.columns else listing
    hit = e.join(there.select("path").distinct(), "path").groupBy("id", "p").agg(F.min(F.struct("k", "path"))["path"].alias("path"))
    per = hit.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "path"))), lambda x: x["path"]).alias("images"))
    out = d.join(per, "id", "left")
    return out.select("id", F.coalesce("images", F.array().cast("array<string>")).alias("images"), (F.col("named").isNotNull() & F.col("images").isNull()).alias("image_missing"))


def prompt_template(prompt: str, examples: str | None = None) -> str:
    """The prompt's text and, where there is such a file, the examples after an empty line."""
    with open(prompt, encoding="utf-8") as f:
        text = f.read()
    if examples and os.path.exists(examples):
        with open(examples, encoding="utf-8") as f:
            text = text.rstrip() + "\n\n" + f.read().lstrip()
    return text


def yaml_settings(path: str) -> dict:
    """The scalars of a flat YAML file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        out = {}
        for line in text.splitlines():
            if m := re.match(r"([A-Za-z_]\w*)\s*:\s*(.*?)\s*(?:#.*)?$", line):
                raw = m[2]
                try:
                    out[m[1]] = {"true": True, "false": False, "null": None, "": None}[raw.lower()] if raw.lower() in ("true", "false", "null", "") else float(raw) if "." in raw else int(raw)
                except ValueError:
                    out[m[1]] = raw.strip("\"'")
        return out


@dataclass(frozen=True)
class RoundConfig:
    """Settings of an annotation round."""

    random_audit_rate: float = 0.10
    seed: int = 42
    batch_size: int = 8
    min_record_id: int | None = None
    max_records: int | None = None


def round_config(spark: SparkSession, values: dict | None = None) -> RoundConfig:
    """Defaults, overridden by given values, overridden by the session's quern.round.* settings."""
    out = {}
    for f in fields(RoundConfig):
        v = (values or {}).get(f.name, f.default)
        s = spark.conf.get(f"quern.round.{f.name}", None)
        out[f.name] = v if s is None else (float(s) if f.name == "random_audit_rate" else int(s))
    return RoundConfig(**out)
