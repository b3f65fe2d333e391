"""Writers."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.annotate import outputs
from quern.session import stored


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a table that ``df`` may itself be read from: write beside it, put the old one aside, swap, delete the old one. One of both is always there."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    df.write.format(fmt).save(f"{path}.new-{mark}")
    target, fs = _fs(spark, path)
    old = _fs(spark, f"{path}.old-{mark}")[0]
    there = fs.exists(target)
    if there and not fs.rename(target, old):
        raise OSError(f"{path} can't be put aside")
    if not fs.rename(_fs(spark, f"{path}.new-{mark}")[0], target):
        if there:
            fs.rename(old, target)
        raise OSError(f"{path} can't be replaced")
    if there:
        fs.delete(old, True)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch to a table partitioned by batch_id; the same batch again replaces itself."""
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def append_progress(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def reset(spark: SparkSession, path: str) -> None:
    target, fs = _fs(spark, path)
    if fs.exists(target):
        fs.delete(target, True)


def write_outputs(routed: DataFrame, root: str, dry_run: bool = False) -> list[str]:
    """Write a round's tables under a folder, the parts from the written whole, so it is computed once; with dry_run only say where to."""
    names = list(outputs(routed))
    if not dry_run:
        routed.write.mode("overwrite").parquet(f"{root}/all")
        for name, df in outputs(routed.sparkSession.read.parquet(f"{root}/all")).items():
            if name != "all":
                df.write.mode("overwrite").parquet(f"{root}/{name}")
    return [f"{root}/{n}" for n in names]


def copy_images(plan: DataFrame, source: str, target: str) -> DataFrame:
    """(id, n, state) after copying ``plan``(id, n, source, target) between mounted folders: copied, exists or missing. Done at once, and once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            states = []
            for a, z in zip(b["source"], b["target"], strict=True):
                a, z = os.path.join(source, a), os.path.join(target, z)
                if os.path.exists(z):
                    states.append("exists")
                elif not os.path.exists(a):
                    states.append("missing")
                else:
                    os.makedirs(os.path.dirname(z), exist_ok=True)
                    shutil.copy2(a, z)
                    states.append("copied")
            yield pd.DataFrame({"id": b["id"], "n": b["n"], "state": states})

    return stored(plan.select("id", "n", "source", "target").mapInPandas(run, "id bigint, n int, state string"), "copies")


def rename_images(plan: DataFrame, folder: str) -> int:
    """Renames in a mounted folder what ``plan``(id, current, target, state) says, in two passes by way of tmp_<id>, so names that change places don't meet; gives the number of files renamed.

    A pass that broke off is taken up again: what is under its temporary name already isn't moved twice.
    """

    def passed(pick) -> int:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                n = 0
                for i, current, target in zip(b["id"], b["current"], b["target"], strict=True):
                    suffix = os.path.splitext(target)[1]
                    a, z = (os.path.join(folder, x) for x in pick(current, f"tmp_{i}{suffix}", target))
                    if os.path.exists(a):
                        os.replace(a, z)
                        n += 1
                yield pd.DataFrame({"n": [n]})

        return todo.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    todo = stored(plan.where("state in ('renamed', 'recovered')").select("id", "current", "target"), "renames")
    passed(lambda current, tmp, target: (current, tmp))
    return passed(lambda current, tmp, target: (tmp, target))


def write_text(df: DataFrame, path: str) -> None:
    """One text file of a table of one row and column, as a report is."""
    df.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def json_array_text(df: DataFrame, order: str) -> DataFrame:
    """(value) lines of one JSON array file, for tables small enough to be one file; rows in the order of a column."""
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    d = df.select(F.col(order).alias("__o"), line.alias("j"))
    last = d.agg(F.max("__o").alias("m")).first()["m"]
    body = d.select("__o", F.concat(F.lit("  "), "j", F.when(F.col("__o") == F.lit(last), "").otherwise(",")).alias("value"), F.lit(1).alias("p"))
    edge = df.sparkSession.createDataFrame([(0, "["), (2, "]")], "p int, value string")
    return body.unionByName(edge, allowMissingColumns=True).orderBy("p", "__o").select("value")


def export_name(stamp: str, project: int = 1) -> str:
    """A file name with a time as yyyyMMdd_HHmmss."""
    return f"project-{project}-{stamp}.json"


def import_tasks(df: DataFrame, prefix: str = "/data/local-files/?d=images/") -> DataFrame:
    """(data) tasks for a labelling tool, of ``df``(text, image_path)."""
    name = F.element_at(F.split("image_path", "/"), -1)
    return df.select(F.struct(F.concat(F.lit(prefix), name).alias("image"), F.col("text").alias("text")).alias("data"))
