"""What the operators need from the session: the shared folder, cut lineage, spread input."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and
    the master is local (tests, a notebook) a folder of this machine is taken;
    on a cluster a missing setting raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "quern-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and go on from there.

    A reliable checkpoint: it survives the loss of executors.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it again.

    For tables read more than once: columnar, compressed, prunable.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables that only the block needs: ``with Scratch(spark) as s: s.stored(df)``; their files go when it ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, name: str = "stage") -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of stages that have ended.

    Executors keep them until the driver collects its garbage, which a driver
    with a large heap puts off; between the phases of a long job they would add up.
    """
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Give a scan of few files enough partitions for Python work.

    A table of many splits is returned as it is, so that no shuffle is added
    where there is already enough parallelism.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
