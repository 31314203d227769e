"""Helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder. Only Spark reads it, so any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's ``spark.checkpoint.dir``, or what the context has been given.

    Where neither is set, a session on one machine (master local) gets a folder of its own; on a cluster nothing is guessed.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not shared:
        if current.isDefined():
            return current.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder.

    A checkpoint keeps the size estimates of the plan behind it, which multiply from join to join until planning takes longer
    than the work; so the rows are taken up again as a table of unknown size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    held = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that further columns of any name cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
