"""Sources and sinks. Everything is read and written by Spark, so any file system will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C


def extension():
    return F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (path, text)."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str, limit: int = C.LOCAL_LIMIT) -> DataFrame:
    """Files with a route: image, text, server (needs a server), unsupported, or too_large. Larger files' contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = rows.where(F.col("length") <= limit)
    large = rows.where(F.col("length") > limit).select("path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("route"))
    ext = extension()
    route = F.when(ext.isin(C.IMAGE_EXTENSIONS), "image").when(ext.isin(C.TEXT_EXTENSIONS), "text").when(ext.isin(C.SERVER_EXTENSIONS), "server").otherwise("unsupported")
    return small.select("path", "length", "content", route.alias("route")).unionByName(large)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Key configurations in JSON."""
    return spark.read.option("multiLine", True).json(path)


def cleaned_name(path):
    """X.ext -> X_cleaned.ext."""
    return F.regexp_replace(path, r"(\.[^./]+)?$", "_cleaned$1")


def write_cleaned_texts(cleaned: DataFrame, path: str) -> None:
    cleaned.write.mode("overwrite").parquet(path)


def write_cleaned_files(cleaned: DataFrame, path: str) -> None:
    """(name, data) rows as Parquet under the cleaned names; bytes stay in the shared store."""
    cleaned.where("data is not null").select(cleaned_name(F.col("path")).alias("path"), "data", "actions").write.mode("overwrite").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON lines of a column ``report``."""
    reports.select(F.col("report").alias("value")).write.mode("overwrite").text(path)
