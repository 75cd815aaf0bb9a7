"""Line scans and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """file and value of every line; files are split between tasks where the encoding allows it."""
    if encoding.upper() == "UTF-8":
        return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("text"))
    return raw.select("file", F.explode(F.split(F.regexp_replace("text", "\r?\n$", ""), "\r?\n")).alias("value"))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def count_all_lines(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """file and n: lines of every file below the folder whose name ends with the extension."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").text(folder)
    return raw.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def write(rows: DataFrame, column: str, path: str) -> None:
    """A line for each row; null rows are empty lines."""
    rows.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.text(path)
