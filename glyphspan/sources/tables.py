"""Reading the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORK = "id STRING, work_name STRING, author STRING, author_code STRING, rows ARRAY<STRING>, row_ids ARRAY<ARRAY<STRING>>, section_depth INT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, path: str) -> DataFrame:
    """Works as JSON documents, with a declared schema."""
    return spark.read.schema(WORK).json(path, multiLine=True)


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text): whole text files of a folder and those below it."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
