"""Documents in and results out, by Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, text)`` of a Parquet table; only these two columns are read."""
    return spark.read.parquet(path).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document for each file, with its path as id."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return spark.read.schema(f"`{id_column}` string, `{text_column}` string").json(path).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def from_strings(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def write(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    results.write.mode(mode).parquet(path)
