"""Where documents come from and go to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jp_from_bson, jp_valid


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(key, doc): a document per line, or per file with ``whole``; the key is the file, and the line's place in it."""
    lines = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("doc"))
    return lines.select((F.col("file") if whole else F.concat_ws("#", "file", "n")).alias("key"), "doc")


def read_bson(spark: SparkSession, path: str) -> DataFrame:
    """(key, doc): the first field of each BSON file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("key"), jp_from_bson("content").alias("doc"))


def read_table(spark: SparkSession, path: str, key: str, doc: str) -> DataFrame:
    """(key, doc) from Parquet; only the two columns are read."""
    return spark.read.parquet(path).select(F.col(key).alias("key"), F.col(doc).alias("doc"))


def split_valid(df: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(documents that are JSON, the others)."""
    marked = df.withColumn("__valid", jp_valid(doc))
    return marked.where("__valid").drop("__valid"), marked.where("not coalesce(__valid, false)").drop("__valid")


def write_snapshot(df: DataFrame, path: str) -> None:
    """A snapshot of a document table."""
    df.write.mode("errorifexists").parquet(path)
