"""Reading a source tree, or tables of documents, as ``files(path, ext, size_bytes, content)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as X


def read_tree(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Every file below ``root``; content is null where the bytes aren't UTF-8. Oversized files keep their row, not their bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    rel = F.substr(plain, F.length(base) + 2)
    content = F.try_validate_utf8(F.col("content").cast("string"))
    if max_bytes is not None:
        content = F.when(F.col("length") <= max_bytes, content).otherwise("")
    return raw.select(rel.alias("path"), X.extension(rel).alias("ext"), F.col("length").alias("size_bytes"), content.alias("content"))


def read_table(spark: SparkSession, path: str, path_column: str, content_column: str, format: str = "parquet", **options) -> DataFrame:
    """A table of texts in any of Spark's formats (parquet, orc, json, csv, avro where its jar is present)."""
    rows = spark.read.format(format).options(**options).load(path)
    name, content = F.col(path_column).cast("string"), F.col(content_column).cast("string")
    return rows.select(name.alias("path"), X.extension(name).alias("ext"), F.octet_length(content).cast("bigint").alias("size_bytes"), content.alias("content"))
