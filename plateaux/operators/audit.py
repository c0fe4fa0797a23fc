"""Inventories and consistency checks of stored data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Rows, columns and bytes of each Parquet file under a path."""
    df = spark.read.parquet(path)
    n = len(df.columns)
    return df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).groupBy("file", "bytes").agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(n))


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha and size of each file, read as bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha"), F.col("length").alias("size"))


def content_audit(found: DataFrame, receipt: DataFrame, key: str) -> DataFrame:
    """Entries (key, sha, size) that are missing, extra, or differ from the receipt, with the fault."""
    a = found.select(key, F.col("sha").alias("__fs"), F.col("size").alias("__fn"))
    b = receipt.select(key, F.col("sha").alias("__rs"), F.col("size").alias("__rn"))
    fault = F.when(F.col("__fs").isNull(), "missing").when(F.col("__rs").isNull(), "extra").when(F.col("__fn") != F.col("__rn"), "size").when(F.col("__fs") != F.col("__rs"), "content")
    return a.join(b, key, "full").select(key, fault.alias("fault")).where("fault is not null")


def release_check(shards: DataFrame, manifests: DataFrame, column: str) -> DataFrame:
    """Names that only the shards or only the manifests have."""
    a, b = shards.select(column).distinct().withColumn("__a", F.lit(True)), manifests.select(column).distinct().withColumn("__b", F.lit(True))
    return a.join(b, column, "full").where("__a is null or __b is null").select(column, F.when(F.col("__a").isNull(), "manifest only").otherwise("shard only").alias("fault"))
