"""Reading and writing tables of the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.contract import CONTROL, IMAGE, OBJECT, PLATE, WELL


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet, optionally some columns (pruned in the scan)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and a declared schema, so that empty files keep their types."""
    return spark.read.csv(path, header=True, schema=schema)


def write_table(df: DataFrame, path: str, partitions: tuple[str, ...] = ("representation", "batch"), mode: str = "overwrite") -> None:
    """zstd Parquet, partitioned by those of the columns that exist."""
    own = [c for c in partitions if c in df.columns]
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*own) if own else writer).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Append predictions under their fixed schema; a column that is missing or cannot be cast is an error."""
    from ..operators.learn import PREDICTION_SCHEMA

    fields = [f.strip().rsplit(" ", 1) for f in PREDICTION_SCHEMA.split(",")]
    df.select(*[F.col(n).cast(t).alias(n) for n, t in fields]).write.mode("append").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str] = ()) -> None:
    """One CSV file with a header; for summaries, which are small."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True)


def load_features(features: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """Features as they are, or with the control column of an annotated table, joined on the cell's four keys."""
    if controls is None:
        return features
    keys = [PLATE, WELL, IMAGE, OBJECT]
    return features.join(controls.select(*keys, CONTROL), keys, "inner")


def representations_on_disk(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("representation").distinct()
