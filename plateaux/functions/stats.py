"""Rank, quantile and missing-value expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


TASKS = 256  # that sort the counted values, each some keys


def missing(x: Column) -> Column:
    """Null, NaN and infinities count as missing."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def present(x: Column) -> Column:
    return F.when(~missing(x), x)


def average_rank(order: Column, *keys: str) -> Column:
    """Ranks from 1 within the keys, ties averaged."""
    w = W.partitionBy(*keys).orderBy(order)
    return F.rank().over(w) + (F.count("*").over(W.partitionBy(*keys, order)) - 1) / 2


def nearest_quantile(df: DataFrame, value: str, keys: list[str], q: float) -> DataFrame:
    """The value at rank round((n - 1) q), halves to even, of each group; column ``quantile``."""
    w = W.partitionBy(*keys)
    ranked = df.where(~missing(F.col(value))).withColumns({"__at": F.row_number().over(w.orderBy(value)), "__n": F.count("*").over(w)})
    return ranked.where(F.col("__at") == F.bround((F.col("__n") - 1) * F.lit(q)) + 1).select(*keys, F.col(value).alias("quantile"))


def counted_medians(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """keys, the exact median of the values (the mean of the middle two; null without values) and n, all rows of the key.

    Values are counted first, so what is sorted are a key's distinct values, by a window that can spill; no row holds them.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("__c")).repartition(TASKS, *keys)  # a number of its own, as small partitions would be put together
    w = W.partitionBy(*keys)
    own = F.when(F.col(value).isNotNull(), F.col("__c")).otherwise(0)  # nulls come first and weigh nothing
    ranked = counted.withColumns({"__upto": F.sum(own).over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "__all": F.sum(own).over(w), "__own": own})
    holds = lambda rank: F.max(F.when((F.col("__upto") - F.col("__own") <= rank) & (rank < F.col("__upto")), F.col(value)))
    middle = (holds(F.floor((F.col("__all") - 1) / 2)) + holds(F.floor(F.col("__all") / 2))) / 2
    return ranked.groupBy(*keys).agg(middle.alias(out), F.sum("__c").alias("n"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def constant(values: list, kind: str = "string") -> Column:
    """An array of thousands of known names or numbers as one literal that is split, not a literal for each."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    mark = "\x1f"
    return F.split(F.lit(mark.join(v if isinstance(v, str) else repr(v) for v in values)), mark).cast(f"array<{kind}>")
