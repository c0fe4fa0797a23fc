"""Counts, means, spreads and extremes of thousands of features in one pass of the table, by group.

Each task sums its rows into one array a group; what leaves a task is a row for each group and feature, whatever the number
of cells. Missing values (null, NaN, infinities) are counted and left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import Held, by_group, column, finite, matrix
from ..functions.stats import constant


class _Sums:
    def __init__(self, width: int):
        self.n, self.missing = np.zeros(width, np.int64), np.zeros(width, np.int64)
        self.mean, self.m2 = np.zeros(width), np.zeros(width)
        self.low, self.high = np.full(width, np.inf), np.full(width, -np.inf)

    def add(self, x: np.ndarray) -> None:
        zeroed, here = finite(x)
        n = here.sum(0)
        mean = zeroed.sum(0) / np.maximum(n, 1)
        m2 = (np.where(here, x - mean, 0.0) ** 2).sum(0)
        total = np.maximum(self.n + n, 1)
        away = mean - self.mean
        self.m2 += m2 + away**2 * self.n * n / total
        self.mean += away * n / total
        self.n += n
        self.missing += len(x) - n
        self.low = np.minimum(self.low, np.where(here, x, np.inf).min(0, initial=np.inf))
        self.high = np.maximum(self.high, np.where(here, x, -np.inf).max(0, initial=-np.inf))


def moments(df: DataFrame, width: int, group: Column | None = None) -> DataFrame:
    """(group, i, n, n_missing, mean, m2, min, max) of every feature i: n values, their mean, the sum of squared deviations
    and extremes (null without values). Without a group the whole table is one, named by null."""
    kind = df.select(group.alias("group")).schema["group"].dataType if group is not None else df.select(F.lit(None).cast("string").alias("group")).schema["group"].dataType
    keyed = df.select((group if group is not None else F.lit(None).cast("string")).alias("group"), "features")

    def out(name: object, s: _Sums) -> pa.RecordBatch:
        none = s.n == 0
        floats = {"mean": s.mean, "m2": s.m2, "min": s.low, "max": s.high}
        return pa.record_batch({"group": pa.array([name] * width, s.kind), "i": pa.array(np.arange(width, dtype=np.int32)), "n": pa.array(s.n), "n_missing": pa.array(s.missing)} | {k: pa.array(v, mask=none) for k, v in floats.items()})

    def run(batches):
        held = Held(lambda: _Sums(width), width * 48, out)
        for batch in batches:
            x = matrix(column(batch, "features"), width)
            for name, rows in by_group(batch, "group"):
                own = held.of(name)
                own.kind = batch.schema.field("group").type
                own.add(x[rows])
            yield from held.full()
        yield from held.rest()

    schema = f"group {kind.simpleString()}, i int, n long, n_missing long, mean double, m2 double, min double, max double"
    parts = keyed.mapInArrow(run, schema)
    grouped = parts.groupBy("group", "i").agg(F.collect_list(F.struct("n", "mean", "m2")).alias("p"), F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.min("min").alias("min"), F.max("max").alias("max"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))  # a struct for each task
    spread = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.coalesce(x["m2"] + x["n"] * (x["mean"] - F.col("mean")) ** 2, F.lit(0.0)))
    return grouped.select("group", "i", "n", "n_missing", "mean", F.when(F.col("n") > 0, spread).alias("m2"), "min", "max")


def feature_moments(df: DataFrame, names: list[str]) -> DataFrame:
    """feature and the moments over the whole table, a row for every name also where the table is empty."""
    every = df.sparkSession.range(1).select(F.posexplode(constant(names)).alias("i", "feature"))
    return every.join(moments(df, len(names)).drop("group"), "i", "left").fillna(0, ["n", "n_missing"])
