"""Per-plate statistics and robust scaling.

Statistics are long, (plate, feature), and small; they go back to the cells as one array for each plate. Medians are exact
and found by counting (see quantiles), so no task holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import constant
from ..sources.scratch import stored
from .contract import PLATE, take_features
from .moments import feature_moments
from .quantiles import medians_and_mads


def plate_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """Metadata_Plate, feature, median, mad, min, max, count, abs_coef_var; missing values and rows without a plate left out."""
    found = medians_and_mads(df, len(names), PLATE).where("n > 0")
    labels = constant(names)
    spread = F.coalesce(F.abs(F.try_divide("mad", "median")), F.lit(0.0))
    return found.select(F.col("group").alias(PLATE), labels[F.col("i")].alias("feature"), "median", "mad", "min", "max", F.col("n").alias("count"), spread.alias("abs_coef_var"))


def variant_features(stats: DataFrame, least: float = 1e-3) -> DataFrame:
    """Features that vary on every plate: a MAD other than 0 and enough relative spread."""
    passes = ((F.col("mad") != 0) & (F.col("abs_coef_var") > least)).cast("int")
    plates = stats.agg(F.countDistinct(PLATE).alias("n_plates"))
    return stats.groupBy("feature").agg(F.sum(passes).alias("n_pass")).join(plates, F.col("n_pass") == F.col("n_plates")).select("feature")


def select_variant_features(df: DataFrame, names: list[str], stats: DataFrame, least: float = 1e-3) -> tuple[DataFrame, list[str]]:
    return take_features(df, names, [r[0] for r in variant_features(stats, least).collect()])  # names of features


def robust_z(df: DataFrame, names: list[str], stats: DataFrame) -> DataFrame:
    """(x - median) / MAD of the plate; where the MAD is 0 or unknown, x itself. One row of statistics goes out a plate; they
    are written first, so that a plate's cells are not shuffled into one task."""
    at = stats.sparkSession.range(1).select(F.posexplode(constant(names)).alias("i", "feature"))
    every = stats.select(PLATE).distinct().crossJoin(at).join(stats.select(PLATE, "feature", "median", "mad"), [PLATE, "feature"], "left")  # a row for each plate and feature
    packed = stored(every.groupBy(PLATE).agg(F.array_sort(F.collect_list(F.struct("i", "median", "mad"))).alias("__s")), "scales")
    scaled = F.zip_with("features", "__s", lambda x, s: F.when(s["mad"] != 0, (x - s["median"]) / s["mad"]).otherwise(x))
    return df.join(packed, PLATE).withColumn("features", scaled).drop("__s")


def feature_spread(df: DataFrame, names: list[str]) -> DataFrame:
    """feature, std over the rows that have a value; null with fewer than two."""
    return feature_moments(df, names).select("feature", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"))


def drop_dead_features(df: DataFrame, names: list[str], least: float = 1e-6) -> tuple[DataFrame, list[str]]:
    kept = [r["feature"] for r in feature_spread(df, names).where((F.col("std") >= least) & ~F.isnan("std")).collect()]  # names
    return take_features(df, names, kept)
