"""Row and feature gates: manifest, well counts, missing values, clipping, plate filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import missing, present
from ..sources.scratch import stored
from .contract import KEYS, PLATE, WELL, long_form, take_features, template_number
from .moments import feature_moments


def filter_to_manifest(df: DataFrame, manifest: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cells that the manifest lists; a semi join, so repeated manifest rows do no harm."""
    return df.join(manifest.select(*keys), keys, "left_semi")


def drop_low_count_wells(df: DataFrame, least: int = 20) -> DataFrame:
    """Cells of wells with at least this many; counts meet first on the map side, then the small table joins back.

    The wells are written first: their size is known when the join is planned, so the cells are not shuffled by well.
    """
    enough = stored(df.groupBy(PLATE, WELL).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n"), "wells")
    return df.join(enough, [PLATE, WELL], "left_semi")


def missing_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """feature, n_missing: one pass over all features, without a row or a column for each."""
    return feature_moments(df, names).select("feature", "n_missing")


def drop_missing(df: DataFrame, names: list[str], most: int = 100) -> tuple[DataFrame, list[str]]:
    """Features missing in more than ``most`` rows go, then rows that still miss any; the rest holds finite numbers."""
    kept = [r["feature"] for r in missing_counts(df, names).where(F.col("n_missing") <= most).collect()]  # names of features
    df, names = take_features(df, names, kept)
    return df.where(~F.exists("features", missing)), names


def clip(df: DataFrame, limit: float = 100.0) -> DataFrame:
    """Values into [-limit, limit]; null and NaN stay."""
    bound = F.lit(float(limit))
    return df.withColumn("features", F.transform("features", lambda x: F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(-bound, F.least(bound, x)))))


def clip_counts(df: DataFrame, names: list[str], limit: float) -> DataFrame:
    """feature, n_clipped for features with a value beyond the limit."""
    values = long_form(df, names).withColumn("value", present(F.col("value")))
    return values.where(F.abs("value") > limit).groupBy("feature").agg(F.count("*").alias("n_clipped"))


def templates(df: DataFrame, wanted: tuple[int, ...] = (3, 4)) -> DataFrame:
    """Rows of plates whose technical replicate is one of these."""
    return df.where(template_number().isin(*wanted))


def plates_ending(df: DataFrame, suffix: str = "T4") -> DataFrame:
    return df.where(F.col(PLATE).endswith(suffix))


def well_counts(df: DataFrame) -> DataFrame:
    return df.withColumn("n_cells", F.count("*").over(W.partitionBy(PLATE, WELL)))
