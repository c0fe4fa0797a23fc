"""Consistency of genes that share labels, such as organelles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .ranking import Side, precision


def gene_labels(scores: DataFrame, least: float = 1.0) -> DataFrame:
    """(gene, labels) from long scores; of repeated rows the highest counts, a null score is 0, genes without labels go."""
    best = scores.where("gene is not null").groupBy("gene", "organelle").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("s")).where(F.col("s") >= least)
    return best.groupBy("gene").agg(F.sort_array(F.collect_list("organelle")).alias("labels"))


def wide_to_long(wide: DataFrame, keys: tuple[str, ...] = ("gene",)) -> DataFrame:
    return wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], "organelle", "score")


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.select(F.explode("labels").alias("organelle")).groupBy("organelle").agg(F.count("*").alias("n_genes"))


def multilabel_ap(pool: DataFrame, row: str, key: str, run: list[str] = (), differ: list[str] = ()) -> DataFrame:
    """One AP for each row and label: positives have another key and the label, and differ in ``differ``; negatives have
    another key and no common label. Labels that a row has are ranked also where no other row has them (ap null)."""
    base = stored(pool.select(F.col(row).alias("id"), *[c for c in dict.fromkeys([key, *run, *differ]) if c != row], "labels", F.col("features").cast("array<double>").alias("features")), "pool")
    found = precision(base, base, Side([], [key, *differ], True), Side([], [key], False), run)
    return found.join(base.select("id", *run, *([key] if key not in run else [])), ["id", *run]).withColumnRenamed("id", row)


LEVELS = {"gene": [], "plate": ["plate"], "fov": ["plate", "unit"]}


def consensus(df: DataFrame, labels: DataFrame, levels: list[str], unit: str = "site") -> DataFrame:
    """Median profiles of genes that have labels, at each of the levels: gene; gene and plate; gene, plate and unit (fov).

    One pass of grouping sets over the cells; the level is a column, and plate and unit are null above their level. ``df`` has
    symbol, plate, the unit and features. Columns: level, id, symbol, plate, labels, features.
    """
    if unknown := set(levels) - set(LEVELS):
        raise ValueError(f"unknown levels {sorted(unknown)}; known are {sorted(LEVELS)}")
    own = df.join(labels.select(F.col("gene").alias("symbol")), "symbol", "left_semi")
    keys = ["symbol", "plate", "unit", "i"]
    long = own.select("symbol", "plate", F.col(unit).alias("unit"), F.posexplode("features").alias("i", "x"))
    sets = [[F.col("symbol"), *[F.col(c) for c in LEVELS[name]], F.col("i")] for name in levels]
    marks = (F.grouping("plate") * 2 + F.grouping("unit")).alias("mark")
    medians = long.groupingSets(sets, *[F.col(c) for c in keys]).agg(marks, F.median("x").alias("m"))
    name = F.when(F.col("mark") == 3, "gene").when(F.col("mark") == 1, "plate").otherwise("fov").alias("level")
    packed = medians.groupBy(name, "symbol", "plate", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("features"))
    id_ = F.concat_ws("|", "level", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("symbol", "plate", "unit")])
    return packed.withColumn("id", id_).join(labels.select(F.col("gene").alias("symbol"), "labels"), "symbol").select("level", "id", "symbol", "plate", "labels", "features")


def level_ap(pool: DataFrame, run: list[str] = ()) -> DataFrame:
    """AP of every profile of consensus() and label, within its level and ``run``; where profiles have plates, positives are on
    other plates than the query."""
    apart = pool.withColumn("__plate", F.when(F.col("level") == "gene", F.col("symbol")).otherwise(F.col("plate")))
    return multilabel_ap(apart, "id", "symbol", ["level", *run], ["__plate"])


def summarize(results: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of labels and of significant ones, mean and median scores, and the share that is significant."""
    n = F.count("*")
    hit = F.sum(F.col("below_corrected_p").cast("long"))
    return results.groupBy(*keys).agg(F.countDistinct("label").alias("n_labels"), hit.alias("n_significant"), F.avg("mAP").alias("mean_map"), F.median("mAP").alias("median_map"), F.avg("mAP_norm").alias("mean_norm"), F.median("mAP_norm").alias("median_norm"), (100 * hit / n).alias("percent_significant"))
