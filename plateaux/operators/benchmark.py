"""Result tables across representations and batches: loading, averaging, label joins and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import benjamini_hochberg, rank_sum_tests

METRIC_COLUMNS = ["auroc_mean", "auprc_mean", "balanced_accuracy_mean"]


def load_metrics(summaries: DataFrame, wanted: DataFrame, channels: DataFrame) -> DataFrame:
    """Rows of the wanted (pair_name, batch) and (representation, channel) pairs, tagged, without control pairs.

    Pairs without rows are skipped; nothing at all is an error.
    """
    found = summaries.join(wanted, "batch").join(channels, ["representation", "channel"], "left_semi").where(~F.col("pair_id").startswith("ctrl__"))
    if found.limit(1).count() == 0:
        raise ValueError("no metrics for any of the wanted representations and batches")
    return found


def activity_as_metrics(results: DataFrame) -> DataFrame:
    """Activity results in the metrics' columns: gene is what stands before the first underscore."""
    return results.select(F.split("Metadata_gene_allele", "_")[0].alias("gene"), F.col("Metadata_gene_allele").alias("allele_var"), F.concat("channel", F.lit("_vs_ref")).alias("channel"), F.col("mAP_vs_ref_norm").alias("auroc_mean"), "batch", "representation").dropna(subset=["auroc_mean"])


def representations(results: DataFrame) -> DataFrame:
    return results.select("representation").distinct()


def average_replicates(metrics: DataFrame, keys: list[str], values: list[str], batches: int = 2) -> DataFrame:
    """Means over biological replicates, of alleles that every batch of the pair has."""
    return metrics.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.countDistinct("batch").alias("n_batches")).where(F.col("n_batches") == batches)


def join_labels(averaged: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Alleles with a label."""
    return averaged.join(labels, averaged["allele_var"] == labels["gene_variant"], "left").where(F.col(label).isNotNull()).drop("gene_variant")


def exclude_genes(df: DataFrame, genes: list[str]) -> DataFrame:
    return df.where(~F.col("gene").isin(*genes)) if genes else df


def predictor_tests(scores: DataFrame, keys: list[str], value: str, comparisons: DataFrame) -> DataFrame:
    """Rank-sum tests of every comparison (comparison, label_column, group_a, group_b), corrected over all rows."""
    parts = []
    for r in comparisons.collect():  # a few rows of configuration
        group = F.when(F.col(r["label_column"]) == r["group_a"], "a").when(F.col(r["label_column"]) == r["group_b"], "b")
        parts.append(rank_sum_tests(scores, keys, value, group).withColumn("comparison", F.lit(r["comparison"])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return benjamini_hochberg(out, "p_value", [], [*keys, "comparison"])


def organelle_differences(scores: DataFrame, gene_labels: DataFrame, label: Column, keys: list[str], value: str, least: int = 3, genes: int = 3) -> DataFrame:
    """Mean of pathogenic less mean of benign scores by organelle, where both arms and the genes are enough."""
    rows = scores.join(gene_labels, "gene").withColumn("__g", F.when(label == "Pathogenic", "a").when(label == "Benign", "b"))
    enough = rows.where("__g is not null").groupBy(*keys, "organelle").agg(F.countDistinct("gene").alias("n_genes")).where(F.col("n_genes") >= genes)
    tests = rank_sum_tests(rows, [*keys, "organelle"], value, "__g", least)
    return tests.join(enough, [*keys, "organelle"]).withColumn("mean_diff", F.col("mean_a") - F.col("mean_b"))


def category_means(scores: DataFrame, label: str, keys: list[str], value: str) -> DataFrame:
    return scores.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def organelle_matrix(results: DataFrame, counts: DataFrame, least: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(organelle, column, mean normalised mAP, smallest corrected p) of organelles with enough genes, short names."""
    short = F.substring_index("organelle", "_GO_", 1)
    out = results.join(counts, "organelle", "left").where(F.col("n_genes") >= least)
    for part in excluded:
        out = out.where(~F.contains("organelle", F.lit(part)))
    return out.groupBy(short.alias("organelle"), "column").agg(F.avg("mAP_norm").alias("mean_norm"), F.min("corrected_p_value").alias("min_p"))


def top_labels(labels: DataFrame, n: int) -> DataFrame:
    """The n most frequent labels; each task keeps its first n, so n rows meet at the end."""
    first = labels.groupBy("organelle").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "organelle").limit(n)
    ranked = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "organelle", "n"))).alias("a"))
    return ranked.select(F.posexplode("a").alias("i", "x")).select("x.organelle", "x.n", (F.col("i") + 1).alias("rank"))
