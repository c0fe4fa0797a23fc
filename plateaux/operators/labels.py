"""Variant label tables of predictors: sentinels, score bins and code maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract import first_per_key

# What counts as no value, code maps, and tiers (lowest score of each, from the top).
SENTINELS = ("", ".")
FIVE_COARSE = {"P": "Pathogenic", "LP": "Pathogenic", "B": "Benign", "LB": "Benign", "A": "Ambiguous"}
FIVE_STRICT = {"P": "Pathogenic", "LP": "Likely pathogenic", "B": "Benign", "LB": "Likely benign", "A": "Ambiguous"}
TWO = {"D": "Pathogenic", "T": "Benign"}
COARSE_TIERS = ((0.5, "Pathogenic"), (float("-inf"), "Benign"))
REVEL_TIERS = ((0.773, "Pathogenic"), (0.644, "Likely pathogenic"), (0.290, "Ambiguous"), (0.183, "Likely benign"), (0.0, "Benign"))
MUTPRED_TIERS = ((0.75, "Pathogenic"), (0.50, "Likely pathogenic"), (0.25, "Likely benign"), (0.0, "Benign"))

#: predictor: rules (label column, source column, how): codes as a map, scores as tiers, None for labels as they are.
RULES = {
    "clinvar": [("clinvar_label", "clinvar_clnsig_clean", None), ("clinvar_label_strict", "clinvar_clnsig_clean_pp_strict", None)],
    "alphamissense": [("alphamissense_label", "AlphaMissense_pred", FIVE_COARSE), ("alphamissense_label_strict", "AlphaMissense_pred", FIVE_STRICT)],
    "esm1b": [("esm1b_label", "ESM1b_pred", TWO)],
    "revel": [("revel_label", "REVEL_score", COARSE_TIERS), ("revel_label_strict", "REVEL_score", REVEL_TIERS)],
    "mutpred": [("mutpred_label", "MutPred_score", COARSE_TIERS), ("mutpred_label_strict", "MutPred_score", MUTPRED_TIERS)],
}


def ruled(source: str, how) -> Column:
    """A label by its rule; null where the value is a sentinel, no number where one is due, or reaches no tier."""
    if how is None:
        return F.col(source)
    value = F.when(~F.col(source).isin(*SENTINELS), F.col(source))
    if isinstance(how, dict):
        return F.create_map(*[F.lit(x) for pair in how.items() for x in pair])[value]
    score, out = value.try_cast("double"), F.lit(None).cast("string")
    for edge, label in reversed(how):
        out = F.when(score >= edge, label).otherwise(out)
    return out


def predictor_labels(variants: DataFrame, predictor: str) -> DataFrame:
    """gene_variant and the predictor's labels, one row for each variant."""
    if predictor not in RULES:
        raise ValueError(f"unknown predictor {predictor!r}; known are {sorted(RULES)}")
    rules = RULES[predictor]
    sources = list(dict.fromkeys(source for _, source, _ in rules))
    return first_per_key(variants.select("gene_variant", *sources), ["gene_variant"]).select("gene_variant", *[ruled(source, how).alias(name) for name, source, how in rules])


def comparisons(spark: SparkSession, predictor: str) -> DataFrame:
    """(comparison, label_column, group_a, group_b): pathogenic against benign by each label column."""
    columns = [name for name, _, _ in RULES[predictor]]
    rows = [("Pathogenic_vs_Benign" + ("_strict" if c.endswith("_strict") else ""), c, "Pathogenic", "Benign") for c in columns]
    return spark.createDataFrame(rows, "comparison string, label_column string, group_a string, group_b string")
