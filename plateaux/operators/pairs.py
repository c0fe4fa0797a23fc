"""Reference-versus-variant pairs, control pairs, and the labelled cells of all pairs at once.

A pair carries its platemap and wells as columns, so nothing is parsed back from ids. ``category``: experimental, cpc or
control; control pairs are two wells of one allele and platemap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contract import ALLELE, CONTROL, NODE, PLATEMAP, SYMBOL, WELL

COLUMNS = ["pair_id", "gene", "allele_ref", "allele_var", "is_control", "category", "platemap", "well_ref", "well_var"]


def allele_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(SYMBOL, ALLELE, NODE, CONTROL).agg(F.count("*").alias("n_cells"))


def _size(n: str | None) -> Column:
    """How many cells: rows, or the sum of a column that counts them."""
    return (F.count("*") if n is None else F.sum(n)).alias("n")


def _ref_var(df: DataFrame, control: str, category: str, least: int, n: str | None) -> DataFrame:
    """Each gene's wild type with enough cells against each of its variants with enough."""
    counts = df.where(F.col(CONTROL) == control).groupBy(SYMBOL, ALLELE, NODE).agg(_size(n)).where(F.col("n") >= least)
    refs = counts.where(F.col(NODE) == "disease_wt").select(F.col(SYMBOL).alias("gene"), F.col(ALLELE).alias("allele_ref"))
    variants = counts.where(F.col(NODE) == "allele").select(F.col(SYMBOL).alias("gene"), F.col(ALLELE).alias("allele_var"))
    none = F.lit(None).cast("string")
    return refs.join(variants, "gene").select(F.concat_ws("__", "gene", "allele_ref", "allele_var").alias("pair_id"), "gene", "allele_ref", "allele_var", F.lit(False).alias("is_control"), F.lit(category).alias("category"), none.alias("platemap"), none.alias("well_ref"), none.alias("well_var"))


def experimental_pairs(df: DataFrame, least: int = 50, n: str | None = None) -> DataFrame:
    return _ref_var(df, "Exp", "experimental", least, n)


def cpc_pairs(df: DataFrame, least: int = 50, n: str | None = None) -> DataFrame:
    return _ref_var(df, "cPC", "cpc", least, n)


def control_pairs(df: DataFrame, kinds: tuple[str, ...] = ("NC", "PC"), least: int = 50, n: str | None = None) -> DataFrame:
    """All pairs of wells (by name) of one control allele on one platemap, each with enough cells."""
    wells = df.where(F.col(CONTROL).isin(*kinds)).groupBy(ALLELE, SYMBOL, PLATEMAP, WELL).agg(_size(n)).where(F.col("n") >= least)
    a = wells.select(ALLELE, SYMBOL, PLATEMAP, F.col(WELL).alias("well_ref"))
    b = wells.select(ALLELE, SYMBOL, PLATEMAP, F.col(WELL).alias("well_var"))
    both = a.join(b, [ALLELE, SYMBOL, PLATEMAP]).where("well_ref < well_var")
    return both.select(F.concat_ws("__", F.lit("ctrl"), ALLELE, PLATEMAP, "well_ref", "well_var").alias("pair_id"), F.col(SYMBOL).alias("gene"), F.col(ALLELE).alias("allele_ref"), F.col(ALLELE).alias("allele_var"), F.lit(True).alias("is_control"), F.lit("control").alias("category"), F.col(PLATEMAP).alias("platemap"), "well_ref", "well_var")


def all_pairs(df: DataFrame, least: int = 50, least_control: int | None = None, n: str | None = None) -> DataFrame:
    """Pairs of all categories, from cells, or from counts of cells in the column ``n``."""
    return experimental_pairs(df, least, n).unionByName(cpc_pairs(df, least, n)).unionByName(control_pairs(df, least=least if least_control is None else least_control, n=n))


def filter_scope(pairs: DataFrame, scope: str) -> DataFrame:
    """Comma-separated: all, exp, cpc, control, or names of genes or alleles; each pair once."""
    words = [w.strip() for w in scope.split(",") if w.strip()]
    if "all" in [w.lower() for w in words]:
        return pairs.dropDuplicates(["pair_id"])
    kinds = [{"exp": "experimental", "cpc": "cpc", "control": "control"}[w.lower()] for w in words if w.lower() in ("exp", "cpc", "control")]
    names = [w for w in words if w.lower() not in ("exp", "cpc", "control")]
    keep = F.lit(False)
    if kinds:
        keep = keep | F.col("category").isin(*kinds)
    if names:
        keep = keep | F.col("gene").isin(*names) | F.col("allele_var").isin(*names)
    return pairs.where(keep).dropDuplicates(["pair_id"])


def scope_alleles(df: DataFrame, kinds: tuple[str, ...] = ("Exp", "cPC"), least: int = 50) -> DataFrame:
    """Variants (not wild types) of these kinds with enough cells."""
    return df.where(F.col(CONTROL).isin(*kinds) & (F.col(NODE) == "allele")).groupBy(ALLELE).agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= least)


def orphan_genes(df: DataFrame) -> DataFrame:
    """Genes with cells on one side only: of variants or of the wild type."""
    genes = df.groupBy(F.col(SYMBOL).alias("gene")).agg(F.max((F.col(NODE) == "disease_wt").cast("int")).alias("has_wt"), F.max((F.col(NODE) == "allele").cast("int")).alias("has_variant"))
    return genes.where("has_wt + has_variant = 1")


def labelled_cells(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells of all pairs, label 1 for the reference and 0 for the variant: one join on the allele, wells as a residual."""
    refs = pairs.select(*[c for c in COLUMNS if c != "category"], F.col("allele_ref").alias("__allele"), F.lit(1).alias("Label"))
    variants = pairs.select(*[c for c in COLUMNS if c != "category"], F.col("allele_var").alias("__allele"), F.lit(0).alias("Label"))
    sides = refs.unionByName(variants).withColumn("__well", F.when(F.col("is_control"), F.when(F.col("Label") == 1, F.col("well_ref")).otherwise(F.col("well_var"))))
    fits = (df[ALLELE] == sides["__allele"]) & (~F.col("is_control") | (df[PLATEMAP] == sides["platemap"]) & (df[WELL] == sides["__well"]))
    return df.join(sides, fits).drop("__allele", "__well", "platemap")


