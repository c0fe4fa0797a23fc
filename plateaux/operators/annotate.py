"""Control annotation, split manifests, label indices and row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .contract import ALLELE, CONTROL, NODE, PLATE, SYMBOL, cell_id, template_number
from .order import numbered

Names = list[str]


def _in(column: str, names: Names) -> Column:
    return F.col(column).isin(*names) if names else F.lit(False)


def annotate_controls(df: DataFrame, tc: Names, nc: Names, pc: Names, cpc: Names) -> DataFrame:
    """node_type: wild type or allele, overridden by TC, NC, PC; Control: Exp, cPC (allele or gene listed), then TC, NC, PC."""
    listed = lambda base: F.when(_in(ALLELE, pc), "PC").when(_in(ALLELE, nc), "NC").when(_in(ALLELE, tc), "TC").otherwise(base)
    node = F.when(F.col(ALLELE) == F.col(SYMBOL), "disease_wt").otherwise("allele")
    control = F.when(_in(SYMBOL, cpc) | _in(ALLELE, cpc), "cPC").otherwise("Exp")
    return df.withColumns({NODE: listed(node), CONTROL: listed(control)})


def control_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(NODE, CONTROL).agg(F.count("*").alias("n_cells"))


def split_of(plate: Column | str = PLATE) -> Column:
    """train for replicates 1 and 2, val for 3, test for 4 and for all else."""
    n = template_number(plate)
    return F.when(n.isin(1, 2), "train").when(n == 3, "val").otherwise("test")


def split_manifest(df: DataFrame, batch: str) -> DataFrame:
    """A row for each cell: batch, gene, variant, position within the variant, cell id, plate, replicate, split."""
    keyed = df.withColumn("metadata_cell_id", cell_id())
    order = W.partitionBy(ALLELE).orderBy(PLATE, "metadata_cell_id")
    return keyed.select(F.lit(batch).alias("batch_id"), F.col(SYMBOL).alias("gene"), F.col(ALLELE).alias("variant"), (F.row_number().over(order) - 1).cast("long").alias("cell_idx"), "metadata_cell_id", F.col(PLATE).alias("plate"), template_number().alias("template_num"), split_of().alias("split"))


def label_index(train: DataFrame, other: DataFrame, label: str, unseen: str = "drop") -> DataFrame:
    """``other`` with the index of its label among the sorted labels of ``train``; unseen ones dropped or set to 0."""
    index = numbered(train.select(label).where(F.col(label).isNotNull()).distinct(), [label], "label_index")
    joined = other.join(index, label, "inner" if unseen == "drop" else "left")
    return joined.withColumn("label_index", F.coalesce("label_index", F.lit(0)))


def row_ids(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Position of each row in its group, under a declared total order."""
    return df.withColumn("position", (F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1).cast("long"))
