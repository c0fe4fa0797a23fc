"""The profile contract: metadata columns, packed features, and conversions between the wide and the packed form.

A packed table has the metadata columns and ``features array<double>``; the list of feature names, in the order of the
array, is a plain Python list, as it is schema and not data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import constant

PLATE, WELL, SITE, IMAGE, OBJECT = "Metadata_Plate", "Metadata_well_position", "Metadata_Site", "Metadata_ImageNumber", "Metadata_ObjectNumber"
ALLELE, SYMBOL, PLATEMAP, NODE, CONTROL = "Metadata_gene_allele", "Metadata_symbol", "Metadata_plate_map_name", "Metadata_node_type", "Metadata_Control"
KEYS = [PLATE, WELL, IMAGE, OBJECT]
REQUIRED = [PLATE, WELL, SITE, IMAGE, OBJECT, ALLELE, SYMBOL, NODE, CONTROL, PLATEMAP]


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Metadata columns, and feature columns: whatever has no Metadata_ prefix."""
    meta = [c for c in df.columns if c.startswith("Metadata_")]
    return meta, [c for c in df.columns if not c.startswith("Metadata_")]


def pack(df: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Wide to packed; the names are returned in array order."""
    meta, found = split_columns(df)
    names = names or found
    return df.select(*meta, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("features")), names


def unpack(df: DataFrame, names: list[str], dtype: str = "float") -> DataFrame:
    return df.select(*[c for c in df.columns if c != "features"], *[F.col("features")[i].cast(dtype).alias(n) for i, n in enumerate(names)])


def take_features(df: DataFrame, names: list[str], kept: list[str]) -> tuple[DataFrame, list[str]]:
    """Keep some features, in their old order; the array is read once, also where it is an expression."""
    own = set(kept)
    ids = [i for i, n in enumerate(names) if n in own]
    mask = constant([int(n in own) for n in names], "int")
    return df.withColumn("features", F.filter("features", lambda _, i: mask[i] == 1)), [names[i] for i in ids]


def long_form(df: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Rows (keys, feature, value)."""
    labels = constant(names)
    return df.select(*keys, F.posexplode("features").alias("__i", "value")).select(*keys, labels[F.col("__i")].alias("feature"), "value")


def with_well_column(df: DataFrame) -> DataFrame:
    """Both spellings of the well column are there afterwards."""
    for have, want in ((WELL, "Metadata_Well"), ("Metadata_Well", WELL)):
        if want not in df.columns and have in df.columns:
            df = df.withColumn(want, F.col(have))
    return df


def required_metadata(df: DataFrame) -> DataFrame:
    return with_well_column(df).select(*REQUIRED, *[c for c in df.columns if not c.startswith("Metadata_")])


def cell_id(*columns: str) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in (columns or (PLATE, WELL, IMAGE, OBJECT))])


def template_number(plate: Column | str = PLATE) -> Column:
    """n of a plate name that ends in Tn, else null."""
    plate = F.col(plate) if isinstance(plate, str) else plate
    return F.regexp_extract(plate, "T([0-9]+)$", 1).try_cast("int")


def flatten_embeddings(df: DataFrame, grids: str, vector: str) -> DataFrame:
    """One packed array of a nested array column and a flat one."""
    return df.withColumn("features", F.concat(F.flatten(F.col(grids)), F.col(vector)))


def join_metadata(embeddings: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Inner join on a cell id, without rows that lack the features."""
    return meta.join(embeddings, key, "inner").dropna(subset=["features"])


def overlap_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys are on the left, on the right, and on both sides."""
    a, b = left.select(key).distinct().withColumn("__l", F.lit(1)), right.select(key).distinct().withColumn("__r", F.lit(1))
    return a.join(b, key, "full").agg(F.count("__l").alias("n_left"), F.count("__r").alias("n_right"), F.count(F.col("__l") + F.col("__r")).alias("n_both"))


def first_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the smallest by all columns."""
    order = [F.col(c) for c in df.columns]
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def common_features(tables: list[tuple[DataFrame, list[str]]]) -> list[str]:
    """Names that every table has, in the first one's order."""
    rest = [set(names) for _, names in tables[1:]]
    return [n for n in tables[0][1] if all(n in r for r in rest)]


def union_all(frames: list[DataFrame], diagonal: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=diagonal), frames)


def smoke_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """At most n rows, chosen by a hash of the key; the sampling itself is the feature."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def variance_sample(df: DataFrame, n: int, key: str, names: list[str]) -> DataFrame:
    """Variance of each feature over the first n rows by key."""
    return long_form(df.orderBy(key).limit(n), names).groupBy("feature").agg(F.var_samp("value").alias("variance"))
