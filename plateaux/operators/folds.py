"""Cross-validation folds over labelled cells (pair_id, Label, plate, platemap, well), and the tasks they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .contract import PLATE, PLATEMAP, WELL


def plate_folds(cells: DataFrame) -> DataFrame:
    """Leave one plate out, within each platemap that has at least two: fold_id, test and train plates, test wells."""
    plates = cells.select("pair_id", PLATEMAP, PLATE).distinct()
    sets = plates.withColumn("all_plates", F.sort_array(F.collect_set(PLATE).over(W.partitionBy("pair_id", PLATEMAP)))).where(F.size("all_plates") >= 2)
    folds = sets.withColumn("fold_id", (F.row_number().over(W.partitionBy("pair_id").orderBy(PLATEMAP, PLATE)) - 1).cast("int"))
    wells = cells.groupBy("pair_id", PLATE).agg(F.sort_array(F.collect_set(WELL)).alias("test_wells"))
    train = F.filter("all_plates", lambda p: p != F.col(PLATE))
    return folds.join(wells, ["pair_id", PLATE]).select("pair_id", "fold_id", F.array(PLATE).alias("test_plates"), "test_wells", train.alias("train_plates"))


def well_pair_folds(cells: DataFrame) -> DataFrame:
    """Wells of both labels are paired by rank; every two of the first n pairs are one test set (n: the smaller side)."""
    wells = cells.select("pair_id", "Label", WELL).distinct().withColumn("k", F.row_number().over(W.partitionBy("pair_id", "Label").orderBy(WELL)))
    side = lambda label, name: wells.where(F.col("Label") == label).select("pair_id", "k", F.col(WELL).alias(name))
    paired = side(1, "ref").join(side(0, "var"), ["pair_id", "k"])
    a, b = paired.select("pair_id", F.col("k").alias("i"), F.array("ref", "var").alias("first")), paired.select("pair_id", F.col("k").alias("j"), F.array("ref", "var").alias("second"))
    both = a.join(b, "pair_id").where("i < j")
    fold = (F.row_number().over(W.partitionBy("pair_id").orderBy("i", "j")) - 1).cast("int")
    return both.select("pair_id", fold.alias("fold_id"), F.sort_array(F.array_distinct(F.concat("first", "second"))).alias("test_wells"))


def split_by_fold(cells: DataFrame, folds: DataFrame, layout: str = "plates") -> DataFrame:
    """Cells of each fold with role test or train; cells of plates that are in neither are left out."""
    joined = cells.join(folds, "pair_id")
    if layout == "wells":
        return joined.withColumn("role", F.when(F.array_contains("test_wells", F.col(WELL)), "test").otherwise("train"))
    role = F.when(F.array_contains("test_plates", F.col(PLATE)), "test").when(F.array_contains("train_plates", F.col(PLATE)), "train")
    return joined.withColumn("role", role).where("role is not null")


def fold_lists(cells: DataFrame, folds: DataFrame, layout: str = "plates") -> DataFrame:
    """One row a cell and pair, as given, with the numbers of the folds that it is tested in (``tests``) and learned from
    (``trains``): what split_by_fold() says, without a copy of the cell for each fold."""
    if layout == "wells":
        each = folds.select("pair_id", "fold_id", F.explode("test_wells").alias(WELL))
        every = folds.groupBy("pair_id").agg(F.sort_array(F.collect_list("fold_id")).alias("__all"))
        tests = each.groupBy("pair_id", WELL).agg(F.sort_array(F.collect_list("fold_id")).alias("tests"))
        joined = cells.join(every, "pair_id").join(tests, ["pair_id", WELL], "left").withColumn("tests", F.coalesce("tests", F.array().cast("array<int>")))
        return joined.withColumn("trains", F.array_except("__all", "tests")).drop("__all")
    roles = [folds.select("pair_id", "fold_id", F.explode(f"{name}_plates").alias(PLATE), F.lit(name).alias("role")) for name in ("test", "train")]
    own = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("fold_id"))))
    lists = roles[0].unionByName(roles[1]).groupBy("pair_id", PLATE).agg(own("test").alias("tests"), own("train").alias("trains"))
    return cells.join(lists, ["pair_id", PLATE])


def list_sizes(cells: DataFrame, least_train: int = 50, least_test: int = 10, n: str | None = None) -> DataFrame:
    """task_sizes() of rows with lists of folds: counted by the lists, which are few, before folds become rows. A row is a cell,
    or as many as its column ``n`` says."""
    counted = cells.groupBy("pair_id", "Label", "tests", "trains").agg((F.count("*") if n is None else F.sum(n)).alias("n"))
    sides = [counted.select("pair_id", "Label", "n", F.explode(c).alias("fold_id"), F.lit(c).alias("side")) for c in ("tests", "trains")]
    sum_of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    train, test = F.col("side") == "trains", F.col("side") == "tests"
    sizes = sides[0].unionByName(sides[1]).groupBy("pair_id", "fold_id").agg(sum_of(train).alias("n_train"), sum_of(test).alias("n_test"), sum_of(train & (F.col("Label") == 1)).alias("n_train_ref"), sum_of(train & (F.col("Label") == 0)).alias("n_train_var"))
    ratio = F.try_divide(F.greatest("n_train_ref", "n_train_var"), F.least("n_train_ref", "n_train_var"))
    return sizes.where((F.col("n_train") >= least_train) & (F.col("n_test") >= least_test)).withColumn("imbalance_ratio", ratio)


def task_sizes(split: DataFrame, least_train: int = 50, least_test: int = 10) -> DataFrame:
    """Folds with enough rows on both sides, their class counts in training, and the imbalance ratio."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    train, test = F.col("role") == "train", F.col("role") == "test"
    sizes = split.groupBy("pair_id", "fold_id").agg(n(train).alias("n_train"), n(test).alias("n_test"), n(train & (F.col("Label") == 1)).alias("n_train_ref"), n(train & (F.col("Label") == 0)).alias("n_train_var"))
    ratio = F.try_divide(F.greatest("n_train_ref", "n_train_var"), F.least("n_train_ref", "n_train_var"))
    return sizes.where((F.col("n_train") >= least_train) & (F.col("n_test") >= least_test)).withColumn("imbalance_ratio", ratio)
