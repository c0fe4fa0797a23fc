"""Classification of a batch by groups of cells: each cell written once, whatever its pairs and folds, and results as from cells of each pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateaux.operators import annotate, contract, folds, learn, metrics, pairs
from plateaux.operators.contract import ALLELE, OBJECT, PLATE, PLATEMAP, SYMBOL, WELL
from plateaux.plans import pipelines

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cells(spark):
    """Two genes with variants, a control in several wells, plates of two platemaps and of none, wells without a name, missing values."""
    r = np.random.default_rng(31)
    rows = []
    for i in range(3000):
        gene, variant = [("G", ""), ("G", "_V1"), ("G", "_V2"), ("H", ""), ("H", "_V1"), ("N", "")][r.integers(6)]
        m = [None, "P1", "P2"][r.integers(3)]
        x = [float(r.normal() + (variant == "_V1")), float(r.integers(4)), None if i % 50 == 0 else float("inf") if i % 51 == 0 else float(r.normal(100, 30))]
        rows.append((gene, gene + variant, f"{m}T{r.integers(1, 4)}", m, None if r.random() < 0.1 else f"w{r.integers(3)}", i, x))
    df = spark.createDataFrame(rows, f"{SYMBOL} string, {ALLELE} string, {PLATE} string, {PLATEMAP} string, {WELL} string, {OBJECT} long, features array<double>").repartition(5)
    return annotate.annotate_controls(df, [], ["N"], [], []).cache()


def test_cells_are_written_once(spark, cells, monkeypatch):
    written, stored = {}, learn.stored

    def spy(df, name):
        out = stored(df, name)
        if name in ("blocks", "training"):
            written[name] = sum(len(x["x"]) // 8 // len(NAMES) for x in out.select("x").collect())
        return out

    monkeypatch.setattr(learn, "stored", spy)
    found = pipelines.classify(cells, NAMES, least=20, least_control=5)["metrics"]
    used = cells.where(f"{ALLELE} <> 'N' or {PLATEMAP} is not null and {WELL} is not null").count()
    assert written == {"blocks": used}
    assert found.agg(F.sum("n_test")).first()[0] > 1.2 * used  # a wild type is in a pair with each variant, a control well with each other


def test_groups_give_what_cells_of_each_pair_give(spark, cells, monkeypatch):
    wanted = pairs.all_pairs(cells, 20, 5)
    labelled = pairs.labelled_cells(cells.select(ALLELE, PLATE, PLATEMAP, WELL, OBJECT, "features"), wanted)
    labelled = folds.fold_lists(labelled, folds.plate_folds(labelled)).cache()
    sizes = learn.usable(folds.list_sizes(labelled))
    name = lambda k: F.concat_ws("__", "pair_id", F.lit("ALL"), k.cast("string"))
    rows = labelled.select("Label", OBJECT, "features", *[F.transform(c, name).alias(c) for c in ("tests", "trains")])
    scored, top = learn.fit_tasks(rows, sizes.withColumn("task_id", name(F.col("fold_id"))), NAMES)
    want = {(x["task_id"], x[OBJECT]): (x["Label"], x["prediction"]) for x in scored.collect()}
    plain = {x["task_id"]: x for x in metrics.classifier_metrics(scored.withColumnRenamed("Label", "label"), ["task_id"]).collect()}
    monkeypatch.setattr(learn, "BLOCK", 8 * 3 * 16)  # blocks of 16 cells, and groups dealt to several tasks
    monkeypatch.setattr(learn, "PART", 1 << 12)
    got = pipelines.classify(cells, NAMES, least=20, least_control=5)
    assert want.keys() == {(x["Classifier_ID"], x[OBJECT]) for x in got["predictions"].collect()} and got["predictions"].count() == len(want)
    assert all((x["Label"], x["Prediction"]) == (want[x["Classifier_ID"], x[OBJECT]][0], pytest.approx(want[x["Classifier_ID"], x[OBJECT]][1], abs=1e-6)) for x in got["predictions"].collect())
    found = got["metrics"].collect()
    assert {x["classifier_id"] for x in found} == plain.keys() and len(found) == len(plain) > 20
    of_size = {(x["pair_id"], x["fold_id"]): x for x in sizes.collect()}
    for x in found:
        assert all(x[c] == of_size[x["pair_id"], x["fold_id"]][c] for c in ("n_train", "n_test", "n_train_ref", "n_train_var", "imbalance_ratio"))
        assert x["n_pos"] + x["n_neg"] == x["n_test"] and all(x[c] == pytest.approx(plain[x["classifier_id"]][c], abs=1e-9) for c in metrics.MEASURES)
    best = {(x["task_id"], x["feature"]): x["importance"] for x in top.collect()}
    assert {(x["task_id"], x["feature"]): pytest.approx(x["importance"], abs=1e-6) for x in got["importances"].collect()} == best


def test_channels_and_wide_fits(spark, cells, monkeypatch):
    """Channels share the cells; where the learner is Spark's, the tables are the same but for its tolerance."""
    channels = {"X": ["a", "b"], "Y": NAMES}
    run = lambda: {x["classifier_id"]: x for x in pipelines.classify(cells, NAMES, "G", channels, least=20)["metrics"].collect()}
    narrow = run()
    monkeypatch.setattr(learn, "NARROW", 0)
    wide = run()
    assert narrow.keys() == wide.keys() and {x["channel"] for x in narrow.values()} == {"X", "Y"}
    assert all(narrow[k]["n_pos"] == wide[k]["n_pos"] and narrow[k]["auroc"] == pytest.approx(wide[k]["auroc"], abs=0.03) for k in narrow)


def test_metrics_of_lists(spark, monkeypatch):
    """Lists of scores give what rows do, with ties, one class alone, and groups too large for a task."""
    r = np.random.default_rng(4)
    rows = [(g, int(y), float(s)) for g, n, p in (("ties", 300, 0.4), ("one", 20, 0.0), ("other", 20, 1.0), ("large", 2000, 0.5), (None, 50, 0.5)) for y, s in zip(r.random(n) < p, np.round(r.random(n), 1 if g == "ties" else 3), strict=True)]
    df = spark.createDataFrame(rows, "g string, label int, prediction double").repartition(3)
    lists = df.withColumn("part", F.spark_partition_id()).groupBy("g", "label", "part").agg(F.collect_list("prediction").alias("scores")).drop("part")
    want = {x["g"]: x for x in metrics.classifier_metrics(df, ["g"]).collect()}
    for most in (1 << 21, 500):
        monkeypatch.setattr(metrics, "LISTED", most)
        got = {x["g"]: x for x in metrics.listed_metrics(lists, "g").collect()}
        assert got.keys() == want.keys() and len(got) == 5
        assert all(got[k][c] == (None if want[k][c] is None else pytest.approx(want[k][c], abs=1e-12)) for k in want for c in metrics.MEASURES)
    assert metrics.listed_metrics(lists.limit(0), "g").collect() == []
