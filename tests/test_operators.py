"""Hand-made tables for the edge cases of single operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateaux.functions.stats import nearest_quantile
from plateaux.operators import audit, benchmark, contract, labels, metrics, multilabel, normalize, pairs, qc, select, similarity, stats
from plateaux.operators.contract import ALLELE, CONTROL, IMAGE, NODE, OBJECT, PLATE, PLATEMAP, SITE, SYMBOL, WELL

INF, NAN = math.inf, math.nan


def packed(spark, rows):
    return spark.createDataFrame([("P1T1", r) for r in rows], f"{PLATE} string, features array<double>")


def test_missing_values_at_and_above_the_limit(spark):
    df = packed(spark, [[1.0, None, NAN], [2.0, INF, -INF], [3.0, 1.0, None], [None, 1.0, 1.0]])
    counts = {r["feature"]: r["n_missing"] for r in qc.missing_counts(df, ["a", "b", "c"]).collect()}
    assert counts == {"a": 1, "b": 2, "c": 3}
    kept, names = qc.drop_missing(df, ["a", "b", "c"], 2)
    assert names == ["a", "b"] and kept.count() == 1


def test_clip_keeps_nan_and_null(spark):
    got = qc.clip(packed(spark, [[NAN, None, 500.0, -500.0, INF]]), 100).first()["features"]
    assert math.isnan(got[0]) and got[1:] == [None, 100.0, -100.0, 100.0]


def test_plate_stats_without_spread(spark):
    stats_ = {r["feature"]: r for r in normalize.plate_stats(packed(spark, [[1.0, 0.0, 5.0], [2.0, 0.0, 5.0], [4.0, 3.0, 5.0]]), ["a", "b", "c"]).collect()}
    assert (stats_["a"]["median"], stats_["a"]["mad"]) == (2.0, 1.0) and stats_["b"]["abs_coef_var"] == 0.0 and stats_["c"]["mad"] == 0.0
    z = normalize.robust_z(packed(spark, [[4.0, 3.0, 5.0]]), ["a", "b", "c"], normalize.plate_stats(packed(spark, [[1.0, 0.0, 5.0], [2.0, 0.0, 5.0], [4.0, 3.0, 5.0]]), ["a", "b", "c"]))
    assert z.first()["features"] == [2.0, 3.0, 5.0]


@pytest.mark.parametrize("values,expected", [([1.0, 2.0], 2.0), (list(map(float, range(21))), 19.0), ([], None), ([NAN, None], None)])
def test_nearest_quantile(spark, values, expected):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = nearest_quantile(df, "v", ["k"], 0.95).collect()
    assert [r["quantile"] for r in got] == ([] if expected is None else [expected])


def test_metrics_edge_cases(spark):
    rows = [("one", 1, 0.3), ("one", 1, 0.9), ("tied", 1, 0.5), ("tied", 0, 0.5), ("best", 1, 0.9), ("best", 0, 0.1), ("worst", 0, 0.9), ("worst", 1, 0.1)]
    got = {r["k"]: r for r in metrics.classifier_metrics(spark.createDataFrame(rows, "k string, label int, prediction double"), ["k"]).collect()}
    assert got["one"]["auroc"] is None and got["tied"]["auroc"] == 0.5 and got["best"]["auroc"] == 1.0 and got["worst"]["auroc"] == 0.0
    assert got["best"]["auprc"] == 1.0 and got["worst"]["auprc"] == 0.5 and got["tied"]["sensitivity"] == 1.0


def test_auroc_of_swapped_labels(spark):
    r = np.random.default_rng(1)
    rows = [("a", int(y), float(s)) for y, s in zip(r.integers(0, 2, 200), r.random(200), strict=True)]
    df = spark.createDataFrame(rows, "k string, label int, prediction double")
    a = metrics.classifier_metrics(df, ["k"]).first()["auroc"]
    b = metrics.classifier_metrics(df.withColumn("label", 1 - F.col("label")), ["k"]).first()["auroc"]
    assert a + b == pytest.approx(1)


@pytest.mark.parametrize("n,m", [(2, 3), (4, 4), (1, 6)])
def test_exact_rank_sum_tail(n, m):
    every = [sum(sum(1 for b in range(n + m) if b not in own and b < a) for a in own) for own in itertools.combinations(range(n + m), n)]
    for u in range(n * m + 1):
        low = min(u, n * m - u)
        assert stats.exact_tails(n, m)[int(low)] == pytest.approx(min(1, 2 * sum(x <= low for x in every) / len(every)))


def test_rank_sums_need_two_and_take_ties(spark):
    rows = [("x", "a", 1.0), ("x", "a", 2.0), ("x", "b", 2.0), ("x", "b", 3.0), ("y", "a", 1.0), ("y", "b", 2.0), ("x", "b", NAN)]
    got = stats.rank_sum_tests(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "v", "g").collect()
    assert [(r["k"], r["n_a"], r["n_b"], r["u"]) for r in got] == [("x", 2, 2, 0.5)] and 0 < got[0]["p_value"] < 1


def test_benjamini_hochberg_is_monotone(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.02, 0.9, 0.04])], "i int, p double")
    got = [r["corrected_p_value"] for r in stats.benjamini_hochberg(df, "p", [], ["i"]).orderBy("p", "i").collect()]
    assert got == pytest.approx([0.1 / 3, 0.1 / 3, 0.1 / 3, 0.05, 0.9])


def cell(i, plate, symbol, allele, node, x):
    return (i, plate, symbol, allele, node, [float(v) for v in x])


POOL = "vec_id int, plate string, symbol string, gene_allele string, node_type string, features array<double>"


def test_average_precision_cases(spark):
    rows = [cell(0, "p1", "g", "g_v", "allele", (1, 0)), cell(1, "p2", "g", "g_v", "allele", (1, 0)), cell(2, "p1", "g", "g", "disease_wt", (0, 1)), cell(3, "p3", "h", "h_v", "allele", (0, 0)), cell(4, "p3", "h", "h", "disease_wt", (1, 1))]
    ap = {r["vec_id"]: r for r in similarity.normalized(similarity.activity_ap(spark.createDataFrame(rows, POOL), "vec_id")).collect()}
    assert ap[0]["ap"] == 1.0 and (ap[1]["ap"], ap[1]["ap_norm"]) == (1.0, 0.0) and ap[3]["ap"] is None and ap[3]["n_pos"] == 0


def test_chance_level_is_the_mean_over_all_orders(spark):
    for n, m in [(4, 2), (5, 1), (5, 5), (6, 3)]:
        every = [np.mean([(k + 1) / (p + 1) for k, p in enumerate(own)]) for own in itertools.combinations(range(n), m)]
        got = spark.range(1).select(similarity.chance_level(F.lit(n), F.lit(m)).alias("e")).first()["e"]
        assert got == pytest.approx(np.mean(every))
        assert similarity.null_aps(m, n, 4000, 1).mean() == pytest.approx(np.mean(every), abs=0.02)


def test_labels_at_their_cut_offs(spark):
    rows = [("a", "0.183"), ("b", "0.290"), ("c", "0.644"), ("d", "0.773"), ("e", "-1"), ("f", "."), ("g", ""), ("h", None), ("i", "x"), ("j", "0.5")]
    got = {r[0]: (r[1], r[2]) for r in labels.predictor_labels(spark.createDataFrame(rows, "gene_variant string, REVEL_score string"), "revel").collect()}
    assert got["a"] == ("Benign", "Likely benign") and got["b"][1] == "Ambiguous" and got["c"][1] == "Likely pathogenic" and got["d"][1] == "Pathogenic"
    assert got["e"] == ("Benign", None) and got["j"][0] == "Pathogenic" and all(got[k] == (None, None) for k in "fghi")


def test_multilabel_needs_a_partner(spark):
    rows = [("a", "A", ["x", "y"], [1.0, 0.0]), ("b", "B", ["x", "y"], [1.0, 0.1]), ("c", "C", ["z"], [0.0, 1.0])]
    got = {(r["id"], r["label"]): r for r in multilabel.multilabel_ap(spark.createDataFrame(rows, "id string, gene string, labels array<string>, features array<double>"), "id", "gene").collect()}
    assert got["a", "x"]["ap"] == 1.0 and got["c", "z"]["ap"] is None


def test_gene_labels_take_the_highest_row(spark):
    rows = [("g", "o", 0.5), ("g", "o", 2.0), ("h", "o", None), (None, "o", 3.0)]
    assert [tuple(r) for r in multilabel.gene_labels(spark.createDataFrame(rows, "gene string, organelle string, score double")).collect()] == [("g", ["o"])]


def test_pairs_need_a_wild_type_with_enough_cells(spark):
    rows = [("g", "g", "disease_wt", "Exp")] * 3 + [("g", "g_v", "allele", "Exp")] * 3 + [("h", "h_v", "allele", "Exp")] * 3 + [("i", "i", "disease_wt", "Exp")] + [("i", "i_v", "allele", "Exp")] * 3
    df = spark.createDataFrame(rows, f"{SYMBOL} string, {ALLELE} string, {NODE} string, {CONTROL} string")
    assert [r["pair_id"] for r in pairs.experimental_pairs(df, 2).collect()] == ["g__g__g_v"]
    assert {r["gene"] for r in pairs.orphan_genes(df).collect()} == {"h"}


def test_channels_by_layout():
    assert select.channels_of("Cells_Texture_DNA_x") == ["Morph", "ALL", "DNA"] and select.channels_of("Cells_Corr_DNA_GFP") == ["GFP", "ALL"]
    assert select.channels_of("ViT_dna_3", "patches") == ["DNA", "Morph", "ALL"] and select.channels_of("Net_global_1", "histogram") == ["combined", "global"]
    assert select.channels_of("cell_count", "counts") == ["count"] and select.channels_of("e1", "encoder") == ["EMBED"]
    assert select.channels_of("Cells_Intensity_MeanIntensity_AGP", "intensity") == ["AGP", "Morph"]


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        select.restrict_channels(select.channel_map(spark, ["a_GFP"]), ["XYZ"])
    with pytest.raises(ValueError):
        labels.predictor_labels(spark.createDataFrame([("a",)], "gene_variant string"), "nobody")
    empty = spark.createDataFrame([], "batch string, representation string, channel string, pair_id string")
    with pytest.raises(ValueError):
        benchmark.load_metrics(empty, spark.createDataFrame([("p", "b")], "pair_name string, batch string"), spark.createDataFrame([("r", "c")], "representation string, channel string"))


def test_audits(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one")
    (tmp_path / "b").write_bytes(b"two")
    found = audit.hashed_files(spark, str(tmp_path)).withColumn("name", F.substring_index("path", "/", -1))
    receipt = found.where("name = 'a'").select("name", F.lit("x").alias("sha"), "size").unionByName(spark.createDataFrame([("c", "y", 1)], "name string, sha string, size long"))
    assert {(r["name"], r["fault"]) for r in audit.content_audit(found, receipt, "name").collect()} == {("a", "content"), ("b", "extra"), ("c", "missing")}


def test_sinks_and_sources_round_trip(spark, tmp_path):
    from plateaux.sources import io

    df = spark.createDataFrame([("r", "b", 1.5)], "representation string, batch string, v double")
    io.write_table(df, f"{tmp_path}/t")
    assert [tuple(r) for r in io.read_table(spark, f"{tmp_path}/t", ["representation", "batch", "v"]).collect()] == [("r", "b", 1.5)]
    assert io.representations_on_disk(spark, f"{tmp_path}/t").count() == 1
    io.write_csv(df, f"{tmp_path}/c", ["v"])
    assert io.read_csv(spark, f"{tmp_path}/c", df.schema).collect() == df.collect()
    io.write_csv(df.limit(0), f"{tmp_path}/e")
    assert io.read_csv(spark, f"{tmp_path}/e", df.schema).schema == df.schema
    pred = spark.createDataFrame([("c", "p", "w", 1, 1, 0.5, "GFP", False)], f"Classifier_ID string, {PLATE} string, {WELL} string, {OBJECT} int, Label int, Prediction double, Feature_Type string, Control boolean")
    for _ in range(2):
        io.write_predictions(pred, f"{tmp_path}/p")
    back = spark.read.parquet(f"{tmp_path}/p")
    assert back.count() == 2 and dict(back.dtypes)["Label"] == "tinyint" and dict(back.dtypes)["Prediction"] == "float"


def test_contract_helpers(spark):
    wide = spark.createDataFrame([("P1T2", "A1", 1, 2, 3, 1.0, 2.0)], f"{PLATE} string, Metadata_Well string, {SITE} int, {IMAGE} int, {OBJECT} int, x double, y double")
    df, names = contract.pack(contract.with_well_column(wide))
    assert names == ["x", "y"] and df.first()["features"] == [1.0, 2.0] and df.first()[WELL] == "A1"
    assert contract.unpack(df, names).first()["y"] == 2.0
    assert df.select(contract.cell_id().alias("i"), contract.template_number().alias("t")).first()[:] == ("P1T2_A1_2_3", 2)
    dupes = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, v int")
    assert sorted(tuple(r) for r in contract.first_per_key(dupes, ["k"]).collect()) == [("a", 1), ("b", 3)]
    assert contract.smoke_sample(dupes, 2, "v").count() == 2 and PLATEMAP


def test_profiles_of_groups_are_medians(spark):
    df = spark.createDataFrame([("a", "x", [1.0, 5.0]), ("a", "y", [3.0, 7.0])], "k string, m string, features array<double>")
    assert similarity.median_profiles(df, ["k"], ["m"]).first()[:] == ("a", [2.0, 6.0], "x")
