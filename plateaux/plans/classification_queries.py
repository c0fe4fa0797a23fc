"""Pairs, folds, metrics, summaries, labels and tests over the cell fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmark, contract, folds, labels, metrics, pairs, select, stats
from ..operators.contract import ALLELE, IMAGE, OBJECT, PLATE, PLATEMAP, WELL
from ..sources import fixtures as fx
from ..sources.scratch import stored
from .preprocess_queries import annotated, r6
from .registry import query

_PAIR = ["pair_id", "gene", "allele_ref", "allele_var", "category"]


def _ref_var_sql(control: str, category: str) -> str:
    return f"""SELECT w.s || '__' || w.a || '__' || v.a AS pair_id, w.s AS gene, w.a AS allele_ref, v.a AS allele_var, '{category}' AS category
  FROM (SELECT s, a FROM annotated WHERE "Metadata_Control" = '{control}' AND "Metadata_node_type" = 'disease_wt' GROUP BY 1, 2 HAVING count(*) >= 50) w
  JOIN (SELECT s, a FROM annotated WHERE "Metadata_Control" = '{control}' AND "Metadata_node_type" = 'allele' GROUP BY 1, 2 HAVING count(*) >= 50) v USING (s)"""


@query(f"WITH {fx.ANNOTATED} {_ref_var_sql('Exp', 'experimental')}")
def exp_pairs(spark, sf_dir):
    return pairs.experimental_pairs(annotated(spark, sf_dir)[0]).select(_PAIR)


@query(f"WITH {fx.ANNOTATED} {_ref_var_sql('cPC', 'cpc')}")
def cpc_pairs(spark, sf_dir):
    return pairs.cpc_pairs(annotated(spark, sf_dir)[0]).select(_PAIR)


_CTRL = """(WITH w AS (SELECT a, s, "Metadata_plate_map_name" AS m, "Metadata_well_position" AS w FROM annotated WHERE "Metadata_Control" IN ('NC', 'PC') GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)
  SELECT 'ctrl__' || x.a || '__' || x.m || '__' || x.w || '__' || y.w AS pair_id, x.s AS gene, x.a AS allele_ref, x.a AS allele_var, 'control' AS category FROM w x JOIN w y ON x.a = y.a AND x.s = y.s AND x.m = y.m AND x.w < y.w)"""


@query(f"WITH {fx.ANNOTATED} SELECT * FROM {_CTRL}")
def control_pairs(spark, sf_dir):
    return pairs.control_pairs(annotated(spark, sf_dir)[0], least=5).select(_PAIR)


@query(f"""WITH {fx.ANNOTATED}, p AS ({_ref_var_sql('Exp', 'experimental')} UNION ALL {_ref_var_sql('cPC', 'cpc')} UNION ALL SELECT * FROM {_CTRL})
  SELECT DISTINCT * FROM p WHERE category = 'cpc' OR gene = 'Brand#10' OR allele_var IN ('Brand#10', 'Brand#7_PROMO')""")
def scope_pairs(spark, sf_dir):
    return pairs.filter_scope(pairs.all_pairs(annotated(spark, sf_dir)[0], least_control=5), "cpc,Brand#10,Brand#7_PROMO").select(_PAIR)


@query(f"""WITH {fx.ANNOTATED} SELECT "Metadata_gene_allele", count(*) AS n_cells FROM annotated WHERE "Metadata_Control" IN ('Exp', 'cPC') AND "Metadata_node_type" = 'allele' GROUP BY 1 HAVING count(*) >= (SELECT count(*) // 150 FROM annotated)""")
def scope_alleles(spark, sf_dir):
    df = annotated(spark, sf_dir)[0]
    return pairs.scope_alleles(df, least=df.count() // 150)


@query(f"""WITH {fx.ANNOTATED} SELECT s AS gene, max(CAST("Metadata_node_type" = 'disease_wt' AS INT)) AS has_wt, max(CAST("Metadata_node_type" = 'allele' AS INT)) AS has_variant FROM annotated GROUP BY 1 HAVING has_wt + has_variant = 1""")
def orphan_genes(spark, sf_dir):
    return pairs.orphan_genes(annotated(spark, sf_dir)[0])


_LABELLED = f"""{fx.ANNOTATED}, p AS ({_ref_var_sql('Exp', 'experimental')}), lab AS (SELECT pair_id, CASE WHEN a = allele_ref THEN 1 ELSE 0 END AS "Label", c.* FROM annotated c JOIN p ON c.a IN (allele_ref, allele_var))"""


def _labelled(spark, sf_dir):
    df, _ = annotated(spark, sf_dir)
    return pairs.labelled_cells(df.select(ALLELE, PLATE, PLATEMAP, WELL, IMAGE, OBJECT), pairs.experimental_pairs(df))


@query(f"""WITH {_LABELLED} SELECT pair_id, "Label", "Metadata_Plate", count(*) AS n_cells FROM lab GROUP BY 1, 2, 3""")
def labelled_cells(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("pair_id", "Label", PLATE).agg(F.count("*").alias("n_cells"))


_LOPO = """plates AS (SELECT DISTINCT pair_id, "Metadata_plate_map_name" AS m, "Metadata_Plate" AS p FROM lab), sets AS (SELECT *, count(*) OVER (PARTITION BY pair_id, m) AS n FROM plates),
  lopo AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY m, p) - 1 AS fold_id, m, p FROM sets WHERE n >= 2)"""


@query(f"""WITH {_LABELLED}, {_LOPO} SELECT f.pair_id, CAST(fold_id AS INTEGER) AS fold_id, p AS test_plate,
  (SELECT string_agg(DISTINCT "Metadata_well_position", ',' ORDER BY "Metadata_well_position") FROM lab WHERE lab.pair_id = f.pair_id AND lab."Metadata_Plate" = f.p) AS test_wells,
  (SELECT string_agg(q.p, ',' ORDER BY q.p) FROM plates q WHERE q.pair_id = f.pair_id AND q.m = f.m AND q.p <> f.p) AS train_plates FROM lopo f""")
def lopo_folds(spark, sf_dir):
    f = folds.plate_folds(_labelled(spark, sf_dir))
    return f.select("pair_id", "fold_id", F.col("test_plates")[0].alias("test_plate"), F.array_join("test_wells", ",").alias("test_wells"), F.array_join("train_plates", ",").alias("train_plates"))


@query(f"""WITH {_LABELLED}, w AS (SELECT pair_id, "Label", "Metadata_well_position" AS w, row_number() OVER (PARTITION BY pair_id, "Label" ORDER BY "Metadata_well_position") AS k FROM (SELECT DISTINCT pair_id, "Label", "Metadata_well_position" FROM lab)),
  b AS (SELECT r.pair_id, r.k, r.w AS rw, v.w AS vw FROM w r JOIN w v ON r.pair_id = v.pair_id AND r.k = v.k AND r."Label" = 1 AND v."Label" = 0)
  SELECT x.pair_id, CAST(row_number() OVER (PARTITION BY x.pair_id ORDER BY x.k, y.k) - 1 AS INTEGER) AS fold_id, array_to_string(list_sort(list_distinct([x.rw, x.vw, y.rw, y.vw])), ',') AS test_wells FROM b x JOIN b y ON x.pair_id = y.pair_id AND x.k < y.k""")
def wellpair_folds(spark, sf_dir):
    return folds.well_pair_folds(_labelled(spark, sf_dir)).select("pair_id", "fold_id", F.array_join("test_wells", ",").alias("test_wells"))


@query(f"""WITH {_LABELLED}, {_LOPO}, s AS (SELECT f.pair_id, f.fold_id, l."Label", CASE WHEN l."Metadata_Plate" = f.p THEN 'test' ELSE 'train' END AS role FROM lopo f JOIN lab l ON l.pair_id = f.pair_id AND l."Metadata_plate_map_name" = f.m),
  t AS (SELECT pair_id, CAST(fold_id AS INTEGER) AS fold_id, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'train' AND "Label" = 1) AS r, count(*) FILTER (role = 'train' AND "Label" = 0) AS v FROM s GROUP BY 1, 2)
  SELECT pair_id, fold_id, c.channel, n_train, n_test, r AS n_train_ref, v AS n_train_var, round(greatest(r, v) / least(r, v), 6) AS imbalance_ratio FROM t CROSS JOIN (VALUES ('GFP'), ('Morph'), ('ALL'), ('DNA'), ('AGP'), ('Mito')) c(channel) WHERE n_train >= 300 AND n_test >= 10""")
def task_list(spark, sf_dir):
    cells = _labelled(spark, sf_dir)
    sizes = folds.list_sizes(folds.fold_lists(cells, folds.plate_folds(cells)), 300, 10)
    channels = select.channel_map(spark, fx.FEATURES).select("channel").distinct()
    return sizes.crossJoin(channels).withColumn("imbalance_ratio", F.round("imbalance_ratio", 6))  # channels are a few names


# ---------------------------------------------------------------- metrics over the prediction fixture

_IDS = ["classifier_id", "gene", "allele_var", "channel", "test_plate", "batch"]
_MID = "classifier_id, gene, allele_var, channel, test_plate, batch"
METRICS = f"""{fx.PREDICTIONS}, c AS (SELECT {_MID}, prediction, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY ALL),
  mk AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY classifier_id ORDER BY prediction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER d AS tp, sum(pos + neg) OVER d AS seen FROM c WINDOW d AS (PARTITION BY classifier_id ORDER BY prediction DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  m0 AS (SELECT {_MID}, sum(pos) AS n_pos, sum(neg) AS n_neg, sum(pos * (below + neg / 2)) AS u, sum(pos * tp / seen) AS ap, sum(pos) FILTER (prediction >= 0.5) AS tp, sum(neg) FILTER (prediction >= 0.5) AS fp FROM mk GROUP BY ALL),
  m1 AS (SELECT * REPLACE (coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp), n_pos > 0 AND n_neg > 0 AS two FROM m0),
  metrics AS (SELECT {_MID}, n_pos, n_neg, CASE WHEN two THEN u / (n_pos * n_neg) END AS auroc, CASE WHEN two THEN ap / n_pos END AS auprc,
    CASE WHEN two THEN (coalesce(2 * tp / nullif(2 * tp + fp + n_pos - tp, 0), 0) + coalesce(2 * (n_neg - fp) / nullif(2 * (n_neg - fp) + fp + n_pos - tp, 0), 0)) / 2 END AS macro_f1,
    CASE WHEN two THEN tp / n_pos END AS sensitivity, CASE WHEN two THEN (n_neg - fp) / n_neg END AS specificity, CASE WHEN two THEN (tp / n_pos + (n_neg - fp) / n_neg) / 2 END AS balanced_accuracy,
    gene || '__' || allele_var AS pair_id, gene IN ('Brand#1', 'Brand#2') AS is_control, greatest(n_pos, n_neg) / nullif(least(n_pos, n_neg), 0) AS imbalance_ratio FROM m1)"""
THRESHOLD = """thr AS (SELECT channel, auroc AS null_threshold FROM (SELECT channel, auroc, row_number() OVER (PARTITION BY channel ORDER BY auroc) AS k, count(*) OVER (PARTITION BY channel) AS n FROM metrics WHERE is_control AND auroc IS NOT NULL) WHERE k = round_even((n - 1) * 0.95, 0) + 1)"""
SUMMARY = """means AS (SELECT pair_id, gene, allele_var, channel, avg(auroc) AS auroc_mean, stddev_samp(auroc) AS auroc_std, avg(auprc) AS auprc_mean, avg(balanced_accuracy) AS balanced_accuracy_mean, count(*) AS n_classifiers FROM metrics WHERE imbalance_ratio <= 3 AND NOT is_control GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
  summary AS (SELECT m.*, coalesce(null_threshold, 0.5) AS null_threshold, auroc_mean > coalesce(null_threshold, 0.5) AS is_hit FROM means m LEFT JOIN thr USING (channel))"""


def scored(spark, sf_dir):
    """A row for each classifier, written once: queries read it up to four times, and none ranks the predictions again."""
    pred, classifiers = fx.numbered_predictions(spark, sf_dir)
    m = stored(metrics.numbered_metrics(pred, "number").join(classifiers, "number").select(*_IDS, *metrics.MEASURES), "metrics")
    ratio = F.try_divide(F.greatest("n_pos", "n_neg"), F.least("n_pos", "n_neg"))
    return m.withColumns({"pair_id": F.concat_ws("__", "gene", "allele_var"), "is_control": F.col("gene").isin("Brand#1", "Brand#2"), "imbalance_ratio": ratio})


def thresholds(m):
    return metrics.null_threshold(m.where("is_control"), ["channel"])


_M = ["auroc", "auprc", "macro_f1", "sensitivity", "specificity", "balanced_accuracy"]


@query(f"WITH {METRICS} SELECT classifier_id, n_pos, n_neg, {', '.join(f'round({c}, 6) AS {c}' for c in _M)}, round(imbalance_ratio, 6) AS imbalance_ratio FROM metrics")
def classifier_metrics(spark, sf_dir):
    return scored(spark, sf_dir).select("classifier_id", "n_pos", "n_neg", *map(r6, _M), r6("imbalance_ratio"))


@query(f"WITH {METRICS}, {THRESHOLD} SELECT channel, round(null_threshold, 6) AS nearest, (SELECT round(quantile_cont(auroc, 0.95), 6) FROM metrics m WHERE m.channel = thr.channel AND is_control) AS linear FROM thr")
def null_threshold(spark, sf_dir):
    control = scored(spark, sf_dir).where("is_control")
    linear = metrics.null_threshold(control, ["channel"], interpolation="linear").select("channel", F.round("null_threshold", 6).alias("linear"))
    return thresholds(control).select("channel", F.round("null_threshold", 6).alias("nearest")).join(linear, "channel")


_S = ["auroc_mean", "auroc_std", "auprc_mean", "balanced_accuracy_mean"]
_S_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in [*_S, "null_threshold"])


def summary_of(m):
    return metrics.allele_summary(m, thresholds(m))


@query(f"WITH {METRICS}, {THRESHOLD}, {SUMMARY} SELECT pair_id, gene, allele_var, channel, {_S_SQL}, n_classifiers, is_hit FROM summary")
def allele_summary(spark, sf_dir):
    return summary_of(scored(spark, sf_dir)).select("pair_id", "gene", "allele_var", "channel", *map(r6, [*_S, "null_threshold"]), "n_classifiers", "is_hit")


_CH = ["AGP", "DNA", "GFP", "Mito"]
_WIDE = ", ".join([f"round(min(auroc_mean) FILTER (channel = '{c}'), 6) AS \"AUROC_{c}\"" for c in _CH] + [f"min(is_hit) FILTER (channel = '{c}') AS \"Altered_p95_{c}\"" for c in _CH] + [f"round(min(null_threshold) FILTER (channel = '{c}'), 6) AS \"Null_p95_{c}\"" for c in _CH])


@query(f"WITH {METRICS}, {THRESHOLD}, {SUMMARY} SELECT gene, allele_var, 'B1' AS \"Batch\", {_WIDE} FROM summary GROUP BY 1, 2")
def wide_summary(spark, sf_dir):
    wide = metrics.wide_summary(summary_of(scored(spark, sf_dir)), _CH, "B1")
    return wide.select([F.round(c, 6).alias(c) if c[:4] in ("AURO", "Null") else c for c in wide.columns])


@query(f"WITH {METRICS} SELECT pair_id, gene, allele_var, channel, round(auroc, 6) AS auroc_mean, round(auprc, 6) AS auprc_mean, round(balanced_accuracy, 6) AS balanced_accuracy_mean, CAST(1 AS BIGINT) AS n_classifiers, CAST(0.5 AS DOUBLE) AS null_threshold, false AS is_hit FROM metrics WHERE test_plate LIKE '%T4' AND imbalance_ratio <= 3 AND NOT is_control")
def single_fold_metrics(spark, sf_dir):
    m = scored(spark, sf_dir)
    return metrics.single_fold_metrics(m, m.select("classifier_id", "test_plate")).drop("auroc_std").withColumns({c: F.round(c, 6) for c in ("auroc_mean", "auprc_mean", "balanced_accuracy_mean")})


BATCHED = """batched AS (SELECT gene, allele_var, channel, batch, 'profiler' AS representation, pair_id, avg(auroc) AS auroc_mean, avg(auprc) AS auprc_mean, avg(balanced_accuracy) AS balanced_accuracy_mean FROM metrics WHERE imbalance_ratio <= 3 GROUP BY 1, 2, 3, 4, 5, 6)"""


def batched(spark, sf_dir):
    m = scored(spark, sf_dir).where("imbalance_ratio <= 3")
    return m.groupBy("gene", "allele_var", "channel", "batch", F.lit("profiler").alias("representation"), "pair_id").agg(*[F.avg(c.removesuffix("_mean")).alias(c) for c in benchmark.METRIC_COLUMNS])


@query(f"WITH {METRICS}, {BATCHED} SELECT 'pair1' AS pair_name, batch, representation, channel, gene, allele_var, round(auroc_mean, 6) AS auroc_mean FROM batched WHERE channel IN ('GFP', 'DNA')")
def load_metrics(spark, sf_dir):
    wanted = spark.createDataFrame([("pair1", "P1"), ("pair1", "P2"), ("pair2", "P9")], "pair_name string, batch string")
    channels = spark.createDataFrame([("profiler", "GFP"), ("profiler", "DNA")], "representation string, channel string")
    return benchmark.load_metrics(batched(spark, sf_dir), wanted, channels).select("pair_name", "batch", "representation", "channel", "gene", "allele_var", r6("auroc_mean"))


AVERAGED = """averaged AS (SELECT gene, allele_var, channel, avg(auroc_mean) AS auroc_mean, avg(auprc_mean) AS auprc_mean, count(DISTINCT batch) AS n_batches FROM batched GROUP BY 1, 2, 3 HAVING count(DISTINCT batch) = 2)"""


def averaged(spark, sf_dir):
    return benchmark.average_replicates(batched(spark, sf_dir), ["gene", "allele_var", "channel"], ["auroc_mean", "auprc_mean"])


@query(f"WITH {METRICS}, {BATCHED}, {AVERAGED} SELECT gene, allele_var, channel, round(auroc_mean, 6) AS auroc_mean, round(auprc_mean, 6) AS auprc_mean, n_batches FROM averaged")
def biorep_average(spark, sf_dir):
    return averaged(spark, sf_dir).select("gene", "allele_var", "channel", r6("auroc_mean"), r6("auprc_mean"), "n_batches")


_CLINVAR = f"""{METRICS}, {BATCHED}, {AVERAGED}, {fx.VARIANT_LABELS}, labelled AS (SELECT a.*, clinvar_clnsig_clean AS clinvar_label, clinvar_clnsig_clean_pp_strict AS clinvar_label_strict FROM averaged a JOIN variant_labels v ON v.gene_variant = a.allele_var)"""


def clinvar(spark, sf_dir):
    return benchmark.join_labels(averaged(spark, sf_dir), labels.predictor_labels(fx.variant_labels(spark, sf_dir), "clinvar"), "clinvar_label")


@query(f"WITH {_CLINVAR} SELECT gene, allele_var, channel, round(auroc_mean, 6) AS auroc_mean, clinvar_label, clinvar_label_strict FROM labelled")
def label_join(spark, sf_dir):
    return clinvar(spark, sf_dir).select("gene", "allele_var", "channel", r6("auroc_mean"), "clinvar_label", "clinvar_label_strict")


@query(f"WITH {_CLINVAR} SELECT clinvar_label, channel, count(*) AS n, round(avg(auroc_mean), 6) AS mean FROM labelled WHERE gene NOT IN ('Brand#7', 'Brand#8') GROUP BY 1, 2")
def exclude_genes(spark, sf_dir):
    kept = benchmark.exclude_genes(clinvar(spark, sf_dir), ["Brand#7", "Brand#8"])
    return benchmark.category_means(kept, "clinvar_label", ["channel"], "auroc_mean").select("clinvar_label", "channel", "n", r6("mean"))


def _predictor(name: str, sql: str):
    def run(spark, sf_dir):
        return labels.predictor_labels(fx.variant_labels(spark, sf_dir), name)

    run.__name__ = f"predictor_labels_{name}"
    query(f"WITH {fx.VARIANT_LABELS} SELECT gene_variant, {sql} FROM variant_labels")(run)


_FIVE = "CASE \"AlphaMissense_pred\" WHEN 'P' THEN 'Pathogenic' WHEN 'LP' THEN '{lp}' WHEN 'B' THEN 'Benign' WHEN 'LB' THEN '{lb}' WHEN 'A' THEN 'Ambiguous' END"
_predictor("clinvar", "clinvar_clnsig_clean AS clinvar_label, clinvar_clnsig_clean_pp_strict AS clinvar_label_strict")
_predictor("alphamissense", _FIVE.format(lp="Pathogenic", lb="Benign") + " AS alphamissense_label, " + _FIVE.format(lp="Likely pathogenic", lb="Likely benign") + " AS alphamissense_label_strict")
_predictor("esm1b", "CASE \"ESM1b_pred\" WHEN 'D' THEN 'Pathogenic' WHEN 'T' THEN 'Benign' END AS esm1b_label")
_R, _MP = 'TRY_CAST("REVEL_score" AS DOUBLE)', 'TRY_CAST("MutPred_score" AS DOUBLE)'
_predictor("revel", f"CASE WHEN {_R} >= 0.5 THEN 'Pathogenic' WHEN {_R} < 0.5 THEN 'Benign' END AS revel_label, CASE WHEN {_R} >= 0.773 THEN 'Pathogenic' WHEN {_R} >= 0.644 THEN 'Likely pathogenic' WHEN {_R} >= 0.290 THEN 'Ambiguous' WHEN {_R} >= 0.183 THEN 'Likely benign' WHEN {_R} >= 0 THEN 'Benign' END AS revel_label_strict")
_predictor("mutpred", f"CASE WHEN {_MP} >= 0.5 THEN 'Pathogenic' WHEN {_MP} < 0.5 THEN 'Benign' END AS mutpred_label, CASE WHEN {_MP} >= 0.75 THEN 'Pathogenic' WHEN {_MP} >= 0.5 THEN 'Likely pathogenic' WHEN {_MP} >= 0.25 THEN 'Likely benign' WHEN {_MP} >= 0 THEN 'Benign' END AS mutpred_label_strict")


# ---------------------------------------------------------------- tests and summary tables

_ARMS = """arms AS (SELECT channel, gene, allele_var, auroc_mean AS v, CASE clinvar_label WHEN 'Pathogenic' THEN 'a' WHEN 'Benign' THEN 'b' END AS g FROM labelled WHERE clinvar_label IN ('Pathogenic', 'Benign')),
  k AS (SELECT *, rank() OVER (PARTITION BY channel ORDER BY v) + (count(*) OVER (PARTITION BY channel, v) - 1) / 2 AS r FROM arms),
  t AS (SELECT channel, sum(n * n * n - n) AS ties FROM (SELECT channel, v, count(*) AS n FROM arms GROUP BY 1, 2) GROUP BY 1),
  mwu AS (SELECT channel, count(*) FILTER (g = 'a') AS n_a, count(*) FILTER (g = 'b') AS n_b, sum(r) FILTER (g = 'a') - n_a * (n_a + 1) / 2 AS u, avg(v) FILTER (g = 'a') AS mean_a, avg(v) FILTER (g = 'b') AS mean_b, median(v) FILTER (g = 'a') AS median_a, median(v) FILTER (g = 'b') AS median_b, ties
          FROM k JOIN t USING (channel) GROUP BY channel, ties),
  z AS (SELECT *, (u - n_a * n_b / 2) / sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1)))) AS z FROM mwu)"""


def _group():
    return F.when(F.col("clinvar_label") == "Pathogenic", "a").when(F.col("clinvar_label") == "Benign", "b")


_T = ["u", "mean_a", "mean_b", "median_a", "median_b", "z"]


@query(f"WITH {_CLINVAR}, {_ARMS} SELECT channel, n_a, n_b, {', '.join(f'round({c}, 6) AS {c}' for c in _T)} FROM z")
def mwu_tests(spark, sf_dir):
    return stats.rank_sum_tests(clinvar(spark, sf_dir), ["channel"], "auroc_mean", _group()).select("channel", "n_a", "n_b", *map(r6, _T))


@query(f"""WITH {METRICS}, p AS (SELECT channel, classifier_id, least(1, abs(auroc - 0.5) * 2) AS p FROM metrics WHERE auroc IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY p, classifier_id) AS r, count(*) OVER (PARTITION BY channel) AS n FROM p)
  SELECT channel, classifier_id, round(least(1, min(p * n / r) OVER (PARTITION BY channel ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS corrected FROM k""")
def bh_adjust(spark, sf_dir):
    p = scored(spark, sf_dir).where("auroc is not null").select("channel", "classifier_id", F.least(F.lit(1.0), F.abs(F.col("auroc") - 0.5) * 2).alias("p"))
    return stats.benjamini_hochberg(p, "p", ["channel"], ["classifier_id"], "corrected").select("channel", "classifier_id", r6("corrected"))


@query(f"WITH {_CLINVAR}, {_ARMS} SELECT channel, round(median_a - median_b, 6) AS median_effect, round(mean_a - mean_b, 6) AS mean_effect FROM z")
def effect_table(spark, sf_dir):
    tests = benchmark.predictor_tests(clinvar(spark, sf_dir), ["channel"], "auroc_mean", labels.comparisons(spark, "clinvar")).where("comparison = 'Pathogenic_vs_Benign'")
    both = stats.effect_table(tests).select("channel", F.round("effect", 6).alias("median_effect"))
    return both.join(stats.effect_table(tests, "mean").select("channel", F.round("effect", 6).alias("mean_effect")), "channel")


@query(f"WITH {_CLINVAR} SELECT x.clinvar_label, count(*) AS n, CASE WHEN count(*) > 2 THEN round(corr(x.auroc_mean, y.auroc_mean), 6) END AS r FROM labelled x JOIN labelled y USING (allele_var) WHERE x.channel = 'GFP' AND y.channel = 'DNA' GROUP BY 1")
def score_correlation(spark, sf_dir):
    return stats.score_correlation(clinvar(spark, sf_dir), F.col("channel") == "GFP", F.col("channel") == "DNA", "allele_var", "auroc_mean", ["clinvar_label"]).withColumn("r", F.round("r", 6))


@query(f"""WITH {METRICS}, b AS (SELECT channel, is_control, CAST(least(floor(auroc / (1.0 / 39)), 38) AS INTEGER) AS bin FROM metrics WHERE auroc BETWEEN 0 AND 1)
  SELECT channel, is_control, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY channel, is_control) * (1.0 / 39)), 6) AS density FROM b GROUP BY 1, 2, 3""")
def score_histogram(spark, sf_dir):
    return stats.histogram(scored(spark, sf_dir), "auroc", ["channel", "is_control"]).withColumn("density", F.round("density", 6))


@query(f"""WITH {_CLINVAR}, {fx.LABEL_SCORES}, gl AS (SELECT 'Brand#' || (CAST(substr(gene, 2) AS INTEGER) + 4) AS gene, organelle FROM label_scores WHERE coalesce(score, 0) >= 1),
  r AS (SELECT l.channel, organelle, l.gene, auroc_mean, clinvar_label AS g FROM labelled l JOIN gl USING (gene) WHERE clinvar_label IN ('Pathogenic', 'Benign'))
  SELECT channel, organelle, count(*) FILTER (g = 'Pathogenic') AS n_a, count(*) FILTER (g = 'Benign') AS n_b, count(DISTINCT gene) AS n_genes, round(avg(auroc_mean) FILTER (g = 'Pathogenic') - avg(auroc_mean) FILTER (g = 'Benign'), 6) AS mean_diff
  FROM r GROUP BY 1, 2 HAVING n_a >= 3 AND n_b >= 3 AND n_genes >= 3""")
def organelle_diff(spark, sf_dir):
    scores = fx.label_scores(spark, sf_dir).where("coalesce(score, 0) >= 1")
    genes = scores.select(F.concat(F.lit("Brand#"), (F.substring("gene", 2, 9).cast("int") + 4).cast("string")).alias("gene"), "organelle")
    d = benchmark.organelle_differences(clinvar(spark, sf_dir), genes, F.col("clinvar_label"), ["channel"], "auroc_mean")
    return d.select("channel", "organelle", "n_a", "n_b", "n_genes", r6("mean_diff"))


@query(f"""WITH {METRICS}, i AS (SELECT DISTINCT allele_var AS classifier, test_plate || '_' || channel AS feature, coalesce(auroc, 0) AS importance FROM metrics)
  SELECT classifier, feature, round(importance, 6) AS importance, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY classifier ORDER BY importance DESC, feature) AS k FROM i) WHERE k <= 5""")
def top_importances(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.col("allele_var").alias("classifier"), F.concat_ws("_", "test_plate", "channel").alias("feature"), F.coalesce("auroc", F.lit(0.0)).alias("importance"))
    return metrics.top_importances(rows, ["classifier"], 5).select("classifier", "feature", r6("importance"), "rank")


@query(f"WITH {METRICS}, {BATCHED} SELECT DISTINCT representation || '_' || channel AS representation FROM batched")
def rep_catalog(spark, sf_dir):
    return benchmark.representations(batched(spark, sf_dir).select(F.concat_ws("_", "representation", "channel").alias("representation")))


@query(f"WITH {METRICS}, {BATCHED} SELECT batch, channel, count(*) AS n, round(avg(auroc_mean), 6) AS mean FROM batched GROUP BY 1, 2")
def summaries_union(spark, sf_dir):
    rows = batched(spark, sf_dir)
    both = contract.union_all([rows.where(F.col("batch") == b).drop(*drop) for b, drop in (("P1", []), ("P2", ["auprc_mean"]))], diagonal=True)
    return both.groupBy("batch", "channel").agg(F.count("*").alias("n"), F.round(F.avg("auroc_mean"), 6).alias("mean"))


