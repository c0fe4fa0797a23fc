"""Retrieval, consistency, learner, audit and loader queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import dot, norm
from ..operators import audit, benchmark, contract, metrics, multilabel, similarity, stats
from ..operators.contract import ALLELE, IMAGE, OBJECT, PLATE, PLATEMAP
from ..sources import fixtures as fx
from .preprocess_queries import annotated, r6
from .registry import query

_ROWS = "vec_id, plate, platemap, well, symbol, gene_allele, node_type, control"


def ranked_sql(pairs: str, keys: str) -> str:
    """(keys, n_pos, n_total, ap) of a pair table (keys, partner, sim, positive)."""
    return f"""(SELECT {keys}, CAST(sum(positive) AS BIGINT) AS n_pos, count(*) AS n_total, sum(positive * tp / k) / nullif(sum(positive), 0) AS ap FROM (
      SELECT *, row_number() OVER w AS k, sum(positive) OVER (PARTITION BY {keys} ORDER BY sim DESC NULLS LAST, partner ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp FROM {pairs} WINDOW w AS (PARTITION BY {keys} ORDER BY sim DESC NULLS LAST, partner)) GROUP BY {keys})"""


def norm_sql(ap: str) -> str:
    """ap_norm beside the columns of an AP table."""
    h = "list_sum([1.0 / i FOR i IN range(1, n_total + 1)])"
    e = f"CASE WHEN n_total = n_pos THEN 1.0 ELSE ({h} + (n_pos - 1) / (n_total - 1) * (n_total - {h})) / n_total END"
    return f"(SELECT * EXCLUDE (e), CASE WHEN ap IS NULL THEN NULL WHEN e >= 1 THEN 0 ELSE (ap - e) / (1 - e) END AS ap_norm FROM (SELECT *, {e} AS e FROM {ap}))"


def _vs_ref_sql(pool: str, run: str = "") -> str:
    """Pairs of variant rows of a pool: the same allele elsewhere, the gene's other node types on the plate."""
    same = f" AND a.{run} = b.{run}" if run else ""
    own = f", a.{run}" if run else ""
    return f"""(SELECT a.vec_id, a.gene_allele{own}, b.vec_id AS partner, list_cosine_similarity(a.features, b.features) AS sim, CASE WHEN a.gene_allele = b.gene_allele AND a.plate <> b.plate THEN 1 ELSE 0 END AS positive
      FROM {pool} a JOIN {pool} b ON a.vec_id <> b.vec_id{same} AND (a.gene_allele = b.gene_allele AND a.plate <> b.plate OR a.plate = b.plate AND a.symbol = b.symbol AND a.node_type <> b.node_type) WHERE a.node_type = 'allele')"""


_POOL = f"""{fx.EMB}, pool AS (SELECT * FROM emb WHERE control <> 'NC')"""


def _pool(spark, sf_dir):
    return similarity.without_orphans(fx.emb_cells(spark, sf_dir).where("control <> 'NC'"))


@query(f"WITH {_POOL} SELECT vec_id, gene_allele, n_pos, n_total, round(ap, 6) AS ap, round(ap_norm, 6) AS ap_norm FROM {norm_sql(ranked_sql(_vs_ref_sql('pool'), 'vec_id, gene_allele'))}")
def ap_vs_ref(spark, sf_dir):
    return similarity.normalized(similarity.activity_ap(_pool(spark, sf_dir), "vec_id")).select("vec_id", "gene_allele", "n_pos", "n_total", r6("ap"), r6("ap_norm"))


@query(f"""WITH {_POOL}, s AS (SELECT * EXCLUDE (features), c.channel, c.lo, features[c.lo + 1 : c.lo + 16] AS features FROM pool CROSS JOIN (VALUES ('GFP', 0), ('DNA', 16), ('AGP', 32), ('Mito', 48)) c(channel, lo))
  SELECT channel, gene_allele, round(avg(ap), 6) AS mAP, round(avg(ap_norm), 6) AS mAP_norm, count(*) AS n_queries FROM {norm_sql(ranked_sql(_vs_ref_sql('s', 'channel'), 'vec_id, gene_allele, channel'))} WHERE ap IS NOT NULL GROUP BY 1, 2""")
def map_vs_ref(spark, sf_dir):
    return activity(spark, sf_dir).select("channel", "gene_allele", r6("mAP"), r6("mAP_norm"), "n_queries")


def activity(spark, sf_dir):
    pool = similarity.slices(_pool(spark, sf_dir), fx.CHANNELS)
    return similarity.mean_average_precision(similarity.activity_ap(pool, "vec_id", ["channel"]), ["channel", "gene_allele"], scope=["channel"])


@query(f"WITH {_POOL} SELECT vec_id, gene_allele, n_pos, n_total, round(ap, 6) AS ap FROM {ranked_sql(_vs_ref_sql('pool'), 'vec_id, gene_allele')} WHERE vec_id % 4 = 3")
def ap_t4(spark, sf_dir):
    return similarity.activity_ap(_pool(spark, sf_dir), "vec_id", held_out="T4").select("vec_id", "gene_allele", "n_pos", "n_total", r6("ap"))


def map_p_values(spark, sf_dir):
    """Permutation p-values of the activity, corrected by channel."""
    return activity(spark, sf_dir)


query()(map_p_values)

_GROUPS = """grp AS (SELECT gene_allele, platemap, well, count(*) AS n_cells FROM emb WHERE control IN ('NC', 'PC') GROUP BY 1, 2, 3), loo AS (SELECT *, count(*) OVER (PARTITION BY gene_allele, platemap) AS n_wells FROM grp QUALIFY n_wells >= 3)"""
LOO = f"""{fx.EMB}, {_GROUPS}, lp AS (SELECT e.vec_id, e.plate, e.well, e.site, g.gene_allele || '__' || g.platemap || '__' || g.well AS loo_id, loo_id AS symbol, CASE WHEN e.well = g.well THEN loo_id ELSE e.gene_allele END AS gene_allele,
  CASE WHEN e.well = g.well THEN 'allele' ELSE 'disease_wt' END AS node_type, e.features FROM emb e JOIN loo g ON e.gene_allele = g.gene_allele AND e.platemap = g.platemap AND e.control = 'NC')"""


@query(f"WITH {fx.EMB}, {_GROUPS} SELECT gene_allele, platemap, well, n_cells, n_wells FROM loo")
def loo_groups(spark, sf_dir):
    return similarity.loo_groups(fx.emb_cells(spark, sf_dir), 1).select("gene_allele", "platemap", "well", "n_cells", "n_wells")


def _loo(spark, sf_dir):
    e = fx.emb_cells(spark, sf_dir)
    return similarity.loo_pool(e.where("control = 'NC'"), similarity.loo_groups(e, 1))


@query(f"WITH {LOO} SELECT loo_id, node_type, count(*) AS n FROM lp GROUP BY 1, 2")
def loo_pool_counts(spark, sf_dir):
    return _loo(spark, sf_dir).groupBy("loo_id", "node_type").agg(F.count("*").alias("n"))


_NULL = f"{norm_sql(ranked_sql(_vs_ref_sql('lp', 'loo_id'), 'vec_id, gene_allele, loo_id'))}"


@query(f"WITH {LOO} SELECT loo_id, round(avg(ap), 6) AS mAP, round(avg(ap_norm), 6) AS mAP_norm, count(*) AS n_queries FROM {_NULL} WHERE ap IS NOT NULL GROUP BY 1")
def control_null_map(spark, sf_dir):
    return control_null(spark, sf_dir).select("loo_id", r6("mAP"), r6("mAP_norm"), "n_queries")


def control_null(spark, sf_dir):
    return similarity.mean_average_precision(similarity.activity_ap(_loo(spark, sf_dir), "vec_id", ["loo_id"]), ["loo_id"], 1_000)


@query(f"""WITH {LOO}, pool AS (SELECT * FROM emb WHERE control <> 'NC'), nul AS (SELECT loo_id, avg(ap_norm) AS m FROM {_NULL} WHERE ap IS NOT NULL GROUP BY 1), t AS (SELECT quantile_cont(m, 0.95) AS q FROM nul),
  act AS (SELECT gene_allele, avg(ap_norm) AS m FROM {norm_sql(ranked_sql(_vs_ref_sql('pool'), 'vec_id, gene_allele'))} WHERE ap IS NOT NULL GROUP BY 1)
  SELECT gene_allele, round(m, 6) AS mAP_norm, round(q, 6) AS null_threshold_p95, m > q AS is_hit FROM act CROSS JOIN t""")
def pa_hits(spark, sf_dir):
    found = similarity.mean_average_precision(similarity.activity_ap(_pool(spark, sf_dir), "vec_id"), ["gene_allele"]).withColumn("channel", F.lit("ALL"))
    limit = similarity.null_thresholds(control_null(spark, sf_dir).withColumn("channel", F.lit("ALL")), ["channel"])
    return similarity.hits(found, limit, ["channel"]).select("gene_allele", r6("mAP_norm"), r6("null_threshold_p95"), "is_hit")


@query(f"""WITH {LOO}, pool AS (SELECT * FROM emb WHERE control <> 'NC') SELECT split_part(gene_allele, '_', 1) AS gene, gene_allele AS allele_var, 'ALL_vs_ref' AS channel, round(avg(ap_norm), 6) AS auroc_mean, 'B1' AS batch
  FROM {norm_sql(ranked_sql(_vs_ref_sql('pool'), 'vec_id, gene_allele'))} WHERE ap IS NOT NULL GROUP BY 2""")
def pa_long(spark, sf_dir):
    m = similarity.mean_average_precision(similarity.activity_ap(_pool(spark, sf_dir), "vec_id"), ["gene_allele"])
    shaped = m.select(F.col("gene_allele").alias("Metadata_gene_allele"), F.lit("ALL").alias("channel"), F.col("mAP_norm").alias("mAP_vs_ref_norm"), F.lit("B1").alias("batch"), F.lit("emb").alias("representation"))
    return benchmark.activity_as_metrics(shaped).select("gene", "allele_var", "channel", r6("auroc_mean"), "batch")


@query(f"""WITH {fx.EMB} SELECT vec_id, gene_allele, plate FROM emb QUALIFY row_number() OVER (PARTITION BY gene_allele, plate ORDER BY md5('42:' || vec_id), vec_id) <= 2""")
def sample_per_group(spark, sf_dir):
    return similarity.sample_per_group(fx.emb_cells(spark, sf_dir), ["gene_allele", "plate"], 2, "vec_id").select("vec_id", "gene_allele", "plate")


@query(f"""WITH {fx.EMB}, r AS (SELECT *, CASE WHEN node_type = 'disease_wt' THEN row_number() OVER (PARTITION BY node_type = 'disease_wt' ORDER BY vec_id) - 1 ELSE -1 END AS reference_index FROM emb) SELECT vec_id, reference_index FROM r""")
def reference_index(spark, sf_dir):
    return similarity.reference_index(fx.emb_cells(spark, sf_dir), F.col("node_type") == "disease_wt", ["vec_id"]).select("vec_id", "reference_index")


# ---------------------------------------------------------------- labels shared by genes

LABELS = f"""{fx.LABEL_SCORES}, best AS (SELECT gene, organelle FROM label_scores WHERE gene IS NOT NULL GROUP BY 1, 2 HAVING max(coalesce(score, 0)) >= 1), gl AS (SELECT gene, list(organelle ORDER BY organelle) AS labels FROM best GROUP BY 1)"""


@query(f"WITH {LABELS} SELECT gene, array_to_string(labels, ',') AS labels FROM gl")
def org_labels(spark, sf_dir):
    return multilabel.gene_labels(fx.label_scores(spark, sf_dir)).select("gene", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {LABELS} SELECT organelle, count(*) AS n_genes FROM best GROUP BY 1")
def org_counts(spark, sf_dir):
    wide = fx.label_scores(spark, sf_dir).groupBy("gene").pivot("organelle", [f"{o}_GO_Sub_Major" for o in fx.ORGANELLES]).agg(F.first("score"))
    return multilabel.label_counts(multilabel.gene_labels(multilabel.wide_to_long(wide)))


_CONS = f"""{fx.EMB}, {LABELS}, u AS (SELECT symbol, plate, i, median(features[i]) AS m FROM emb, range(1, 65) t(i) GROUP BY 1, 2, 3), cons AS (SELECT symbol || '@' || plate AS pid, symbol, plate, list(m ORDER BY i) AS features FROM u GROUP BY 2, 3),
  c AS (SELECT cons.*, labels FROM cons JOIN gl ON symbol = gene),
  mp AS (SELECT a.pid, a.symbol, l.label, b.pid AS partner, list_cosine_similarity(a.features, b.features) AS sim, CASE WHEN list_contains(b.labels, l.label) AND a.plate <> b.plate THEN 1 ELSE 0 END AS positive
         FROM c a CROSS JOIN unnest(a.labels) AS l(label) JOIN c b ON a.symbol <> b.symbol AND (list_contains(b.labels, l.label) AND a.plate <> b.plate OR NOT list_has_any(a.labels, b.labels)))"""


def _consensus(spark, sf_dir):
    profiles = similarity.median_profiles(fx.emb_cells(spark, sf_dir), ["symbol", "plate"]).withColumn("pid", F.concat_ws("@", "symbol", "plate"))
    return profiles.join(multilabel.gene_labels(fx.label_scores(spark, sf_dir)).withColumnRenamed("gene", "symbol"), "symbol")


def _mlap(spark, sf_dir):
    return similarity.normalized(multilabel.multilabel_ap(_consensus(spark, sf_dir), "pid", "symbol", differ=["plate"]))


@query(f"WITH {_CONS} SELECT pid, symbol, label, n_pos, n_total, round(ap, 6) AS ap, round(ap_norm, 6) AS ap_norm FROM {norm_sql(ranked_sql('mp', 'pid, symbol, label'))}")
def multilabel_ap(spark, sf_dir):
    return _mlap(spark, sf_dir).select("pid", "symbol", "label", "n_pos", "n_total", r6("ap"), r6("ap_norm"))


@query(f"WITH {_CONS} SELECT label, round(avg(ap), 6) AS mAP, round(avg(ap_norm), 6) AS mAP_norm, count(*) AS n_queries FROM {norm_sql(ranked_sql('mp', 'pid, symbol, label'))} WHERE ap IS NOT NULL GROUP BY 1")
def map_per_label(spark, sf_dir):
    return similarity.mean_average_precision(_mlap(spark, sf_dir).drop("ap_norm"), ["label"]).select("label", r6("mAP"), r6("mAP_norm"), "n_queries")


@query(f"WITH {_CONS} SELECT symbol, round(avg(ap), 6) AS mAP, round(avg(ap_norm), 6) AS mAP_norm, count(*) AS n_queries FROM {norm_sql(ranked_sql('mp', 'pid, symbol, label'))} WHERE ap IS NOT NULL GROUP BY 1")
def map_per_gene(spark, sf_dir):
    return similarity.mean_average_precision(_mlap(spark, sf_dir).drop("ap_norm"), ["symbol"]).select("symbol", r6("mAP"), r6("mAP_norm"), "n_queries")


@query(f"""WITH {_CONS}, g AS (SELECT label, avg(ap) AS m, avg(ap_norm) AS mn FROM {norm_sql(ranked_sql('mp', 'pid, symbol, label'))} WHERE ap IS NOT NULL GROUP BY 1)
  SELECT 'emb' AS representation, count(DISTINCT label) AS n_labels, round(avg(m), 6) AS mean_map, round(median(m), 6) AS median_map, round(avg(mn), 6) AS mean_norm, round(median(mn), 6) AS median_norm FROM g""")
def consistency_summary(spark, sf_dir):
    found = similarity.mean_average_precision(_mlap(spark, sf_dir).drop("ap_norm"), ["label"]).withColumn("representation", F.lit("emb"))
    return multilabel.summarize(found, ["representation"]).select("representation", "n_labels", *map(r6, ("mean_map", "median_map", "mean_norm", "median_norm")))


@query(f"""WITH {_CONS}, g AS (SELECT label AS organelle, avg(ap_norm) AS mn FROM {norm_sql(ranked_sql('mp', 'pid, symbol, label'))} WHERE ap IS NOT NULL GROUP BY 1), n AS (SELECT organelle, count(*) AS n_genes FROM best GROUP BY 1)
  SELECT split_part(organelle, '_GO_', 1) AS organelle, 'emb ALL' AS "column", round(mn, 6) AS mean_norm FROM g JOIN n USING (organelle) WHERE n_genes >= 3 AND NOT contains(organelle, 'Golgi')""")
def organelle_matrix(spark, sf_dir):
    found = similarity.mean_average_precision(_mlap(spark, sf_dir).drop("ap_norm"), ["label"]).withColumnRenamed("label", "organelle").withColumn("column", F.lit("emb ALL"))
    counts = multilabel.label_counts(multilabel.gene_labels(fx.label_scores(spark, sf_dir)))
    return benchmark.organelle_matrix(found, counts, 3, ("Golgi",)).select("organelle", "column", r6("mean_norm"))


@query(f"WITH {LABELS} SELECT organelle, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, organelle) AS INTEGER) AS rank FROM best GROUP BY 1 QUALIFY rank <= 3")
def top_labels(spark, sf_dir):
    flat = multilabel.gene_labels(fx.label_scores(spark, sf_dir)).select(F.explode("labels").alias("organelle"))
    return benchmark.top_labels(flat, 3)


_RANK = f"""{fx.EMB}, u AS (SELECT symbol, i, avg(features[i]) AS m FROM emb, range(1, 65) t(i) GROUP BY 1, 2), cent AS (SELECT symbol AS label, list(m ORDER BY i) AS f FROM u GROUP BY 1),
  sc AS (SELECT e.vec_id, c.label, round(list_cosine_similarity(e.features, c.f), 9) AS score, CAST(e.symbol = c.label AS INT) AS target FROM emb e CROSS JOIN cent c),
  a1 AS (SELECT label, sum(target * tp / seen) / sum(target) AS ap FROM (SELECT *, sum(target) OVER w AS tp, count(*) OVER w AS seen FROM sc WINDOW w AS (PARTITION BY label ORDER BY score DESC)) GROUP BY 1),
  a2 AS (SELECT vec_id, sum(target * tp / seen) / sum(target) AS ap FROM (SELECT *, sum(target) OVER w AS tp, count(*) OVER w AS seen FROM sc WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC)) GROUP BY 1)"""


@query(f"""WITH {_RANK} SELECT round((SELECT avg(ap) FROM a1), 6) AS macro_ap, round((SELECT avg(ap) FROM a2), 6) AS lrap, (SELECT count(*) FROM a1) AS n_labels, (SELECT count(*) FROM a2) AS n_samples,
  round((SELECT avg(CAST(CAST(k <= 5 AS INT) = target AS INT)) FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k FROM sc)), 6) AS hamming_top_k""")
def multilabel_rank_metrics(spark, sf_dir):
    e = fx.emb_cells(spark, sf_dir)
    centre = e.select("symbol", F.posexplode("features").alias("i", "x")).groupBy("symbol", "i").agg(F.avg("x").alias("m")).groupBy(F.col("symbol").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("f"))
    scores = e.crossJoin(centre).select("vec_id", "label", F.round(dot(F.col("features"), F.col("f")) / (norm(F.col("features")) * norm(F.col("f"))), 9).alias("score"), (F.col("symbol") == F.col("label")).cast("int").alias("target"))  # one centre for each label
    return metrics.ranking_metrics(scores, "vec_id", "label", "score", "target").withColumns({c: F.round(c, 6) for c in ("macro_ap", "lrap", "hamming_top_k")})


# ---------------------------------------------------------------- loaders and joins

@query(f"""WITH {fx.CELLS}, k AS (SELECT concat_ws('_', "Metadata_Plate", "Metadata_well_position", "Metadata_ImageNumber", "Metadata_ObjectNumber") AS cell_id, "Metadata_gene_allele", "Metadata_ImageNumber" AS img FROM cells)
  SELECT cell_id, "Metadata_gene_allele", round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM k JOIN embeddings ON vec_id = img""")
def embedding_export(spark, sf_dir):
    df, _ = fx.cells(spark, sf_dir)
    meta = df.select(contract.cell_id().alias("cell_id"), ALLELE, IMAGE)
    vectors = fx.read(spark, sf_dir, "embeddings").select("vec_id", F.array(F.slice("embedding", 1, 32)).alias("grid"), F.slice("embedding", 33, 32).alias("rest"))
    emb = contract.flatten_embeddings(vectors, "grid", "rest").select(F.col("vec_id").alias(IMAGE), "features")
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return contract.join_metadata(emb, meta, IMAGE).select("cell_id", ALLELE, F.round(total, 6).alias("total"))


@query(f"""WITH {fx.ANNOTATED} SELECT "Metadata_plate_map_name" AS source_batch, "Metadata_symbol", count(*) AS n, round(median("Cells_Intensity_MeanIntensity_DNA"), 6) AS dna, 6 AS n_features FROM annotated WHERE "Metadata_node_type" = 'disease_wt' AND "Metadata_Plate" LIKE '%T4' GROUP BY 1, 2""")
def pooled_reference(spark, sf_dir):
    df, names = annotated(spark, sf_dir)
    own = df.where((F.col("Metadata_node_type") == "disease_wt") & F.col(PLATE).endswith("T4"))
    sides = [contract.take_features(own.where(F.col(PLATEMAP) == p), names, [n for n in names if n not in gone]) for p, gone in (("P1", names[6:7]), ("P2", names[7:8]))]
    common = contract.common_features(sides)
    pooled = contract.union_all([contract.take_features(d, n, common)[0] for d, n in sides])
    at = common.index("Cells_Intensity_MeanIntensity_DNA")
    return pooled.groupBy(F.col(PLATEMAP).alias("source_batch"), "Metadata_symbol").agg(F.count("*").alias("n"), F.round(F.median(F.col("features")[at]), 6).alias("dna"), F.lit(len(common)).alias("n_features"))


@query(f"""WITH {fx.ANNOTATED} SELECT "Metadata_Control", "Metadata_Plate", count(*) AS n FROM annotated WHERE "Metadata_ObjectNumber" % 5 <> 0 GROUP BY 1, 2""")
def joined_controls(spark, sf_dir):
    from ..sources.io import load_features

    df, _ = annotated(spark, sf_dir)
    features = df.where(F.col(OBJECT) % 5 != 0).drop("Metadata_Control")
    return load_features(features, df).groupBy("Metadata_Control", PLATE).agg(F.count("*").alias("n"))


@query("""SELECT 'nation' AS kind, n_name AS name, n_regionkey AS regionkey FROM nation UNION ALL BY NAME SELECT 'region' AS kind, r_name AS name FROM region""")
def diagonal_union(spark, sf_dir):
    nation = fx.read(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"))
    return contract.union_all([nation, fx.read(spark, sf_dir, "region").select(F.lit("region").alias("kind"), F.col("r_name").alias("name"))], diagonal=True)


# ---------------------------------------------------------------- audits

@query(f"""WITH {fx.RECEIPT}, f AS (SELECT doc_id, sha256(text) AS sha, n_chars AS size FROM documents) SELECT coalesce(f.doc_id, r.doc_id) AS doc_id,
  CASE WHEN f.sha IS NULL THEN 'missing' WHEN r.sha IS NULL THEN 'extra' WHEN f.size <> r.size THEN 'size' WHEN f.sha <> r.sha THEN 'content' END AS fault FROM f FULL JOIN receipt r ON f.doc_id = r.doc_id WHERE fault IS NOT NULL""")
def content_audit(spark, sf_dir):
    found = fx.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("size"))
    return audit.content_audit(found, fx.receipt(spark, sf_dir), "doc_id")


@query("""WITH s AS (SELECT DISTINCT source AS batch FROM documents WHERE source <> 'src3'), m AS (SELECT DISTINCT source AS batch FROM documents WHERE source <> 'src5')
  SELECT batch, 'shard only' AS fault FROM s WHERE batch NOT IN (SELECT batch FROM m) UNION ALL SELECT batch, 'manifest only' FROM m WHERE batch NOT IN (SELECT batch FROM s)""")
def release_check(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").where("source is not null")
    paths = docs.select(F.concat(F.lit("shards/"), "source", F.lit("/part.tar")).alias("path"))
    shards = paths.select(F.regexp_extract("path", "shards/([^/]+)/", 1).alias("batch"))
    return audit.release_check(shards.where("batch <> 'src3'"), docs.select(F.col("source").alias("batch")).where("batch <> 'src5'"), "batch")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"""SELECT '{t}' AS "table", (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns""" for t in _TABLES))
def file_inventory(spark, sf_dir):
    """Rows and columns of every table, from the inventories of their files."""
    found = [audit.file_inventory(spark, f"{sf_dir}/{t}.parquet").groupBy("n_columns").agg(F.sum("n_rows").alias("n_rows")).select(F.lit(t).alias("table"), "n_rows", F.col("n_columns").cast("long").alias("n_columns")) for t in _TABLES]
    return contract.union_all(found)


@query()
def pca_profiles(spark, sf_dir):
    return stats.principal_components(similarity.median_profiles(fx.emb_cells(spark, sf_dir), ["gene_allele"]))


@query(f"""WITH {fx.CELLS}, k AS (SELECT "Metadata_ImageNumber" AS img FROM cells) SELECT (SELECT count(DISTINCT vec_id) FROM embeddings) AS n_left, (SELECT count(DISTINCT img) FROM k) AS n_right, (SELECT count(DISTINCT img) FROM k SEMI JOIN embeddings ON vec_id = img) AS n_both""")
def overlap_counts(spark, sf_dir):
    left = fx.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return contract.overlap_counts(left, fx.cells(spark, sf_dir)[0].select(F.col(IMAGE).alias("id")), "id")
