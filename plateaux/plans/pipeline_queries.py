"""Whole runs over the fixtures; learned and sampled results have no SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, contract, similarity
from ..operators.contract import ALLELE, CONTROL, IMAGE, NODE, OBJECT, PLATE
from ..sources import fixtures as fx
from ..sources.scratch import stored
from . import pipelines, retrieval_queries
from .preprocess_queries import r6
from .registry import query


def _preprocessed(spark, sf_dir):
    df, names = fx.cells(spark, sf_dir)
    df = stored(df, "cells")  # the manifest is made of them twice
    return pipelines.preprocess(df, names, fx.manifest(df), pipelines.Controls(**fx.CONTROLS))


_KEYS = '"Metadata_Plate", "Metadata_well_position", "Metadata_ImageNumber", "Metadata_ObjectNumber"'
_BAD = "value IS NULL OR isinf(value) OR isnan(value)"
_PREPROCESSED = f"""WITH {fx.ANNOTATED}, {fx.MANIFEST}, listed AS (SELECT * FROM annotated SEMI JOIN manifest USING ({_KEYS})),
  wells AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM (SELECT * FROM listed QUALIFY count(*) OVER (PARTITION BY "Metadata_Plate", "Metadata_well_position") >= 20)),
  l0 AS (SELECT rid, "Metadata_Plate", "Metadata_node_type", "Metadata_Control", feature, value FROM wells UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(f'"{n}"' for n in fx.FEATURES)}))),
  few AS (SELECT feature FROM l0 GROUP BY 1 HAVING count(*) FILTER ({_BAD}) <= 100), l1 AS (SELECT * FROM l0 SEMI JOIN few USING (feature)),
  l2 AS MATERIALIZED (SELECT * FROM l1 WHERE rid NOT IN (SELECT rid FROM l1 WHERE {_BAD})),
  st AS (SELECT "Metadata_Plate", feature, median(value) AS med, mad(value) AS mad FROM l2 GROUP BY 1, 2),
  vary AS (SELECT feature FROM st GROUP BY 1 HAVING count(*) FILTER (mad <> 0 AND coalesce(abs(mad / nullif(med, 0)), 0) > 0.001) = (SELECT count(DISTINCT "Metadata_Plate") FROM st)),
  z AS MATERIALIZED (SELECT rid, "Metadata_node_type", "Metadata_Control", feature, greatest(-100, least(100, CASE WHEN mad <> 0 THEN (value - med) / mad ELSE value END)) AS z FROM l2 SEMI JOIN vary USING (feature) JOIN st USING ("Metadata_Plate", feature)),
  c AS (SELECT feature, z, count(*) AS n FROM z WHERE NOT contains(feature, '_Neighbors_') GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, z) AS k FROM c),
  spread AS (SELECT feature FROM k GROUP BY 1 HAVING coalesce(max(n) FILTER (k = 2) / max(n) FILTER (k = 1), 0) >= 0.05 AND count(*) / sum(n) >= 0.01), y AS MATERIALIZED (SELECT * FROM z SEMI JOIN spread USING (feature)),
  r AS (SELECT a.feature AS a, b.feature AS b, corr(a.z, b.z) AS r FROM y a JOIN y b ON a.rid = b.rid AND a.feature <> b.feature AND contains(a.feature, 'GFP') = contains(b.feature, 'GFP') GROUP BY 1, 2),
  t AS (SELECT a, sum(abs(r)) AS total FROM r GROUP BY 1),
  gone AS (SELECT DISTINCT r.a AS feature FROM r JOIN t ON r.a = t.a JOIN t o ON r.b = o.a WHERE abs(r) > 0.9 AND (round(t.total, 9) > round(o.total, 9) OR round(t.total, 9) = round(o.total, 9) AND r.a > r.b))
  SELECT feature, "Metadata_node_type", "Metadata_Control", count(*) AS n, round(avg(z), 4) AS mean, round(stddev_samp(z), 4) AS std FROM y ANTI JOIN gone USING (feature) GROUP BY 1, 2, 3"""


@query(_PREPROCESSED)
def preprocess_batch(spark, sf_dir):
    """The preprocessing chain; mean and spread of what it keeps, by feature and control axis."""
    df, names = _preprocessed(spark, sf_dir)
    return contract.long_form(df, names, NODE, CONTROL).groupBy("feature", NODE, CONTROL).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"))


@query()
def activity_run(spark, sf_dir):
    """The retrieval run with all its columns: site medians, full nulls, control null."""
    return pipelines.activity(fx.emb_cells(spark, sf_dir), fx.CHANNELS, "vec_id", least=5, control_least=1)


@query()
def classification_run(spark, sf_dir):
    """All pairs of the batch, controls included, every left-out plate, every feature: the metrics of each classifier."""
    df, names = fx.cells(spark, sf_dir)
    return pipelines.classify(annotate.annotate_controls(df, **fx.CONTROLS), names, least_control=5)["metrics"]


def _profile_sql(source: str, unit: str, run: str, out: str) -> str:
    """Median profiles of both sides: ``{out}`` (run, vec_id, symbol, gene_allele, plate, node_type, features)."""
    r = f"{run}, " if run else ""

    def side(node: str, key: str, other: str) -> str:
        return f"""SELECT {r}'{node}|' || {key} || '|' || plate || '|' || {unit} AS vec_id, min({other}) AS {other}, {key}, plate, '{node}' AS node_type, list(m ORDER BY i) AS features FROM (
      SELECT {r}{key}, plate, {unit}, min({other}) AS {other}, i, median(features[i]) AS m FROM {source}, range(1, 65) t(i) WHERE node_type = '{node}' GROUP BY {r}{key}, plate, {unit}, i) GROUP BY {r}{key}, plate, {unit}"""

    return f"{out} AS MATERIALIZED (SELECT {r}vec_id, symbol, gene_allele, plate, node_type, features FROM ({side('allele', 'gene_allele', 'symbol')}) UNION ALL SELECT {r}vec_id, symbol, gene_allele, plate, node_type, features FROM ({side('disease_wt', 'symbol', 'gene_allele')}))"


_CHANNEL_ROWS = "(VALUES ('GFP', 0), ('DNA', 16), ('AGP', 32), ('Mito', 48)) c(channel, lo)"
_IN_SCOPE = """al AS (SELECT gene_allele FROM emb WHERE node_type = 'allele' AND control IN ('Exp', 'cPC') GROUP BY 1 HAVING count(*) >= 5),
  src AS (SELECT * FROM emb WHERE node_type = 'disease_wt' OR node_type = 'allele' AND gene_allele IN (SELECT gene_allele FROM al)),
  kept AS (SELECT * FROM src WHERE symbol IN (SELECT symbol FROM src GROUP BY 1 HAVING count(DISTINCT node_type) = 2))"""


def _sliced_sql(pool: str, out: str) -> str:
    return f"{out} AS (SELECT p.* EXCLUDE (features), c.channel, p.features[c.lo + 1 : c.lo + 16] AS features FROM {pool} p CROSS JOIN {_CHANNEL_ROWS})"


def _scored_sql(pool: str, keys: str) -> str:
    """Means of AP by group; ``keys`` start with the channel."""
    run = keys.split(", ")
    same = " AND ".join(f"a.{c} = b.{c}" for c in run if c != "gene_allele")
    pairs = f"""(SELECT a.vec_id, {", ".join(f"a.{c}" for c in dict.fromkeys([*run, "gene_allele"]))}, b.vec_id AS partner, list_cosine_similarity(a.features, b.features) AS sim, CASE WHEN a.gene_allele = b.gene_allele AND a.plate <> b.plate THEN 1 ELSE 0 END AS positive
      FROM {pool} a JOIN {pool} b ON a.vec_id <> b.vec_id AND {same} AND (a.gene_allele = b.gene_allele AND a.plate <> b.plate OR a.plate = b.plate AND a.symbol = b.symbol AND a.node_type <> b.node_type) WHERE a.node_type = 'allele')"""
    ranked = retrieval_queries.ranked_sql(pairs, ", ".join(dict.fromkeys(["vec_id", *run, "gene_allele"])))
    return f"(SELECT {keys}, avg(ap) AS m, avg(ap_norm) AS mn, count(*) AS n FROM {retrieval_queries.norm_sql(ranked)} WHERE ap IS NOT NULL GROUP BY {keys})"


_BY_SITE = f"""WITH {retrieval_queries.LOO}, {_IN_SCOPE}, {_profile_sql('kept', 'site', '', 'pool')}, {_sliced_sql('pool', 'sl')},
  {_profile_sql('lp', 'site', 'loo_id', 'turn')}, {_sliced_sql('turn', 'tl')}, act AS {_scored_sql('sl', 'channel, gene_allele')}, nul AS {_scored_sql('tl', 'channel, loo_id')},
  lim AS (SELECT channel, quantile_cont(mn, 0.95) AS q FROM nul GROUP BY 1)
  SELECT channel, gene_allele, round(m, 6) AS mAP, round(mn, 6) AS mAP_norm, n AS n_queries, round(q, 6) AS null_threshold_p95, coalesce(mn > q, false) AS is_hit FROM act LEFT JOIN lim USING (channel)"""


@query(_BY_SITE)
def activity_by_site(spark, sf_dir):
    found = activity_run(spark, sf_dir)
    return found.select("channel", "gene_allele", *map(r6, ("mAP", "mAP_norm")), "n_queries", r6("null_threshold_p95"), "is_hit")


_SAMPLED = f"""WITH {fx.EMB}, {_IN_SCOPE}, drawn AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY node_type, CASE WHEN node_type = 'allele' THEN gene_allele ELSE symbol END, plate, well ORDER BY md5('42:' || vec_id), vec_id) <= 3),
  pool AS (SELECT CAST(vec_id AS VARCHAR) AS vec_id, symbol, gene_allele, plate, node_type, features FROM drawn QUALIFY node_type = 'allele' OR row_number() OVER (PARTITION BY node_type, plate ORDER BY md5('42:' || vec_id), CAST(vec_id AS VARCHAR)) <= 12), {_sliced_sql('pool', 'sl')}
  SELECT channel, gene_allele, round(m, 6) AS mAP, round(mn, 6) AS mAP_norm, n AS n_queries FROM {_scored_sql('sl', 'channel, gene_allele')}"""


@query(_SAMPLED)
def activity_of_sampled_cells(spark, sf_dir):
    """Cells and not medians: at most three of an allele, plate and well, and twelve references a plate; sampling is the feature."""
    found = pipelines.activity(fx.emb_cells(spark, sf_dir), fx.CHANNELS, "vec_id", least=5, unit="well", aggregate=False, per_unit=3, refs_per_plate=12, control_null=False)
    return found.select("channel", "gene_allele", *map(r6, ("mAP", "mAP_norm")), "n_queries")


@query(f"""WITH {fx.EMB}, o AS (SELECT gene_allele, control FROM emb WHERE node_type = 'allele' AND control IN ('Exp', 'cPC'))
  SELECT 'cpc' AS scope, gene_allele FROM o GROUP BY 2 HAVING count(*) >= 5 AND bool_or(control = 'cPC') UNION ALL SELECT 'G1_V1,exp', gene_allele FROM o GROUP BY 2 HAVING count(*) >= 5 AND bool_or(control = 'Exp' OR gene_allele = 'G1_V1')
  UNION ALL SELECT 'all', gene_allele FROM o GROUP BY 2 HAVING count(*) >= 5""")
def activity_scope(spark, sf_dir):
    df = fx.emb_cells(spark, sf_dir)
    return contract.union_all([similarity.resolve_alleles(df, scope, 5).select(F.lit(scope).alias("scope"), "gene_allele") for scope in ("cpc", "G1_V1,exp", "all")])


# ---------------------------------------------------------------- consistency by level, pooled over batches

def _batches(spark, sf_dir):
    """Two batches of the same cells' plates whose feature sets differ: the second lacks e6 and e41 and has one of its own."""
    df, names = fx.emb_cells(spark, sf_dir), [f"e{i}" for i in range(64)]
    odd = [n for n in names if n not in ("e6", "e41")]
    second = contract.take_features(df.where("vec_id % 2 = 1"), names, odd)[0].withColumn("features", F.concat("features", F.array(F.lit(1.0))))
    return [(df.where("vec_id % 2 = 0"), names), (second, [*odd, "own"])]


_CHANNEL_NAMES = {"first": [f"e{i}" for i in range(32)], "second": [f"e{i}" for i in range(32, 64)]}
_LEVELS = f"""WITH {fx.EMB}, {retrieval_queries.LABELS}, ref AS (SELECT symbol, plate, site, list_concat(features[1:6], features[8:41], features[43:64]) AS f FROM emb SEMI JOIN gl ON symbol = gene WHERE node_type = 'disease_wt'),
  u AS (SELECT CASE WHEN grouping(plate) = 1 THEN 'gene' WHEN grouping(site) = 1 THEN 'plate' ELSE 'fov' END AS level, symbol, plate, site, i, median(f[i]) AS m FROM ref, range(1, 63) t(i) GROUP BY GROUPING SETS ((symbol, i), (symbol, plate, i), (symbol, plate, site, i))),
  c AS (SELECT level, level || '|' || symbol || '|' || coalesce(plate, '') || '|' || coalesce(CAST(site AS VARCHAR), '') AS pid, symbol, plate, list(m ORDER BY i) AS f FROM u GROUP BY level, symbol, plate, site),
  s AS MATERIALIZED (SELECT level, pid, symbol, coalesce(plate, symbol) AS plate, labels, ch.channel, f[ch.a : ch.b] AS features FROM c JOIN gl ON symbol = gene CROSS JOIN (VALUES ('first', 1, 31), ('second', 32, 62)) ch(channel, a, b)),
  mp AS (SELECT a.level, a.channel, a.pid, a.symbol, l.label, b.pid AS partner, list_cosine_similarity(a.features, b.features) AS sim, CASE WHEN list_contains(b.labels, l.label) AND a.plate <> b.plate THEN 1 ELSE 0 END AS positive
         FROM s a CROSS JOIN unnest(a.labels) AS l(label) JOIN s b ON a.level = b.level AND a.channel = b.channel AND a.symbol <> b.symbol AND (list_contains(b.labels, l.label) AND a.plate <> b.plate OR NOT list_has_any(a.labels, b.labels)))"""


def _consistency_sql(by: str) -> str:
    return f"""{_LEVELS} SELECT level, channel, {by}, round(avg(ap), 6) AS mAP, round(avg(ap_norm), 6) AS mAP_norm, count(*) AS n_queries FROM {retrieval_queries.norm_sql(retrieval_queries.ranked_sql('mp', 'level, channel, pid, symbol, label'))} WHERE ap IS NOT NULL GROUP BY 1, 2, 3"""


def _consistency(spark, sf_dir, by: str):
    found = pipelines.consistency(_batches(spark, sf_dir), fx.label_scores(spark, sf_dir), _CHANNEL_NAMES, ("gene", "plate", "fov"), by=by)
    return found.select("level", "channel", by, *map(r6, ("mAP", "mAP_norm")), "n_queries")


@query(_consistency_sql("label"))
def consistency_by_label(spark, sf_dir):
    return _consistency(spark, sf_dir, "label")


@query(_consistency_sql("symbol"))
def consistency_by_gene(spark, sf_dir):
    return _consistency(spark, sf_dir, "symbol")


_FIRST = f"""WITH {fx.CELLS}, k AS (SELECT * FROM cells ORDER BY concat_ws('_', "Metadata_Plate", lpad(CAST("Metadata_ImageNumber" AS VARCHAR), 12, '0'), "Metadata_ObjectNumber", "Metadata_gene_allele") LIMIT 512),
  l AS (SELECT * FROM k UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(f'"{n}"' for n in fx.FEATURES)})))
  SELECT feature, round(CASE WHEN bool_or(isinf(value)) THEN 'nan'::DOUBLE ELSE var_samp(value) FILTER (NOT isinf(value)) END, 4) AS variance FROM l GROUP BY 1"""


@query(_FIRST)
def feature_variances(spark, sf_dir):
    """Variance of each feature over the first 512 cells in order of their keys."""
    df, names = fx.cells(spark, sf_dir)
    keyed = df.withColumn("k", F.concat_ws("_", PLATE, F.lpad(F.col(IMAGE).cast("string"), 12, "0"), OBJECT, ALLELE))
    return contract.variance_sample(keyed, 512, "k", names).select("feature", F.round("variance", 4).alias("variance"))


@query(f"""WITH {fx.CELLS}, k AS (SELECT concat_ws('_', "Metadata_Plate", "Metadata_well_position", "Metadata_ImageNumber", "Metadata_ObjectNumber") AS cell_id, "Metadata_gene_allele" FROM cells) SELECT * FROM k ORDER BY md5(cell_id), cell_id LIMIT 100""")
def smoke_cells(spark, sf_dir):
    """A sample of 100 cells, chosen by a hash of their ids."""
    df, _ = fx.cells(spark, sf_dir)
    return contract.smoke_sample(df.select(contract.cell_id().alias("cell_id"), ALLELE), 100, "cell_id")
