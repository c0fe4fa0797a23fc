"""Preprocessing queries over the cell fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import counted_medians
from ..operators import annotate, contract, normalize, qc, select
from ..operators.contract import ALLELE, CONTROL, IMAGE, NODE, OBJECT, PLATE, SITE, SYMBOL, WELL
from ..operators.moments import feature_moments
from ..sources import fixtures as fx
from ..sources.scratch import stored
from .registry import query

USED = [n for n in fx.FEATURES if n != "Nuclei_AreaShape_Ratio"]
LEAST = 350  # a well passes with one cell in so many of the table
STATS = """stats AS (
  SELECT "Metadata_Plate", feature, median(value) AS median, mad(value) AS mad, min(value) AS min, max(value) AS max, count(value) AS count FROM fine GROUP BY 1, 2),
  acv AS (SELECT *, coalesce(abs(mad / nullif(median, 0)), 0) AS abs_coef_var FROM stats)"""


def _stored(spark, sf_dir):
    """The cells written once, for what reads them in several passes."""
    df, names = fx.cells(spark, sf_dir)
    return stored(df, "cells"), names


def r6(name: str):
    return F.round(name, 6).alias(name)


@query(f"""WITH {fx.LONG}, {STATS} SELECT "Metadata_Plate", feature, round(median, 6) AS median, round(mad, 6) AS mad, round(min, 6) AS min, round(max, 6) AS max, count AS n, round(abs_coef_var, 6) AS abs_coef_var FROM acv""")
def plate_stats(spark, sf_dir):
    df, names = _stored(spark, sf_dir)
    return normalize.plate_stats(df, names).select(PLATE, "feature", *map(r6, ("median", "mad", "min", "max")), F.col("count").alias("n"), r6("abs_coef_var"))


Z_LIST = ", ".join(f"'{n}'" for n in USED)


@query(f"""WITH {fx.LONG}, wells AS (SELECT "Metadata_Plate", "Metadata_well_position" FROM cells GROUP BY 1, 2 HAVING count(*) >= (SELECT count(*) // {LEAST} FROM cells)),
  kept AS (SELECT f.* FROM fine f SEMI JOIN wells USING ("Metadata_Plate", "Metadata_well_position") WHERE feature IN ({Z_LIST})),
  s AS (SELECT "Metadata_Plate", feature, median(value) AS med, mad(value) AS mad FROM kept GROUP BY 1, 2),
  z AS (SELECT "Metadata_gene_allele", k.feature, greatest(-100, least(100, CASE WHEN s.mad <> 0 THEN (value - s.med) / s.mad ELSE value END)) AS z FROM kept k JOIN s ON k."Metadata_Plate" = s."Metadata_Plate" AND k.feature = s.feature)
  SELECT "Metadata_gene_allele", feature, round(median(z), 6) AS z_median, count(*) AS n FROM z GROUP BY 1, 2""")
def robust_z_allele_median(spark, sf_dir):
    """Well gate, plate statistics, robust scaling, clipping, median profile of each allele."""
    df, names = fx.cells(spark, sf_dir)
    df, names = contract.take_features(df.select(PLATE, WELL, ALLELE, "features"), names, USED)
    df = stored(df, "cells")
    df = qc.drop_low_count_wells(df, df.count() // LEAST)
    z = qc.clip(normalize.robust_z(df, names, normalize.plate_stats(df, names)))
    return counted_medians(contract.long_form(z, names, ALLELE), [ALLELE, "feature"], "value", "z_median").withColumn("z_median", F.round("z_median", 6))


@query(f"""WITH {fx.CELLS}, {fx.MANIFEST} SELECT "Metadata_Plate", "Metadata_well_position", "Metadata_ImageNumber", "Metadata_ObjectNumber", "Metadata_gene_allele" FROM cells
  SEMI JOIN manifest USING ("Metadata_Plate", "Metadata_well_position", "Metadata_ImageNumber", "Metadata_ObjectNumber")""")
def manifest_semi_join(spark, sf_dir):
    df, _ = fx.cells(spark, sf_dir)
    return qc.filter_to_manifest(df, fx.manifest(df)).select(PLATE, WELL, IMAGE, OBJECT, ALLELE)


@query(f"""WITH {fx.CELLS} SELECT "Metadata_Plate", "Metadata_well_position", "Metadata_ImageNumber", "Metadata_ObjectNumber" FROM cells QUALIFY count(*) OVER (PARTITION BY "Metadata_Plate", "Metadata_well_position") >= (SELECT count(*) // {LEAST} FROM cells)""")
def drop_low_wells(spark, sf_dir):
    df, _ = fx.cells(spark, sf_dir)
    return qc.drop_low_count_wells(df, df.count() // LEAST).select(PLATE, WELL, IMAGE, OBJECT)


MISSING = f"""WITH {fx.LONG}, miss AS (SELECT feature, count(*) FILTER (value IS NULL OR isinf(value) OR isnan(value)) AS n_missing FROM long GROUP BY 1),
  limits AS (SELECT * FROM (VALUES (100), (2000)) t(most))
  SELECT most AS max_missing, miss.feature, n_missing, n_missing <= most AS kept,
         (SELECT count(*) FROM (SELECT rid FROM long l JOIN miss m USING (feature) WHERE m.n_missing <= limits.most GROUP BY rid HAVING count(*) FILTER (value IS NULL OR isinf(value) OR isnan(value)) = 0)) AS n_rows
  FROM miss CROSS JOIN limits"""


@query(MISSING)
def drop_missing(spark, sf_dir):
    df, names = fx.cells(spark, sf_dir)
    counts = qc.missing_counts(df, names)
    parts = []
    for most in (100, 2000):
        rows = qc.drop_missing(df, names, most)[0].agg(F.count("*").alias("n_rows"))
        parts.append(counts.crossJoin(rows).select(F.lit(most).alias("max_missing"), "feature", "n_missing", (F.col("n_missing") <= most).alias("kept"), "n_rows"))  # one row of counts
    return contract.union_all(parts)


@query(f"""WITH {fx.LONG}, {STATS} SELECT feature FROM acv GROUP BY 1 HAVING count(*) FILTER (mad <> 0 AND abs_coef_var > 0.001) = (SELECT count(DISTINCT "Metadata_Plate") FROM acv)""")
def variant_features(spark, sf_dir):
    df, names = _stored(spark, sf_dir)
    return normalize.variant_features(normalize.plate_stats(df, names))


@query(f"""WITH {fx.LONG} SELECT feature, round(stddev_samp(value), 6) AS std FROM long WHERE feature <> 'Nuclei_AreaShape_Ratio' GROUP BY 1 HAVING stddev_samp(value) < 1e-6""")
def dead_features(spark, sf_dir):
    df, names = fx.cells(spark, sf_dir)
    df, names = contract.take_features(df, names, USED)
    return normalize.feature_spread(df, names).where("std < 1e-6").select("feature", r6("std"))


@query(f"""WITH {fx.LONG}, c AS (SELECT feature, value, count(*) AS n FROM fine GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS k FROM c),
  v AS (SELECT feature, coalesce(max(n) FILTER (k = 2) / max(n) FILTER (k = 1), 0) AS freq_ratio, count(*) / sum(n) AS unique_ratio FROM k GROUP BY 1)
  SELECT feature, round(freq_ratio, 6) AS freq_ratio, round(unique_ratio, 6) AS unique_ratio, freq_ratio >= 0.05 AND unique_ratio >= 0.0001 AS kept FROM v""")
def variance_threshold(spark, sf_dir):
    df, names = fx.cells(spark, sf_dir)
    return select.variance_threshold(df, names, 0.05, 0.0001).select("feature", r6("freq_ratio"), r6("unique_ratio"), "kept")


_PAIRS = " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, nullif(corr("{a}", "{b}"), 'nan'::DOUBLE) AS r FROM cells""" for a in USED for b in USED if a != b)


@query(f"""WITH {fx.CELLS}, c AS ({_PAIRS}), t AS (SELECT a, sum(abs(coalesce(r, 0))) AS total FROM c GROUP BY 1)
  SELECT c.a AS feature, round(max(t.total), 6) AS total_abs_corr, bool_or(abs(r) > 0.9 AND (round(t.total, 9) > round(o.total, 9) OR round(t.total, 9) = round(o.total, 9) AND c.a > c.b)) AS dropped
  FROM c JOIN t ON c.a = t.a JOIN t o ON c.b = o.a GROUP BY 1""")
def correlated_drop(spark, sf_dir):
    df, names = fx.cells(spark, sf_dir)
    df, names = contract.take_features(df, names, USED)
    return select.correlated(df, names).select("feature", r6("total_abs_corr"), "dropped")


def annotated(spark, sf_dir):
    df, names = fx.cells(spark, sf_dir)
    return annotate.annotate_controls(df, **fx.CONTROLS), names


@query(f"""WITH {fx.ANNOTATED} SELECT "Metadata_symbol", "Metadata_gene_allele", "Metadata_node_type", "Metadata_Control", count(*) AS n_cells FROM annotated GROUP BY 1, 2, 3, 4""")
def annotate_controls(spark, sf_dir):
    return annotated(spark, sf_dir)[0].groupBy(SYMBOL, ALLELE, NODE, CONTROL).agg(F.count("*").alias("n_cells"))


_NAMES = "dict AS (SELECT unnest(range(8)) AS feature_id, unnest([" + ", ".join(f"'{n}'" for n in fx.FEATURES) + "]) AS name)"
_CHANNELS = f"""WITH {fx.LONG}, {_NAMES}, v AS (SELECT feature AS name, count(*) AS n_values FROM fine GROUP BY 1) SELECT channel, CAST(feature_id AS INTEGER) AS feature_id, name, n_values FROM dict JOIN v USING (name), (VALUES ('GFP'), ('Morph'), ('ALL'), ('DNA'), ('AGP'), ('Mito')) c(channel)
  WHERE CASE channel WHEN 'ALL' THEN true WHEN 'GFP' THEN contains(lower(name), '_gfp') WHEN 'Morph' THEN NOT contains(lower(name), '_gfp') ELSE contains(lower(name), '_' || lower(channel)) AND NOT contains(lower(name), '_gfp') END"""


@query(_CHANNELS)
def channel_map(spark, sf_dir):
    df, names = fx.cells(spark, sf_dir)
    return select.channel_map(spark, names).join(_values(df, names), "name").select("channel", "feature_id", "name", "n_values")


def _values(df, names):
    return feature_moments(df, names).select(F.col("feature").alias("name"), F.col("n").alias("n_values"))


@query(f"""WITH {fx.LONG} SELECT "Metadata_Plate", feature, round(avg(value), 6) AS mean, count(*) AS n FROM fine
  WHERE feature IN ('Cells_Intensity_MeanIntensity_GFP', 'Cells_Texture_Net_GFP') GROUP BY 1, 2""")
def channel_slice(spark, sf_dir):
    df, names = fx.cells(spark, sf_dir)
    select.restrict_channels(select.channel_map(spark, names), ["GFP"])
    df, names = select.channel_slice(df, names, "GFP")
    return contract.long_form(df, names, PLATE).groupBy(PLATE, "feature").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query(f"""WITH {fx.LONG} SELECT feature, count(*) AS n_clipped FROM fine WHERE abs(value) > 100 GROUP BY 1""")
def clip_counts(spark, sf_dir):
    df, names = fx.cells(spark, sf_dir)
    return qc.clip_counts(df, names, 100)


@query(f"""WITH {fx.LONG}, {_NAMES} SELECT CAST(feature_id AS INTEGER) AS feature_id, name, count(*) AS n_values FROM dict JOIN fine ON feature = name WHERE contains(name, '_Neighbors_') GROUP BY 1, 2""")
def blocklist(spark, sf_dir):
    df, names = fx.cells(spark, sf_dir)
    return select.blocked(select.feature_dictionary(spark, names)).join(_values(df, names), "name").select("feature_id", "name", "n_values")


@query(f"""WITH {fx.LONG}, c AS (SELECT feature, value, count(*) AS n FROM fine WHERE NOT contains(feature, '_Neighbors_') GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS k FROM c),
  v AS (SELECT feature, coalesce(max(n) FILTER (k = 2) / max(n) FILTER (k = 1), 0) AS f, count(*) / sum(n) AS u FROM k GROUP BY 1)
  SELECT v.feature, round(avg(l.value), 4) AS mean FROM v JOIN fine l USING (feature) WHERE f >= 0.05 AND u >= 0.0001 GROUP BY 1""")
def prefilter(spark, sf_dir):
    df, names = select.prefilter(*fx.cells(spark, sf_dir), 0.05, 0.0001)
    return contract.long_form(df, names).where("value < double('inf')").groupBy("feature").agg(F.round(F.avg("value"), 4).alias("mean"))


@query(f"""WITH {fx.CELLS} SELECT "Metadata_Plate", CAST(regexp_extract("Metadata_Plate", 'T([0-9]+)$', 1) AS INTEGER) AS template_num, "Metadata_Plate" LIKE '%T4' AS held_out, count(*) AS n_cells FROM cells
  WHERE CAST(regexp_extract("Metadata_Plate", 'T([0-9]+)$', 1) AS INTEGER) IN (3, 4) GROUP BY 1""")
def plate_filter(spark, sf_dir):
    df, _ = fx.cells(spark, sf_dir)
    return qc.templates(df).groupBy(PLATE).agg(F.count("*").alias("n_cells")).select(PLATE, contract.template_number().alias("template_num"), F.col(PLATE).endswith("T4").alias("held_out"), "n_cells")


_ID = """concat_ws('_', "Metadata_Plate", "Metadata_well_position", "Metadata_ImageNumber", "Metadata_ObjectNumber")"""


@query(f"""WITH {fx.CELLS} SELECT 'B1' AS batch_id, "Metadata_symbol" AS gene, "Metadata_gene_allele" AS variant, row_number() OVER (PARTITION BY "Metadata_gene_allele" ORDER BY "Metadata_Plate", {_ID}) - 1 AS cell_idx, {_ID} AS metadata_cell_id,
  "Metadata_Plate" AS plate, CAST(regexp_extract("Metadata_Plate", 'T([0-9]+)$', 1) AS INTEGER) AS template_num,
  CASE WHEN regexp_extract("Metadata_Plate", 'T([0-9]+)$', 1) IN ('1', '2') THEN 'train' WHEN regexp_extract("Metadata_Plate", 'T([0-9]+)$', 1) = '3' THEN 'val' ELSE 'test' END AS split FROM cells""")
def split_manifest(spark, sf_dir):
    return annotate.split_manifest(fx.cells(spark, sf_dir)[0], "B1")


@query(f"""WITH {fx.CELLS}, t AS (SELECT DISTINCT "Metadata_gene_allele" AS a FROM cells WHERE "Metadata_Plate" LIKE '%T1' AND "Metadata_Site" < 3), i AS (SELECT a, dense_rank() OVER (ORDER BY a) - 1 AS k FROM t)
  SELECT 'drop' AS unseen, a AS variant, k AS label_index, count(*) AS n FROM cells JOIN i ON a = "Metadata_gene_allele" WHERE "Metadata_Plate" LIKE '%T4' GROUP BY 2, 3
  UNION ALL SELECT 'zero', "Metadata_gene_allele", coalesce(k, 0), count(*) FROM cells LEFT JOIN i ON a = "Metadata_gene_allele" WHERE "Metadata_Plate" LIKE '%T4' GROUP BY 2, 3""")
def label_index(spark, sf_dir):
    df = fx.cells(spark, sf_dir)[0].select(PLATE, SITE, F.col(ALLELE).alias("variant"))
    train, test = df.where(F.col(PLATE).endswith("T1") & (F.col(SITE) < 3)), qc.plates_ending(df)
    both = [annotate.label_index(train, test, "variant", how).select(F.lit(how).alias("unseen"), "variant", "label_index") for how in ("drop", "zero")]
    return contract.union_all(both).groupBy("unseen", "variant", "label_index").agg(F.count("*").alias("n"))


@query(f"""WITH {fx.CELLS} SELECT "Metadata_gene_allele", "Metadata_Plate", "Metadata_ImageNumber", "Metadata_ObjectNumber",
  row_number() OVER (PARTITION BY "Metadata_gene_allele" ORDER BY "Metadata_Plate", "Metadata_ImageNumber", "Metadata_ObjectNumber") - 1 AS position FROM cells""")
def row_ids(spark, sf_dir):
    df, _ = fx.cells(spark, sf_dir)
    return annotate.row_ids(df.select(ALLELE, PLATE, IMAGE, OBJECT), ALLELE, [PLATE, IMAGE, OBJECT])
