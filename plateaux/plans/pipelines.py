"""Whole runs: preprocessing of a batch, classification of a batch, retrieval activity with its control null."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotate, contract, folds, learn, metrics, multilabel, normalize, pairs, qc, select, similarity
from ..operators.contract import OBJECT, PLATE, PLATEMAP, WELL
from ..sources.scratch import dropped, stored


@dataclass
class Controls:
    tc: list[str] = field(default_factory=list)
    nc: list[str] = field(default_factory=list)
    pc: list[str] = field(default_factory=list)
    cpc: list[str] = field(default_factory=list)


def preprocess(df: DataFrame, names: list[str], manifest: DataFrame | None, controls: Controls, least_cells: int = 20, most_missing: int = 100, limit: float = 100.0, embeddings: bool = False) -> tuple[DataFrame, list[str]]:
    """Gates, missing values, plate statistics, variant features, robust scaling, clipping, feature selection, controls.

    The listed, the gated and the scaled cells are written to the shared folder, as several passes read them; the first two go when done.
    Embeddings skip the manifest, the blocklist and the variance threshold, and lose dead features instead of unvarying ones.
    """
    listed = manifest is not None and not embeddings
    if listed:
        df = stored(qc.filter_to_manifest(df, manifest), "listed")  # wells and missing values are counted on it
    source = df
    df, names = qc.drop_missing(qc.drop_low_count_wells(df, least_cells), names, most_missing)
    df = stored(df, "gated")  # several decisions read it
    if listed:
        dropped(source)
    stats = normalize.plate_stats(df, names)
    df, names = normalize.drop_dead_features(df, names) if embeddings else normalize.select_variant_features(df, names, stats)
    gated, df = df, stored(qc.clip(normalize.robust_z(df, names, stats), limit), "scaled")
    dropped(gated)
    if not embeddings:
        df, names = select.prefilter(df, names)
        df, names = select.decorrelate(df, names)
    return annotate.annotate_controls(df, controls.tc, controls.nc, controls.pc, controls.cpc), names


def classify(df: DataFrame, names: list[str], scope: str = "all", channels: dict[str, list[str]] | None = None, least: int = 50, least_control: int | None = None, rounds: int = learn.ROUNDS, unseen_only: bool = False) -> dict[str, DataFrame]:
    """Pairs, folds, one model for each pair, channel and fold, and the tables that follow from their predictions.

    Tables: predictions (under their fixed schema), metrics (with sizes and imbalance), importances, thresholds, summary. All
    models of a channel are one fit. Cells are counted by allele, plate, platemap and well; pairs, folds and sizes follow from these
    counts, and cells go into the fits by the groups that they give. The metrics come from the fits; predictions are made when they are read.
    """
    if unseen_only:
        df = qc.templates(df)
    unit = [contract.ALLELE, PLATE, PLATEMAP, WELL]
    units = stored(df.groupBy(contract.SYMBOL, contract.NODE, contract.CONTROL, *unit).agg(F.count("*").alias("n")), "units")
    wanted = stored(pairs.filter_scope(pairs.all_pairs(units, least, least_control, "n"), scope), "pairs")
    labelled = pairs.labelled_cells(units.groupBy(*unit).agg(F.sum("n").alias("n")), wanted)
    folds_ = stored(folds.plate_folds(labelled), "folds")
    labelled = stored(folds.fold_lists(labelled, folds_), "labelled")
    sizes = stored(learn.usable(folds.list_sizes(labelled, n="n")), "tasks")
    info = labelled.select("pair_id", "gene", "allele_ref", "allele_var", "is_control").distinct().join(sizes, "pair_id")
    own = labelled.groupBy(*unit, "n").agg(F.array_sort(F.collect_list(F.struct("pair_id", "Label", "is_control", "tests", "trains"))).alias("members"))
    groups = stored(own.groupBy("members").agg(F.sum("n").alias("__n")).withColumn("__group", F.monotonically_increasing_id()), "groups")
    at = stored(own.join(groups, "members").select("__group", *[F.col(c).alias(f"__{c}") for c in unit]), "group_units")
    cells = df.join(at, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in unit])).select("__group", PLATE, WELL, OBJECT, "features")
    if channels and len(channels) > 1:
        cells = stored(cells, "labelled_cells")
    members = groups.select("__group", "__n", F.inline("members"))
    named = lambda fold, channel: F.concat_ws("__", "pair_id", F.lit(channel), fold.cast("string"))
    scored, weights, lists, tasks = [], [], [], []
    for channel, wanted_names in (channels or {"ALL": names}).items():
        cut, kept = (cells, names) if wanted_names == names else contract.take_features(cells, names, wanted_names)
        ids = {c: F.transform(c, lambda k: named(k, channel)) for c in ("tests", "trains")}
        task = info.withColumns({"task_id": named(F.col("fold_id"), channel), "channel": F.lit(channel)})
        found, top, listed = learn.fit_groups(cut, members.select("__group", "__n", "Label", "is_control", *[c.alias(n) for n, c in ids.items()]), task, kept, rounds)
        scored.append(found.withColumn("channel", F.lit(channel)))
        weights.append(top)
        lists.append(listed)
        tasks.append(task)
    predictions = contract.union_all(scored)
    every = contract.union_all(tasks).withColumnRenamed("task_id", "classifier_id")
    measured = stored(metrics.listed_metrics(contract.union_all(lists).withColumnRenamed("task_id", "classifier_id"), "classifier_id").join(every, "classifier_id"), "metrics")  # three tables follow from it
    thresholds = metrics.null_threshold(measured.where("is_control"), ["channel"])
    shaped = predictions.select(F.col("task_id").alias("Classifier_ID"), PLATE, WELL, F.col(OBJECT).cast("long").alias(OBJECT), F.col("Label").cast("byte").alias("Label"), F.col("prediction").cast("float").alias("Prediction"), F.col("channel").alias("Feature_Type"), F.col("is_control").alias("Control"))
    return {"predictions": shaped, "metrics": measured, "importances": contract.union_all(weights), "thresholds": thresholds, "summary": metrics.allele_summary(measured, thresholds)}


def activity(df: DataFrame, channels: dict[str, tuple[int, int]], cell: str, scope: str = "all", least: int = 50, unit: str = "site", aggregate: bool = True, per_unit: int = 20, refs_per_plate: int = 0, null_size: int = 10_000, threshold: float = 0.05, seed: int = 42, control_null: bool = True, control_null_size: int = 1_000, control_least: int | None = None, percentile: float = 0.95, held_out: str | None = None) -> DataFrame:
    """mAP of every variant in scope against its reference, in every channel, with hits against the leave-one-out control null.

    Both sides go through the same steps: profiles by ``unit`` (medians, or a sample of cells), a cap on references a plate, average
    precision, normalised means, permutation p-values, correction by channel. All channels, and all leave-one-out turns, are one job.
    """
    options = {"unit": unit, "aggregate": aggregate, "per_unit": per_unit, "refs_per_plate": refs_per_plate, "cell": cell, "seed": seed}
    pool = similarity.slices(similarity.unit_profiles(df, similarity.resolve_alleles(df, scope, least), **options), channels)
    found = similarity.mean_average_precision(similarity.activity_ap(pool, "id", ["channel"], held_out), ["channel", "gene_allele"], null_size, threshold, seed, ["channel"])
    if not control_null:
        return found
    turns = similarity.loo_pool(df, similarity.loo_groups(df, least if control_least is None else control_least))
    turns = similarity.unit_profiles(turns, turns.select("gene_allele").distinct(), **options, run=["loo_id"])
    null = similarity.mean_average_precision(similarity.activity_ap(similarity.slices(turns, channels), "id", ["channel", "loo_id"], held_out), ["channel", "loo_id"], control_null_size, threshold, seed, ["channel"])
    return similarity.hits(found, similarity.null_thresholds(null, ["channel"], percentile), ["channel"])


def consistency(batches: list[tuple[DataFrame, list[str]]], scores: DataFrame, channels: dict[str, list[str]] | None = None, levels: tuple[str, ...] = ("gene",), unit: str = "site", label_threshold: float = 1.0, by: str = "label", null_size: int = 10_000, threshold: float = 0.05, seed: int = 42, held_out: str | None = None) -> DataFrame:
    """Label consistency of wild types, pooled over batches: mAP by label (``by="label"``) or by gene (``"symbol"``), for every
    level of consensus and channel, with permutation p-values corrected within each level and channel.

    Batches are (cells, feature names); features that all have are used. Channels are lists of feature names.
    """
    common = contract.common_features(batches)
    own = [d.where(F.col("node_type") == "disease_wt") for d, _ in batches]
    own = [contract.take_features(d if held_out is None else d.where(F.col("plate").endswith(held_out)), names, common)[0].select("symbol", "plate", unit, "features") for d, (_, names) in zip(own, batches, strict=True)]
    labels = multilabel.gene_labels(scores, label_threshold)
    pool = multilabel.consensus(contract.union_all(own), labels, list(levels), unit)
    channels = channels or {"ALL": common}
    parts = F.array(*[F.struct(F.lit(c).alias("channel"), F.array(*[F.col("features")[common.index(n)] for n in names if n in common]).alias("features")) for c, names in channels.items()])
    sliced = pool.withColumn("__s", F.explode(parts)).select(*[c for c in pool.columns if c != "features"], "__s.channel", "__s.features")
    ap = multilabel.level_ap(sliced, ["channel"])
    return similarity.mean_average_precision(ap, ["level", "channel", by], null_size, threshold, seed, ["level", "channel"])
