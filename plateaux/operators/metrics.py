"""Classifier metrics, null thresholds, allele summaries and label-ranking metrics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.blocks import column
from ..functions.stats import missing, nearest_quantile
from ..sources.scratch import stored

SUMMARY = ["pair_id", "gene", "allele_var", "channel", "auroc_mean", "auroc_std", "auprc_mean", "balanced_accuracy_mean", "n_classifiers", "null_threshold", "is_hit"]

OCTAVE = 64  # ranges of scores in each octave
HELD = 1 << 21  # counted scores that a task holds, and new rows that it adds to them at a time
RANKED = 1 << 21  # counted scores for which a task of its own is worth while
LISTED = 1 << 21  # scores of a group that one task ranks
TASKS = 200  # that rank smaller tables, each some ranges; for more, a shuffle holds its rows before it writes them


def _counted(rows: DataFrame) -> DataFrame:
    """Sums of ``pos`` and ``neg`` by the other columns. A task hands on what it holds when that gets too large, so a score may have
    several rows, and memory does not follow how many scores are distinct."""
    keys = [c for c in rows.columns if c not in ("pos", "neg")]

    def run(batches):
        held, n = [], 0
        add = lambda parts: pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([("pos", "sum"), ("neg", "sum")]).rename_columns({"pos_sum": "pos", "neg_sum": "neg"}).select(names)
        for b in batches:
            held.append(pa.Table.from_arrays(b.columns, names=names))
            n += b.num_rows
            if n >= HELD:
                held, n = [add(held)], 0
                if held[0].num_rows > HELD:
                    yield from held.pop().to_batches()
        if held:
            yield from add(held).to_batches()

    names = rows.columns
    return rows.mapInArrow(run, rows.schema)


def _range(score: Column) -> Column:
    """A number that never falls as scores rise: of the sign and OCTAVE ranges in each octave; ends for null, infinities and NaN."""
    x = score.cast("double")
    size = F.floor(F.log2(F.abs(x)) * OCTAVE)
    end = lambda n: F.lit(n).cast("long")
    return F.when(x.isNull(), end(-(1 << 24))).when(F.isnan(x), end(1 << 24)).when(F.abs(x) == float("inf"), F.when(x > 0, end(1 << 23)).otherwise(end(-(1 << 23)))).when(x > 0, (1 << 20) + size).when(x < 0, -(1 << 20) - size).otherwise(end(0))


MEASURES = ["n_pos", "n_neg", "auroc", "auprc", "macro_f1", "sensitivity", "specificity", "balanced_accuracy"]


def classifier_metrics(pred: DataFrame, keys: list[str], label: str = "label", score: str = "prediction", threshold: float = 0.5) -> DataFrame:
    """AUROC (tied scores count half), AUPRC (average precision over distinct scores), macro F1, sensitivity, specificity and
    balanced accuracy of each group; null where one class is missing.

    Groups go by a number, so a counted row is a few numbers whatever the keys, and no way in which the rows already lie decides
    what meets in a task.
    """
    groups = stored(pred.select(*keys).distinct().withColumn("__g", F.monotonically_increasing_id()), "groups")
    on = reduce(lambda a, b: a & b, [pred[k].eqNullSafe(groups[k]) for k in keys])
    rows = pred.join(groups, on).select("__g", F.col(label).alias("__y"), F.col(score).alias("__s"))
    return numbered_metrics(rows, "__g", "__y", "__s", threshold).join(groups, "__g").select(*keys, *MEASURES)


def numbered_metrics(pred: DataFrame, group: str, label: str = "label", score: str = "prediction", threshold: float = 0.5) -> DataFrame:
    """classifier_metrics of groups that are told by a number, not null.

    Scores are first counted and written, by group and score. Running sums go over ranges of scores (fixed ones, OCTAVE in each
    octave), then within a range, where equal scores are peers: no window holds a group, and the tasks follow the counted rows.
    """
    y = F.col(label).cast("long")
    counted = stored(_counted(pred.select(F.col(group).alias("__g"), F.col(score).alias("__s"), y.alias("pos"), (1 - y).alias("neg"))), "scores").withColumn("__at", _range(F.col("__s")))
    own = W.partitionBy("__g")
    higher = own.orderBy(F.desc("__at")).rowsBetween(W.unboundedPreceding, -1)  # a row for each range that has scores, a bounded number
    ranges = counted.groupBy("__g", "__at").agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))
    above = ranges.select("__g", "__at", *[F.coalesce(F.sum(f"__{c}").over(higher), F.lit(0)).alias(f"{c}_above") for c in ("pos", "neg")], F.sum("__neg").over(own).alias("__all"))
    n = counted.count()
    dealt = counted.repartition(max(min(TASKS, n // 4096 + 1), n // RANKED), "__g", "__at").join(above, ["__g", "__at"])
    w = W.partitionBy("__g", "__at").orderBy(F.desc("__s"))
    upto = {c: F.col(f"{c}_above") + F.coalesce(F.sum(c).over(w.rangeBetween(W.unboundedPreceding, W.currentRow)), F.lit(0)) for c in ("pos", "neg")}
    ranked = dealt.withColumns({"tp": upto["pos"], "fp": upto["neg"], "tied": F.sum("neg").over(w.rangeBetween(W.currentRow, W.currentRow)), "high": (F.col("__s") >= threshold).cast("long")})
    s = lambda c: F.sum(c)
    sums = ranked.groupBy("__g").agg(
        s("pos").alias("n_pos"), s("neg").alias("n_neg"), s(F.col("pos") * (F.col("__all") - F.col("fp") + F.col("tied") / 2)).alias("u"), s(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        s(F.col("pos") * F.col("high")).alias("tp"), s(F.col("neg") * F.col("high")).alias("fp"),
    )
    return _measures(sums.withColumnRenamed("__g", group), group)


def _measures(sums: DataFrame, group: str) -> DataFrame:
    """MEASURES from class sizes, the sum of ranks (u), the sum of precisions (ap) and the hits at the threshold (tp, fp)."""
    two = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    tn, fn = F.col("n_neg") - F.col("fp"), F.col("n_pos") - F.col("tp")
    f1 = lambda hit, wrong: F.coalesce(F.try_divide(2 * hit, 2 * hit + wrong), F.lit(0.0))
    sens, spec = F.try_divide("tp", "n_pos"), F.try_divide(tn, F.col("n_neg"))
    own = lambda c: F.when(two, c)
    return sums.select(group, "n_pos", "n_neg", own(F.try_divide("u", F.col("n_pos") * F.col("n_neg"))).alias("auroc"), own(F.try_divide("ap", "n_pos")).alias("auprc"), own((f1(F.col("tp"), F.col("fp") + fn) + f1(tn, F.col("fp") + fn)) / 2).alias("macro_f1"), own(sens).alias("sensitivity"), own(spec).alias("specificity"), own((sens + spec) / 2).alias("balanced_accuracy"))


def listed_metrics(lists: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    """classifier_metrics of groups whose scores come in lists: (group, label, scores array<double>, finite), any number of lists a group;
    written, as they are read twice.

    A task ranks a group of up to LISTED scores from its sorted lists; those of larger groups become rows and are ranked by ranges.
    """
    lists = lists.select(F.col(group).alias("__of"), F.col("label").cast("int").alias("__y"), F.col("scores").alias("__s"), F.size("scores").cast("long").alias("__n"))
    sizes = lists.groupBy("__of").agg(F.sum("__n").alias("__all"))
    total, most = sizes.agg(F.sum("__all"), F.max("__all")).first()
    kind = lists.schema["__of"].dataType.simpleString()

    def measured(one: np.ndarray, score: np.ndarray) -> tuple:
        pos, neg = np.sort(score[one]), np.sort(score[~one])
        below = np.searchsorted(neg, pos, "left")
        tp, fp = len(pos) - np.searchsorted(pos, pos, "left"), len(neg) - below
        return len(pos), len(neg), float((below + np.searchsorted(neg, pos, "right")).sum()) / 2, float((tp / (tp + fp)).sum()), len(pos) - int(np.searchsorted(pos, threshold)), len(neg) - int(np.searchsorted(neg, threshold))

    def ranked(batches):
        """A group's lists come one after the other, and may go on in the next batch."""
        key, held = None, []
        found = lambda: (key, *measured(np.repeat([y == 1 for y, _ in held], [len(s) for _, s in held]), np.concatenate([s for _, s in held])))
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            out, lengths, flat = [], column(batch, "__s").value_lengths().to_numpy(), column(batch, "__s").flatten().to_numpy()
            types[0] = batch.schema.field("__of").type
            for k, y, s in zip(column(batch, "__of").to_pylist(), column(batch, "__y").to_pylist(), np.split(flat, np.cumsum(lengths))[:-1], strict=True):
                if held and k != key:
                    out.append(found())
                    held = []
                key = k
                held.append((y, s))
            held = [(y, s.copy()) for y, s in held]
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([found()])

    names, types = ["__of", "n_pos", "n_neg", "u", "ap", "tp", "fp"], [None, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    tasks = max(lists.sparkSession.sparkContext.defaultParallelism, (total or 0) // RANKED)
    small = lists
    if (most or 0) > LISTED:
        large = stored(sizes.where(F.col("__all") > LISTED).select(F.col("__of").alias("__large")), "large")
        on = lists["__of"].eqNullSafe(large["__large"])
        small = lists.join(large, on, "left_anti")
        rows = lists.join(large, on).select("__of", "__y", F.explode("__s").alias("__s"))
    sums = small.select("__of", "__y", "__s").repartition(tasks, "__of").sortWithinPartitions("__of").mapInArrow(ranked, f"__of {kind}, n_pos long, n_neg long, u double, ap double, tp long, fp long")
    found = _measures(sums, "__of")
    if (most or 0) > LISTED:
        found = found.unionByName(classifier_metrics(rows, ["__of"], "__y", "__s", threshold))
    return found.withColumnRenamed("__of", group)


def null_threshold(metrics: DataFrame, keys: list[str], value: str = "auroc", q: float = 0.95, interpolation: str = "nearest") -> DataFrame:
    """The q-quantile of control scores for each key, missing scores left out; keys without controls have no row."""
    if interpolation == "nearest":
        return nearest_quantile(metrics, value, keys, q).withColumnRenamed("quantile", "null_threshold")
    return metrics.where(~missing(F.col(value))).groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias("null_threshold"))


def with_threshold(df: DataFrame, thresholds: DataFrame, keys: list[str], default: float | None = None) -> DataFrame:
    """Left join of the thresholds, which are few: one for each channel."""
    out = df.join(thresholds, keys, "left")
    return out.withColumn("null_threshold", F.coalesce("null_threshold", F.lit(default))) if default is not None else out


def allele_summary(metrics: DataFrame, thresholds: DataFrame, max_imbalance: float = 3.0, least: int = 2) -> DataFrame:
    """Mean scores of each (pair, gene, allele, channel) with enough balanced classifiers, and whether they beat the null."""
    used = metrics.where((F.col("imbalance_ratio") <= max_imbalance) & ~F.col("is_control"))
    means = used.groupBy("pair_id", "gene", "allele_var", "channel").agg(F.avg("auroc").alias("auroc_mean"), F.stddev_samp("auroc").alias("auroc_std"), F.avg("auprc").alias("auprc_mean"), F.avg("balanced_accuracy").alias("balanced_accuracy_mean"), F.count("*").alias("n_classifiers"))
    return with_threshold(means.where(F.col("n_classifiers") >= least), thresholds, ["channel"], 0.5).withColumn("is_hit", F.col("auroc_mean") > F.col("null_threshold")).select(SUMMARY)


def wide_summary(summary: DataFrame, channels: list[str], batch: str) -> DataFrame:
    """One row for each allele; AUROC, hit and threshold columns of each channel, in order of name."""
    first = lambda c, ch: F.min(F.when(F.col("channel") == ch, F.col(c)))
    wide = [first(c, ch).alias(f"{name}_{ch}") for name, c in (("AUROC", "auroc_mean"), ("Altered_p95", "is_hit"), ("Null_p95", "null_threshold")) for ch in sorted(channels)]
    return summary.groupBy("gene", "allele_var").agg(F.lit(batch).alias("Batch"), *wide)


def single_fold_metrics(metrics: DataFrame, folds: DataFrame, suffix: str = "T4", max_imbalance: float = 3.0) -> DataFrame:
    """Metrics of the folds whose test plate ends with the suffix, in the summary's columns; threshold and hit are
    placeholders (0.5, false)."""
    chosen = folds.where(F.col("test_plate").endswith(suffix)).select("classifier_id")
    own = metrics.join(chosen, "classifier_id", "left_semi").where((F.col("imbalance_ratio") <= max_imbalance) & ~F.col("is_control"))
    return own.select("pair_id", "gene", "allele_var", "channel", F.col("auroc").alias("auroc_mean"), F.lit(None).cast("double").alias("auroc_std"), F.col("auprc").alias("auprc_mean"), F.col("balanced_accuracy").alias("balanced_accuracy_mean"), F.lit(1).cast("long").alias("n_classifiers"), F.lit(0.5).alias("null_threshold"), F.lit(False).alias("is_hit"))


def _mean_precision(df: DataFrame, keys: list[str], score: Column | str, target: str) -> DataFrame:
    """Average precision of each group over distinct scores, and how many targets it has."""
    counted = df.groupBy(*keys, score).agg(F.sum(target).alias("pos"), F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumns({"tp": F.sum("pos").over(w), "seen": F.sum("n").over(w)})
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("ap"), F.sum("pos").alias("n_pos"))


def ranking_metrics(df: DataFrame, sample: str, label: str, score: str, target: str, k: int = 5) -> DataFrame:
    """macro_ap over labels with targets (the area under the steps of the precision-recall curve, so also macro AUPRC), lrap over samples (1 for samples with none or all), hamming_top_k."""
    macro = _mean_precision(df, [label], score, target).where("n_pos > 0").agg(F.avg("ap").alias("macro_ap"), F.count("*").alias("n_labels"))
    per = _mean_precision(df, [sample], score, target)
    lrap = per.agg(F.avg(F.when(F.col("n_pos") == 0, 1.0).otherwise(F.col("ap"))).alias("lrap"), F.count("*").alias("n_samples"))
    top = df.withColumn("hit", F.row_number().over(W.partitionBy(sample).orderBy(F.desc(score), label)) <= k)
    hamming = top.agg(F.avg((F.col("hit").cast("int") == F.col(target)).cast("int")).alias("hamming_top_k"))
    return macro.crossJoin(lrap).crossJoin(hamming)  # one row each


def top_importances(df: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("importance"), "feature"))).where(F.col("rank") <= n)
