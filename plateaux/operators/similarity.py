"""Retrieval by cosine similarity: average precision of profiles, its chance level, permutation p-values, control nulls.

Rows meet in blocks under the keys that both sides must share (see ranking). Several runs (channels, leave-one-out pools)
are one job: their name is one more key column, ``run``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..functions.blocks import HELD, column
from ..sources.scratch import stored
from .order import numbered
from .ranking import Side, precision
from .stats import benjamini_hochberg


def median_profiles(df: DataFrame, keys: list[str], first: list[str] = ()) -> DataFrame:
    """Median of each feature in each group, with the smallest of some further columns."""
    long = df.select(*keys, F.posexplode("features").alias("i", "x")).groupBy(*keys, "i").agg(F.median("x").alias("m"))
    packed = long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("features"))
    if not first:
        return packed
    return packed.join(df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in first]), keys)


def sample_per_group(df: DataFrame, keys: list[str], n: int, cell: str, seed: int = 42) -> DataFrame:
    """At most n rows of each group, the first by a hash of the seed and the cell id (n <= 0: all); sampling is the feature.

    Every task keeps its own first n of a group before rows are shuffled, so a group of any size meets as n rows a task.
    """
    if n <= 0:
        return df
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(cell).cast("string")))
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order, cell))).where(F.col("__n") <= n).drop("__n")


def resolve_alleles(df: DataFrame, scope: str = "all", least: int = 50) -> DataFrame:
    """(gene_allele): variants of kind Exp or cPC with enough cells that the comma-separated scope takes in: all, exp, cpc, or
    names of alleles; unknown names are passed over."""
    words = {w.strip() for w in scope.split(",") if w.strip()}
    kinds = [k for word, k in (("exp", "Exp"), ("cpc", "cPC")) if word in words or "all" in words]
    names = sorted(words - {"all", "exp", "cpc"})
    own = df.where((F.col("node_type") == "allele") & F.col("control").isin("Exp", "cPC"))
    wanted = F.max(F.col("control").isin(*kinds).cast("int")) == 1 if kinds else F.lit(False)
    counted = own.groupBy("gene_allele").agg(F.count("*").alias("__n"), wanted.alias("__k"))
    keep = F.col("__k") | F.col("gene_allele").isin(*names) if names else F.col("__k")
    return counted.where((F.col("__n") >= least) & keep).select("gene_allele")


UNITS = ("site", "well")


def unit_profiles(df: DataFrame, alleles: DataFrame, unit: str = "site", aggregate: bool = True, per_unit: int = 20, refs_per_plate: int = 0, cell: str = "cell_id", seed: int = 42, run: list[str] = ()) -> DataFrame:
    """The pool of a retrieval run: rows of the variants and of the wild types of their genes, genes without either left out.

    ``aggregate``: the median profile of every allele (of every gene, for wild types) on a plate and ``unit``, a site or a well;
    else at most ``per_unit`` cells of each. ``refs_per_plate`` caps the wild-type rows of a plate (0: no cap), the same for
    all alleles. Columns: id, symbol, gene_allele, plate, node_type, features and ``run``; the id of a profile is made of its keys.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}; known are {UNITS}")
    run = list(run)
    own = df.select(*run, cell, "symbol", "gene_allele", "plate", unit, "node_type", "features")
    variants = own.where("node_type = 'allele'").join(alleles, [*[c for c in run if c in alleles.columns], "gene_allele"], "left_semi")
    wild = own.where("node_type = 'disease_wt'")
    genes = variants.select(*run, "symbol").distinct().join(wild.select(*run, "symbol").distinct(), [*run, "symbol"], "left_semi")
    sides = []
    for rows, name in ((variants, "gene_allele"), (wild, "symbol")):
        rows, keys = rows.join(genes, [*run, "symbol"], "left_semi"), [*run, name, "plate", unit]
        if aggregate:
            rest = [c for c in ("symbol", "gene_allele", "node_type") if c != name]
            side = median_profiles(rows, keys, rest).withColumn("id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("node_type", name, "plate", unit)]))
        else:
            side = sample_per_group(rows, keys, per_unit, cell, seed).withColumn("id", F.col(cell).cast("string"))
        sides.append(side.select(*run, "id", "symbol", "gene_allele", "plate", "node_type", "features"))
    return sides[0].unionByName(sample_per_group(sides[1], [*run, "plate"], refs_per_plate, "id", seed))


def reference_index(df: DataFrame, is_reference: Column, order: list[str]) -> DataFrame:
    """reference_index: 0, 1, ... over reference rows, -1 for the others."""
    ref = numbered(df.where(is_reference), order, "reference_index")
    return ref.unionByName(df.where(~F.coalesce(is_reference, F.lit(False))).withColumn("reference_index", F.lit(-1).cast("long")))


def average_precision(pool: DataFrame, row: str, pos_same: list[str], pos_differ: list[str], neg_same: list[str], neg_differ: list[str], run: list[str] = (), keep: list[str] = (), queries: Column | None = None) -> DataFrame:
    """For every query row: n_pos, n_total, ap (null without positives), with the columns in ``keep``.

    Partners share the ``same`` keys and differ in each of the ``differ`` keys; ``queries`` picks rows to be ranked for.
    """
    used = list(dict.fromkeys([*pos_same, *pos_differ, *neg_same, *neg_differ, *run]))
    base = stored(pool.select(F.col(row).alias("id"), *[c for c in used if c != row], *[k for k in keep if k not in used and k != row], F.col("features").cast("array<double>").alias("features"), *([queries.alias("__asked")] if queries is not None else [])), "pool")
    asked = base.where("__asked") if queries is not None else base
    found = precision(asked, base, Side(pos_same, pos_differ), Side(neg_same, neg_differ), run).drop("label")
    return found.join(asked.select("id", *run, *[k for k in keep if k not in run]), ["id", *run]).withColumnRenamed("id", row)


def chance_level(n_total: Column, n_pos: Column) -> Column:
    """Expected average precision under a random order: (H_N + (M - 1)(N - H_N) / (N - 1)) / N."""
    n, m = n_total.cast("double"), n_pos.cast("double")
    harmonic = F.aggregate(F.sequence(F.lit(1), n_total.cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    return F.when(n_total == n_pos, 1.0).otherwise((harmonic + (m - 1) / (n - 1) * (n - harmonic)) / n)


def normalized(ap: DataFrame) -> DataFrame:
    """ap_norm = (ap - e) / (1 - e); 0 where chance is 1, null without positives."""
    e = ap.where("n_pos > 0").select("n_total", "n_pos").distinct().withColumn("__e", chance_level(F.col("n_total"), F.col("n_pos")))
    score = F.when(F.col("__e") >= 1, 0.0).otherwise((F.col("ap") - F.col("__e")) / (1 - F.col("__e")))
    return ap.join(e, ["n_total", "n_pos"], "left").withColumn("ap_norm", F.when(F.col("ap").isNotNull(), score)).drop("__e")  # a row for each pair of counts


def null_aps(n_pos: int, n_total: int, size: int, seed: int) -> np.ndarray:
    """Average precisions of ``size`` random orders, from a counter-based stream that the seed and the two counts name.

    Only the places of the positives are drawn, without replacement.
    """
    r = np.random.Generator(np.random.Philox(key=[seed & _MASK, (n_pos << 32 ^ n_total) & _MASK]))
    out = np.empty(size)
    step = max(1, NULL_BLOCK // max(1, n_total if 4 * n_pos >= n_total else n_pos))
    for k in range(0, size, step):
        n = min(step, size - k)
        if n_pos == n_total:
            hits = np.broadcast_to(np.arange(n_total), (n, n_total))
        elif 4 * n_pos >= n_total:
            hits = np.sort(r.random((n, n_total)).argpartition(n_pos - 1, 1)[:, :n_pos], 1)
        else:  # few places: draw again where two agree
            hits = np.sort(r.integers(0, n_total, (n, n_pos)), 1)
            while len(again := np.flatnonzero((hits[:, 1:] == hits[:, :-1]).any(1))):
                hits[again] = _redrawn(hits[again], n_total, r)
        out[k:k + n] = (np.arange(1, n_pos + 1) / (hits + 1)).mean(1)
    return out


def _redrawn(hits: np.ndarray, n_total: int, r: np.random.Generator) -> np.ndarray:
    """Rows with repeats: each later copy of a place is drawn anew, the places that stand keep theirs."""
    same = np.zeros(hits.shape, bool)
    same[:, 1:] = hits[:, 1:] == hits[:, :-1]
    hits = np.where(same, r.integers(0, n_total, hits.shape), hits)
    return np.sort(hits, 1)


_MASK, NULL_BLOCK = (1 << 64) - 1, 1 << 22


def _p_values(groups: DataFrame, null_size: int, seed: int) -> DataFrame:
    """p_value beside each group's mAP: a task draws the null of a configuration once, adds the arrays of a group's
    configurations and counts in one step; nulls are never rows. ``configs`` and ``mAP`` are used up by the count."""
    def run(batches):
        drawn = lru_cache(max(1, HELD // (8 * null_size)))(lambda p, n: null_aps(p, n, null_size, seed))
        for batch in batches:
            p = []
            for score, configs in zip(column(batch, "mAP").to_pylist(), column(batch, "configs").to_pylist(), strict=True):
                total = sum(c["w"] for c in configs)
                null = sum(drawn(c["n_pos"], c["n_total"]) * (c["w"] / total) for c in sorted(configs, key=lambda c: (c["n_pos"], c["n_total"])))
                p.append((int((null >= score - 1e-12).sum()) + 1) / (null_size + 1))  # sums of equal parts may differ in their last bits
            rest = {c: column(batch, c) for c in batch.schema.names if c != "configs"}
            yield pa.record_batch(rest | {"p_value": pa.array(p, pa.float64())})

    schema = StructType([f for f in groups.schema.fields if f.name != "configs"]).add("p_value", "double")
    spread = groups.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(F.sort_array("configs")))  # equal ones share a task
    return spread.mapInArrow(run, schema)


def mean_average_precision(ap: DataFrame, group: list[str], null_size: int = 10_000, threshold: float = 0.05, seed: int = 42, scope: list[str] = ()) -> DataFrame:
    """mAP, its normalised form, permutation p, corrected p within the scope, and flags, of each group.

    The null of a group is the mean of null arrays over its queries' (n_pos, n_total), weighted by how many queries have them.
    """
    used = normalized(ap).where("ap is not null")
    parts = used.groupBy(*group, "n_pos", "n_total").agg(F.count("*").alias("w"), F.sum("ap").alias("__a"), F.sum("ap_norm").alias("__b"))
    means = parts.groupBy(*group).agg((F.sum("__a") / F.sum("w")).alias("mAP"), (F.sum("__b") / F.sum("w")).alias("mAP_norm"), F.sum("w").alias("n_queries"), F.collect_list(F.struct("n_pos", "n_total", "w")).alias("configs"))
    out = benjamini_hochberg(_p_values(means, null_size, seed), "p_value", list(scope), group)
    return out.withColumns({"below_p": F.col("p_value") < threshold, "below_corrected_p": F.col("corrected_p_value") < threshold})


# ---------------------------------------------------------------- activity against references, and its control null

VS_REF = {"pos_same": ["gene_allele"], "pos_differ": ["plate"], "neg_same": ["plate", "symbol"], "neg_differ": ["node_type"]}


def activity_ap(pool: DataFrame, row: str, run: list[str] = (), held_out: str | None = None) -> DataFrame:
    """AP of variant rows: positives are the same allele on other plates, negatives the gene's other node types on its plate.

    ``held_out``: a plate suffix; only queries on such plates are kept, against the whole pool.
    """
    queries = F.col("node_type") == "allele"
    if held_out:
        queries = queries & F.col("plate").endswith(held_out)
    return average_precision(pool, row, **VS_REF, run=list(run), keep=["gene_allele", "plate"], queries=queries)


def without_orphans(pool: DataFrame) -> DataFrame:
    """Only genes with cells of both the wild type and a variant."""
    both = pool.groupBy("symbol").agg(F.countDistinct("node_type").alias("n")).where("n > 1").select("symbol")
    return pool.join(both, "symbol", "left_semi")


def slices(df: DataFrame, channels: dict[str, tuple[int, int]]) -> DataFrame:
    """One row for each channel, with that slice of the features."""
    parts = F.array(*[F.struct(F.lit(c).alias("channel"), F.slice("features", a + 1, n).alias("features")) for c, (a, n) in channels.items()])
    return df.withColumn("__s", F.explode(parts)).select(*[c for c in df.columns if c != "features"], "__s.channel", "__s.features")


def loo_groups(df: DataFrame, least_cells: int = 50, least_wells: int = 3) -> DataFrame:
    """Wells with enough cells of control alleles (NC, PC) that have enough such wells on one platemap."""
    wells = df.where(F.col("control").isin("NC", "PC")).groupBy("gene_allele", "platemap", "well").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= least_cells)
    enough = wells.groupBy("gene_allele", "platemap").agg(F.count("*").alias("n_wells")).where(F.col("n_wells") >= least_wells)
    return wells.join(enough, ["gene_allele", "platemap"])


def loo_pool(profiles: DataFrame, groups: DataFrame) -> DataFrame:
    """Every well in turn as a pseudo-variant against the group's other wells; ``loo_id`` names the run."""
    turns = groups.select(F.col("gene_allele").alias("__a"), F.col("platemap").alias("__m"), F.col("well").alias("__w"))
    own = profiles.join(groups.select("gene_allele", "platemap", "well"), ["gene_allele", "platemap", "well"], "left_semi")
    rows = own.join(turns, (F.col("gene_allele") == F.col("__a")) & (F.col("platemap") == F.col("__m")))
    variant, name = F.col("well") == F.col("__w"), F.concat_ws("__", "__a", "__m", "__w")
    return rows.withColumns({"loo_id": name, "symbol": name, "gene_allele": F.when(variant, name).otherwise(F.col("gene_allele")), "node_type": F.when(variant, "allele").otherwise("disease_wt")}).drop("__a", "__m", "__w")


def null_thresholds(null: DataFrame, keys: list[str], q: float = 0.95, value: str = "mAP_norm") -> DataFrame:
    return null.groupBy(*keys).agg(F.percentile(value, F.lit(q)).alias("null_threshold_p95"))


def hits(results: DataFrame, thresholds: DataFrame, keys: list[str], value: str = "mAP_norm") -> DataFrame:
    return results.join(thresholds, keys, "left").withColumn("is_hit", F.coalesce(F.col(value) > F.col("null_threshold_p95"), F.lit(False)))
