"""Feature selection: blocklist, variance threshold, correlation threshold, channels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import column, finite, matrix
from ..functions.stats import present
from ..sources.scratch import stored
from .contract import long_form, take_features, union_all
from .moments import moments

#: Patterns of names that are never used.
BLOCKED_PATTERNS = ("_Neighbors_",)


def feature_dictionary(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "feature_id int, name string")


def blocked(dictionary: DataFrame, patterns: tuple[str, ...] = BLOCKED_PATTERNS, listed: tuple[str, ...] = ()) -> DataFrame:
    """Entries of the dictionary that a pattern or the list names."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col("name").contains(p)
    return dictionary.where(hit | F.col("name").isin(*listed) if listed else hit)


def apply_blocklist(df: DataFrame, names: list[str], patterns: tuple[str, ...] = BLOCKED_PATTERNS, listed: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    return take_features(df, names, [n for n in names if not any(p in n for p in patterns) and n not in listed])


def value_concentration(df: DataFrame, names: list[str]) -> DataFrame:
    """feature, freq_ratio (second most common value to most common; 0 if there is one value), unique_ratio.

    Counts are taken by feature and value, then by feature and count: what meets in one row for a feature are the different
    counts that its values have, at most about the square root of twice the cells.
    """
    values = long_form(df, names).withColumn("value", present(F.col("value"))).where("value is not null")
    counts = values.groupBy("feature", "value").agg(F.count("*").alias("n")).groupBy("feature", "n").agg(F.count("*").alias("m"))
    top = counts.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("n", "m")), False).alias("c"), F.sum("m").alias("values"), F.sum(F.col("n") * F.col("m")).alias("rows"))
    first, second = F.col("c")[0], F.get("c", F.lit(1))
    common = F.when(first["m"] > 1, first["n"]).otherwise(F.coalesce(second["n"], F.lit(0)))
    return top.select("feature", (common / first["n"]).alias("freq_ratio"), (F.col("values") / F.col("rows")).alias("unique_ratio"))


def variance_threshold(df: DataFrame, names: list[str], freq_cut: float = 0.05, unique_cut: float = 0.01) -> DataFrame:
    """feature, freq_ratio, unique_ratio, kept."""
    return value_concentration(df, names).withColumn("kept", (F.col("freq_ratio") >= freq_cut) & (F.col("unique_ratio") >= unique_cut))


def prefilter(df: DataFrame, names: list[str], freq_cut: float = 0.05, unique_cut: float = 0.01) -> tuple[DataFrame, list[str]]:
    """Blocklist, then variance threshold."""
    df, names = apply_blocklist(df, names)
    return take_features(df, names, [r["feature"] for r in variance_threshold(df, names, freq_cut, unique_cut).where("kept").collect()])  # names


PANEL = 96 << 20  # bytes of the products that a task sums


def _products(df: DataFrame, means: np.ndarray, gaps: np.ndarray, rows: range) -> DataFrame:
    """(i, v) for the features in ``rows``: sums over all cells of the centred feature i times every feature, then what the
    cells with missing values take away from them, in the order of _pearson. A task sums its cells into one panel."""
    width, lost = len(means), len(gaps)

    def run(batches):
        total = None
        for batch in batches:
            x, here = finite(matrix(column(batch, "features"), width))
            x = np.where(here, x - means, 0.0)
            part = x[:, rows.start:rows.stop]
            away = (~here[:, gaps]).astype(float)
            own = (~here[:, rows.start:rows.stop]).astype(float) if lost else np.zeros((len(x), len(rows)))
            sums = [part.T @ x, part.T @ away, (part**2).T @ away, own.T @ away] + ([own.T @ x, own.T @ x**2] if lost else [])
            total = sums if total is None else [a + b for a, b in zip(total, sums, strict=True)]
        if total is not None:
            both = np.concatenate(total, 1)
            for low in range(0, len(rows), 256):
                piece = np.ascontiguousarray(both[low:low + 256])
                ends = np.arange(len(piece) + 1, dtype=np.int32) * piece.shape[1]
                yield pa.record_batch({"i": pa.array(np.arange(rows.start + low, rows.start + low + len(piece), dtype=np.int32)), "v": pa.ListArray.from_arrays(ends, piece.ravel())})

    # fewer, larger sums leave the tasks; each is one array a feature
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.select("features").coalesce(tasks).mapInArrow(run, "i int, v array<double>")


def _pearson(i: int, v: np.ndarray, n: int, m2: np.ndarray, missing: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Correlations of feature i with every feature, over the cells that have both; NaN where either is constant there."""
    p, g = len(m2), len(gaps)
    cut = np.cumsum([p, g, g, g, p, p])
    both = v[:p]
    spread = lambda part: np.bincount(gaps, part, p) if g else np.zeros(p)
    mine, mine2, gone = (spread(v[a:b]) for a, b in zip(cut[:3], cut[1:4], strict=True))
    other, other2 = (v[cut[3]:cut[4]], v[cut[4]:cut[5]]) if g else (np.zeros(p), np.zeros(p))
    count = n - missing[i] - missing + gone
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = both - mine * other / count
        a, b = m2[i] - mine2 - mine**2 / count, m2 - other2 - other**2 / count
        r = np.clip(cov / np.sqrt(a * b), -1, 1)
    return np.where((a > 1e-13 * m2[i]) & (b > 1e-13 * m2) & (count > 0), r, np.nan)


def _correlation_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """(i, r): one row a feature, an array of its correlations with all features in order of names, NaN where there is none;
    no rows of an empty table.

    Two passes: means, then products of the centred features as matrix products of batches. Tasks hold sums, not pairs as
    columns or rows, in panels of at most PANEL bytes; sums of one feature meet by addition.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    p = len(names)
    found = sorted(moments(df, p).collect(), key=lambda r: r["i"])  # a row for each feature
    if not found:
        return df.sparkSession.createDataFrame([], "i int, r array<double>")
    get = lambda c: np.array([r[c] if r[c] is not None else 0.0 for r in found], float)
    means, missing, n = get("mean"), get("n_missing"), int(found[0]["n"] + found[0]["n_missing"])
    m2 = np.where(get("min") == get("max"), 0.0, get("m2"))
    gaps = np.flatnonzero(missing > 0)
    size = max(1, PANEL // (8 * (3 * p + 3 * len(gaps) if len(gaps) else p)))
    parts = [_products(df, means, gaps, range(low, min(p, low + size))) for low in range(0, p, size)]
    sums = union_all(parts).groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("v")))).alias("v"))

    def rows(batches):
        for batch in batches:
            for i, v in zip(column(batch, "i").to_pylist(), column(batch, "v"), strict=True):
                r = _pearson(i, v.values.to_numpy(), n, m2, missing, gaps)
                yield pa.record_batch({"i": pa.array([i], pa.int32()), "r": pa.ListArray.from_arrays(pa.array([0, p], pa.int32()), r)})

    return sums.mapInArrow(rows, "i int, r array<double>")


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) for all ordered pairs of features: Pearson over the cells that have both, null where either is constant."""
    p = len(names)

    def pairs(batches):
        labels = pa.array(names)
        for batch in batches:
            for i, r in zip(column(batch, "i").to_pylist(), column(batch, "r"), strict=True):
                other = np.delete(np.arange(p), i)
                own = r.values.to_numpy()[other]
                yield pa.record_batch({"a": pa.array([names[i]] * (p - 1), pa.string()), "b": labels.take(pa.array(other)), "r": pa.array(own, mask=np.isnan(own))})

    return _correlation_rows(df, names).mapInArrow(pairs, "a string, b string, r double")


def correlated(df: DataFrame, names: list[str], limit: float = 0.9) -> DataFrame:
    """feature, total_abs_corr, dropped: of each pair above the limit the one that correlates more with all others goes (the
    sums are compared to nine digits), the later name on ties. A feature is one row of an array; pairs never are."""
    def total(batches):
        for batch in batches:
            for i, r in zip(column(batch, "i").to_pylist(), column(batch, "r"), strict=True):
                yield pa.record_batch({"i": pa.array([i], pa.int32()), "total": pa.array([float(np.nansum(np.abs(np.delete(r.values.to_numpy(), i))))])})

    rows = stored(_correlation_rows(df, names), "correlations")
    totals = {r["i"]: r["total"] for r in rows.mapInArrow(total, "i int, total double").collect()}  # a number for each feature
    exact = np.array([totals.get(i, 0.0) for i in range(len(names))])
    sums, place = np.round(exact, 9), np.argsort(np.argsort(np.array(names, object)))

    def drop(batches):
        for batch in batches:
            for i, r in zip(column(batch, "i").to_pylist(), column(batch, "r"), strict=True):
                near = np.abs(np.nan_to_num(r.values.to_numpy())) > limit
                near[i] = False
                worse = (sums[i] > sums) | (sums[i] == sums) & (place[i] > place)
                yield pa.record_batch({"feature": pa.array([names[i]]), "total_abs_corr": pa.array([float(exact[i])]), "dropped": pa.array([bool((near & worse).any())])})

    return rows.mapInArrow(drop, "feature string, total_abs_corr double, dropped boolean")


def decorrelate(df: DataFrame, names: list[str], limit: float = 0.9, channel_aware: bool = True) -> tuple[DataFrame, list[str]]:
    """Correlated features go, apart for names with GFP and the others if ``channel_aware``."""
    groups = [[n for n in names if "GFP" in n], [n for n in names if "GFP" not in n]] if channel_aware else [names]
    gone: set[str] = set()
    for group in groups:
        own, _ = take_features(df, names, group)
        gone |= {r["feature"] for r in correlated(own, group, limit).where("dropped").collect()}  # names
    return take_features(df, names, [n for n in names if n not in gone])


# ---------------------------------------------------------------- channels

STAINS = ("DNA", "AGP", "Mito")


def channels_of(name: str, layout: str = "profiler") -> list[str]:
    """The channels of a feature, by its name alone. Layouts:

    profiler: GFP or Morph, the stains named (not for GFP features), and ALL; intensity: the mean intensities of cells only,
    stains also in Morph; counts: count; histogram: global or spectrum by prefix, and combined; patches: the second part of
    the name, stains also in Morph, and ALL; anything else: EMBED.
    """
    low = name.lower()
    if layout == "profiler":
        if "_gfp" in low:
            return ["GFP", "ALL"]
        return ["Morph", "ALL", *(s for s in STAINS if f"_{s.lower()}" in low)]
    if layout == "intensity":
        own = [c for c in ("GFP", *STAINS) if name == f"Cells_Intensity_MeanIntensity_{c}"]
        return own + (["Morph"] if own and own[0] in STAINS else [])
    if layout == "counts":
        return ["count"]
    if layout == "histogram":
        return ["combined", *(g for g in ("global", "spectrum") if f"_{g}_" in low)]
    if layout == "patches":
        part = name.split("_", 2)
        own = next((c for c in ("GFP", *STAINS) if len(part) > 2 and part[1].lower() == c.lower()), part[1] if len(part) > 2 else None)
        return [*([own] if own else []), *(["Morph"] if own in STAINS else []), "ALL"]
    return ["EMBED"]


def channel_map(spark: SparkSession, names: list[str], layout: str = "profiler") -> DataFrame:
    """(channel, feature_id, name), from the dictionary alone."""
    rows = [(c, i, n) for i, n in enumerate(names) for c in channels_of(n, layout)]
    if layout == "patches" and len({c for c, _, _ in rows} - {"ALL", "Morph"}) < 2:
        rows = [("EMBED", i, n) for i, n in enumerate(names)]  # a single channel has no groups
    return spark.createDataFrame(rows, "channel string, feature_id int, name string")


def restrict_channels(found: DataFrame, wanted: list[str]) -> DataFrame:
    known = {r["channel"] for r in found.select("channel").distinct().collect()}  # a handful of names
    if unknown := set(wanted) - known:
        raise ValueError(f"unknown channels {sorted(unknown)}; known are {sorted(known)}")
    return found.where(F.col("channel").isin(*wanted))


def channel_slice(df: DataFrame, names: list[str], channel: str, layout: str = "profiler") -> tuple[DataFrame, list[str]]:
    return take_features(df, names, [n for n in names if channel in channels_of(n, layout)])
