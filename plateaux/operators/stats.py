"""Rank-sum tests, false-discovery control, effect tables, histograms, correlations and principal components."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import constant, missing
from .moments import moments

EXACT, EXACT_CELLS = 8, 20_000  # smallest arm, and product of the arms, up to which the exact distribution is used without ties


def exact_tails(n: int, m: int) -> np.ndarray:
    """Two-sided p of U = 0, 1, ... nm / 2 from the exact distribution: coefficients of the Gaussian binomial, one factor
    (1 - q^(m + k)) / (1 - q^k) after the other."""
    size = n * m + 1
    ways = np.zeros(size)
    ways[0] = 1
    for k in range(1, n + 1):
        if m + k < size:
            ways[m + k:] -= ways[:size - m - k].copy()
        for start in range(k):  # division by 1 - q^k: running sums along every k-th
            ways[start::k] = np.cumsum(ways[start::k])
    return np.minimum(1.0, 2 * np.cumsum(ways[:n * m // 2 + 1]) / ways.sum())


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of numbers from 0 on: its series up to 1.8, its continued fraction beyond."""
    x = np.asarray(x, float)
    low = np.minimum(x, 1.8)
    term = total = low * 1.0
    for k in range(1, 60):
        term = term * 2 * low**2 / (2 * k + 1)
        total = total + term
    near = 1 - 2 / math.sqrt(math.pi) * np.exp(-low**2) * total
    high = np.maximum(x, 1.8)
    fraction = np.zeros_like(high)
    for k in range(200, 0, -1):
        fraction = k / 2 / (high + fraction)
    return np.where(x < 1.8, near, np.exp(-high**2) / math.sqrt(math.pi) / (high + fraction))


def _p_values(sums: DataFrame) -> DataFrame:
    """Two-sided p beside U: small arms without ties look it up in the table of their sizes, made once for each pair of sizes;
    the others go by the normal distribution with the tie term and a continuity correction."""
    small = (F.least("n_a", "n_b") <= EXACT) & (F.col("ties") == 0) & (F.col("n_a") * F.col("n_b") <= EXACT_CELLS)
    sizes = sums.where(small).select("n_a", "n_b").distinct()

    def tables(batches):
        for b in batches:
            pairs = zip(b["n_a"].astype(int), b["n_b"].astype(int), strict=True)
            yield b.assign(__tail=[exact_tails(*sorted(p)) for p in pairs])

    def normal(batches):
        for b in batches:
            n, m, ties, u = (b[c].to_numpy(float) for c in ("n_a", "n_b", "ties", "u"))
            s = n + m
            var = n * m / 12 * (s + 1 - ties / (s * (s - 1)))
            z = np.maximum(np.abs(u - n * m / 2) - 0.5, 0) / np.sqrt(np.where(var > 0, var, 1.0))
            yield b.assign(__far=np.where(var > 0, np.minimum(1.0, erfc(z / math.sqrt(2))), 1.0))

    exact = sizes.mapInPandas(tables, "n_a long, n_b long, __tail array<double>")
    far = sums.where(~small).select("n_a", "n_b", "ties", "u").distinct().mapInPandas(normal, "n_a long, n_b long, ties long, u double, __far double")
    at = F.floor(F.least("u", F.col("n_a") * F.col("n_b") - F.col("u"))).cast("int")
    found = sums.join(exact, ["n_a", "n_b"], "left").join(far, ["n_a", "n_b", "ties", "u"], "left")
    return found.withColumn("p_value", F.when(small, F.get("__tail", at)).otherwise(F.col("__far"))).select(*sums.columns, "p_value")


def rank_sums(df: DataFrame, keys: list[str], value: str, group: Column | str) -> DataFrame:
    """For each key: n, mean and median of the arms a and b (by ``group``), U of a, z, and the tie term.

    Values are counted first, so windows run over distinct values; missing values are left out.
    """
    used = df.withColumn("__g", F.col(group) if isinstance(group, str) else group).where(F.col("__g").isin("a", "b") & ~missing(F.col(value)))
    counted = used.groupBy(*keys, value).agg(F.sum((F.col("__g") == "a").cast("long")).alias("a"), F.sum((F.col("__g") == "b").cast("long")).alias("b"))
    below = F.coalesce(F.sum("b").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = F.col("a") + F.col("b")
    tests = counted.withColumn("below", below).groupBy(*keys).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)).alias("u"), F.sum(t * t * t - t).alias("ties"))
    arm = lambda f, g: f(F.when(F.col("__g") == g, F.col(value)))
    moments = used.groupBy(*keys).agg(*[arm(f, g).alias(f"{n}_{g}") for n, f in (("mean", F.avg), ("median", F.median)) for g in "ab"])
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    s = n + m
    var = n * m / 12 * (s + 1 - F.try_divide(F.col("ties"), s * (s - 1)))
    z = F.try_divide(F.col("u") - n * m / 2, F.sqrt(var))
    return tests.join(moments, keys).withColumn("z", z)


def rank_sum_tests(df: DataFrame, keys: list[str], value: str, group: Column | str, least: int = 2) -> DataFrame:
    """rank_sums with a two-sided p-value, for keys with enough in both arms."""
    sums = rank_sums(df, keys, value, group).where((F.col("n_a") >= least) & (F.col("n_b") >= least))
    return _p_values(sums)


OCTAVE = 256  # ranges of p-values in each octave


def benjamini_hochberg(df: DataFrame, p: str, scope: list[str], tie: list[str] = (), out: str = "corrected_p_value") -> DataFrame:
    """Adjusted p-values within each scope: p n / rank, made monotone from the largest, at most 1; null for a null p.

    Equal p-values share the rank of their last, so counts by scope and p say all, and ``tie`` is of no effect. Running sums
    and minima go over ranges of p (fixed ones, OCTAVE in each octave) and then within a range: no window holds a scope.
    """
    keys = list(scope)
    names = [f"__s{i}" for i in range(len(keys))]
    at = F.when(F.col("__p") <= 0, F.lit(-(1 << 20))).otherwise(F.floor(F.log2(F.when(F.col("__p") > 0, F.col("__p"))) * OCTAVE)).cast("int")
    own = df.where(F.col(p).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(p).alias("__p")).agg(F.count("*").alias("__c")).withColumn("__at", at)
    over, inside = W.partitionBy(*names) if names else W.partitionBy(F.lit(0)), W.partitionBy(*names, "__at")

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        """``right``, a row for each scope and range, beside the rows of its range."""
        other = right.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("__at").alias("__at_"), *[c for c in right.columns if c not in (*names, "__at")])
        on = [F.col("__at") == F.col("__at_"), *[F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]]
        return left.join(other, on).drop("__at_", *[f"{n}_" for n in names])

    # windows over ranges: a row for each that has values, a bounded number
    ranges = own.groupBy(*names, "__at").agg(F.sum("__c").alias("__r"))
    before = F.coalesce(F.sum("__r").over(over.orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = beside(own, ranges.withColumns({"__before": before, "__n": F.sum("__r").over(over)}).drop("__r"))
    raw = placed.withColumn("__raw", F.col("__p") * F.col("__n") / (F.col("__before") + F.sum("__c").over(inside.orderBy("__p"))))
    after = F.min("__low").over(over.orderBy(F.desc("__at")).rowsBetween(W.unboundedPreceding, -1))
    lows = raw.groupBy(*names, "__at").agg(F.min("__raw").alias("__low")).withColumn("__after", after).drop("__low")
    least = F.min("__raw").over(inside.orderBy(F.desc("__p")).rowsBetween(W.unboundedPreceding, 0))
    adjusted = beside(raw.withColumn("__least", least), lows).select(*names, "__p", F.least("__least", "__after", F.lit(1.0)).alias(out))
    on = [F.col(p) == F.col("__p"), *[F.col(c).eqNullSafe(F.col(n)) for c, n in zip(keys, names, strict=True)]]
    return df.join(adjusted, on, "left").drop("__p", *names)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def effect_table(tests: DataFrame, statistic: str = "median", p: str = "corrected_p_value") -> DataFrame:
    """Difference of the arms' medians or means, and stars."""
    return tests.withColumns({"effect": F.col(f"{statistic}_a") - F.col(f"{statistic}_b"), "stars": stars(F.col(p))})


def score_correlation(scores: DataFrame, left: Column, right: Column, key: str, value: str, groups: list[str]) -> DataFrame:
    """Pearson r over keys that both slices have, in each group; null with two or fewer."""
    a = scores.where(left).select(key, *groups, F.col(value).alias("__x"))
    b = scores.where(right).select(key, F.col(value).alias("__y"))
    return a.join(b, key).groupBy(*groups).agg(F.count("*").alias("n"), F.when(F.count("*") > 2, F.corr("__x", "__y")).alias("r"))


def histogram(df: DataFrame, value: str, keys: list[str], bins: int = 39, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Count and density in equal bins of [low, high] for each key; the last bin holds its upper end, others are left out."""
    used = df.where((F.col(value) >= low) & (F.col(value) <= high))
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counted = used.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    return counted.withColumn("density", F.col("n") / (total * width))


def principal_components(df: DataFrame, k: int = 2) -> DataFrame:
    """The packed features projected on the first components; each component's largest loading is positive. No rows of no rows."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    keys = [c for c in df.columns if c != "features"]
    first = df.select(F.size("features").alias("n")).first()
    if first is None:
        return df.select(*keys, *[F.lit(0.0).alias(f"{name}{i + 1}") for name in ("pc", "explained") for i in range(k)])
    # centred, so that the projection is of deviations
    mean = np.array([r["mean"] for r in sorted(moments(df, first["n"]).collect(), key=lambda r: r["i"])])  # a row for each feature
    centred = df.withColumn("__x", array_to_vector(F.zip_with("features", constant([float(m) for m in mean], "double"), lambda x, m: x - m)))
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(centred)
    loads = model.pc.toArray()
    sign = np.sign(loads[np.abs(loads).argmax(0), range(k)])
    pc = vector_to_array("__pc")
    return model.transform(centred).select(*keys, *[(pc[i] * float(sign[i])).alias(f"pc{i + 1}") for i in range(k)], *[F.lit(float(model.explainedVariance[i])).alias(f"explained{i + 1}") for i in range(k)])
