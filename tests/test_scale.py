"""Operators that work by blocks, ranges and sums, against plain versions; nulls, ties, hot groups and thousands of features."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plateaux.operators import normalize, qc, quantiles, ranking, select, similarity, stats
from plateaux.operators.contract import PLATE
from plateaux.operators.moments import feature_moments, moments
from plateaux.operators.order import numbered

NAN = math.nan


def test_positions_under_a_global_order(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, "x", k % 3) for k in range(1000)] + [(5, "x", 9)] * 20, "v int, position2 string, __at int").repartition(7)
    got = sorted(tuple(r) for r in numbered(df, [F.desc("v"), "__at"], "position", 1).select("position", "v", "__at").collect())
    assert [g[0] for g in got] == list(range(1, 1021)) and [g[1:] for g in got] == sorted([(g[1], g[2]) for g in got], key=lambda x: (-x[0], x[1]))
    assert numbered(df.limit(0), ["v"]).collect() == []


def test_integers_in_the_order_of_doubles():
    x = np.array([-np.finfo(float).max, -1.5, -1e-320, -0.0, 0.0, 1e-320, 1.0, np.finfo(float).max])
    k = quantiles.ordered(x)
    assert (np.diff(k) >= 0).all() and k[3] == k[4] and np.array_equal(quantiles.unordered(k), x)


def test_ranges_of_the_widest_bracket():
    lo, hi = quantiles.ordered(np.array([-np.finfo(float).max])), quantiles.ordered(np.array([np.finfo(float).max]))
    k = quantiles.ordered(np.array([-np.inf, -1e308, 0.0, 1e308, np.inf]))
    at = quantiles._ranges(k, np.repeat(lo, 5), np.repeat(hi, 5), 9)
    assert (np.diff(at) >= 0).all() and at[0] == 0 and at[-1] == 513 and 0 < at[1] < at[2] < at[3] <= 512


def test_medians_and_mads_of_hard_columns(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "gathered_of", lambda width: 4)  # so that several passes are needed
    monkeypatch.setattr(quantiles, "ranges_of", lambda width: 3)
    r = np.random.default_rng(0)
    data, rows = {}, []
    for g, n in (("a", 900), ("b", 8), ("c", 1)):
        m = np.stack([r.normal(size=n), r.integers(0, 2, n).astype(float), np.full(n, NAN), np.full(n, 2.5), r.standard_cauchy(n), r.lognormal(0, 9, n), r.normal(1e9, 1e-3, n)], 1)
        m[r.random(m.shape) < 0.05], m[r.random(m.shape) < 0.02] = NAN, np.inf
        data[g] = m
        rows += [(g, [None if np.isnan(v) and r.random() < 0.5 else float(v) for v in row]) for row in m]
    df = spark.createDataFrame([*rows, (None, [1.0] * 7)], "g string, features array<double>").repartition(3)
    got = {(x["group"], x["i"]): x for x in quantiles.medians_and_mads(df, 7, "g").collect()}
    assert len(got) == 21
    for g, m in data.items():
        for i in range(7):
            v, x = m[np.isfinite(m[:, i]), i], got[g, i]
            want = (len(v), v.min(), v.max(), np.median(v), np.median(abs(v - np.median(v)))) if len(v) else (0, None, None, None, None)
            assert (x["n"], x["min"], x["max"], x["median"], x["mad"]) == want
    assert quantiles.medians_and_mads(df.limit(0), 7, "g").collect() == []


def test_moments_by_group(spark):
    r = np.random.default_rng(1)
    m = r.normal(1e6, 1, (400, 3))
    m[r.random(m.shape) < 0.1] = NAN
    df = spark.createDataFrame([("x" if k % 3 else None, [float(v) for v in row]) for k, row in enumerate(m)], "g string, features array<double>").repartition(6)
    for x in moments(df, 3, F.col("g")).collect():
        own = m[[bool(k % 3) == (x["group"] is not None) for k in range(400)], x["i"]]
        v = own[np.isfinite(own)]
        assert (x["n"], x["n_missing"]) == (len(v), len(own) - len(v)) and x["mean"] == pytest.approx(v.mean()) and x["m2"] == pytest.approx(((v - v.mean()) ** 2).sum(), rel=1e-6)
    assert {(r["feature"], r["n"]) for r in feature_moments(df.limit(0), ["a", "b", "c"]).collect()} == {("a", 0), ("b", 0), ("c", 0)}


@pytest.mark.parametrize("gaps,panel", [(False, 1 << 20), (True, 1 << 20), (True, 200)])
def test_correlations_over_common_cells(spark, monkeypatch, gaps, panel):
    monkeypatch.setattr(select, "PANEL", panel)
    r = np.random.default_rng(0)
    m = r.normal(1e6, 1, (300, 7))
    m[:, 1], m[:, 2] = m[:, 0] * 2 + r.normal(size=300) * 0.1, 3.0
    if gaps:
        m[r.random(m.shape) < 0.2] = NAN
        m[:150, 5], m[150:, 6], m[3, 0] = NAN, NAN, np.inf
    df = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in row],) for row in m], "features array<double>").repartition(3)
    got = {(x["a"], x["b"]): x["r"] for x in select.correlations(df, list("abcdefg")).collect()}
    assert len(got) == 42
    for i, j in itertools.permutations(range(7), 2):
        both = np.isfinite(m[:, i]) & np.isfinite(m[:, j])
        x, y = m[both, i], m[both, j]
        known = len(x) > 1 and x.std() > 0 and y.std() > 0
        assert got["abcdefg"[i], "abcdefg"[j]] == (pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-8) if known else None)


def test_three_thousand_features(spark):
    names = [f"f{i}" for i in range(3000)]
    wave = F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.sin(F.col("id") * (F.floor(i / 2) + 1.0)) + F.when(i % 2 == 0, 0.01).otherwise(0.0))
    df = spark.range(0, 200, 1, 4).select(F.lit("P1T1").alias(PLATE), wave.alias("features"))
    kept, left = select.decorrelate(df, names)
    assert 1 <= len(left) <= 1500 and kept.columns == [PLATE, "features"]  # every two neighbours are one wave
    assert qc.missing_counts(df, names).where("n_missing = 0").count() == 3000 and normalize.feature_spread(df, names).where("std > 0").count() == 3000
    assert normalize.plate_stats(df, names).count() == 3000


def plain_ap(rows, query, pos, neg):
    """rows: (id, keys..., vector); pos and neg are predicates of two rows."""
    out = {}
    for q in filter(query, rows):
        found = []
        for p in rows:
            if p is not q and p["id"] != q["id"] and (pos(q, p) or neg(q, p)):
                a, b = np.array(q["x"]), np.array(p["x"])
                length = np.linalg.norm(a) * np.linalg.norm(b)
                found.append((-(round(float(a @ b / length), 12) if length else -2.0), p["id"], bool(pos(q, p))))
        if found:
            hits = [k + 1 for k, f in enumerate(sorted(found)) if f[2]]
            out[q["id"]] = (len(hits), len(found), sum((k + 1) / h for k, h in enumerate(hits)) / len(hits) if hits else None)
    return out


@pytest.mark.parametrize("block", [16 * 4, 1 << 20])
def test_ranks_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ranking, "BLOCK", block)  # four rows a block, or all
    r = np.random.default_rng(4)
    rows = [{"id": k, "plate": f"p{r.integers(3)}", "symbol": "hot" if k % 3 else f"g{r.integers(3)}", "gene_allele": "", "node_type": "allele" if r.random() < 0.6 else "disease_wt", "x": [float(v) for v in r.integers(-1, 2, 2)]} for k in range(120)]
    for row in rows:
        row["gene_allele"] = row["symbol"] + ("_v" if row["node_type"] == "allele" else "")
    rows[7]["plate"] = None
    df = spark.createDataFrame([tuple(row.values()) for row in rows], "id int, plate string, symbol string, gene_allele string, node_type string, features array<double>")
    differ = lambda a, b, c: a[c] is not None and b[c] is not None and a[c] != b[c]
    same = lambda a, b, c: a[c] is not None and a[c] == b[c]
    want = plain_ap(rows, lambda q: q["node_type"] == "allele", lambda q, p: same(q, p, "gene_allele") and differ(q, p, "plate"), lambda q, p: same(q, p, "plate") and same(q, p, "symbol") and q["node_type"] != p["node_type"])
    got = {x["id"]: (x["n_pos"], x["n_total"], x["ap"]) for x in similarity.activity_ap(df, "id").collect()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and got[k][2] == (None if want[k][2] is None else pytest.approx(want[k][2])) for k in want)
    assert similarity.activity_ap(df.limit(0), "id").collect() == []


def test_ranks_of_a_hot_allele(spark, monkeypatch):
    """Queries of one key go to several tasks, a few at a time, partners to files; nothing of a pair is stored or shuffled."""
    r = np.random.default_rng(9)
    rows = [{"id": f"{k:04}", "plate": f"p{k % 2}", "symbol": "g", "gene_allele": "g_v" if k % 3 else "g", "node_type": "allele" if k % 3 else "disease_wt", "x": [float(v) for v in r.normal(size=3)]} for k in range(300)]
    df = spark.createDataFrame([tuple(row.values()) for row in rows], "id string, plate string, symbol string, gene_allele string, node_type string, features array<double>")
    for name, value in (("BLOCK", 16 * 24), ("WORK", 1 << 10)):
        monkeypatch.setattr(ranking, name, value)
    names = []
    monkeypatch.setattr(ranking, "stored", lambda d, name: names.append(name) or d)
    got = {x["id"]: (x["n_pos"], x["n_total"], x["ap"]) for x in similarity.activity_ap(df, "id").collect()}
    want = plain_ap(rows, lambda q: q["node_type"] == "allele", lambda q, p: p["node_type"] == "allele" and q["plate"] != p["plate"], lambda q, p: p["plate"] == q["plate"] and p["node_type"] != "allele")
    assert names == [] and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_partners_in_files(monkeypatch):
    monkeypatch.setattr(ranking, "HELD", 100)
    own = ranking._Partners({"id": {}}, 2)
    for k in range(5):
        own.add(pa.record_batch({"id": pa.array([2 * k, 2 * k + 1]), "features": pa.array([[1.0, k], [k, 2.0]])}))
    blocks = list(own.blocks(3))
    x = np.concatenate([b for _, b in blocks])
    assert own.file is not None and [at for at, _ in blocks] == [0, 3, 6, 8] and own.n == 10 and x[:, 0].tolist() == pytest.approx([v for k in range(5) for v in (1 / np.hypot(1, k), k / np.hypot(k, 2))])


def test_nulls_are_random_orders():
    for n, m in [(6, 3), (40, 3), (7, 7), (9, 1), (50, 2)]:
        drawn = similarity.null_aps(m, n, 20_000, 1)
        chance = np.mean([np.mean([(k + 1) / (p + 1) for k, p in enumerate(own)]) for own in itertools.combinations(range(n), m)])
        assert drawn.mean() == pytest.approx(chance, abs=0.01) and np.array_equal(drawn, similarity.null_aps(m, n, 20_000, 1))
    own = similarity.null_aps(2, 9, 60_000, 3)  # every pair of places equally often
    share = np.bincount(np.round(own * 1000).astype(int))
    every = np.bincount([round(np.mean([1 / (a + 1), 2 / (b + 1)]) * 1000) for a, b in itertools.combinations(range(9), 2)], minlength=len(share)) / 36
    assert np.abs(share / len(own) - every[:len(share)]).max() < 0.01


def test_p_values_against_plain_sums(spark):
    rows = [("a", 0.9, 2, 5), ("a", 0.5, 1, 4), ("b", 0.2, 1, 30), ("c", 1.0, 3, 3)]
    df = spark.createDataFrame(rows, "g string, ap double, n_pos long, n_total long")
    for x in similarity.mean_average_precision(df, ["g"], 500, seed=7).collect():
        own = [r for r in rows if r[0] == x["g"]]
        null = np.mean([similarity.null_aps(r[2], r[3], 500, 7) for r in own], 0)
        assert x["mAP"] == pytest.approx(np.mean([r[1] for r in own])) and x["p_value"] == pytest.approx(((null >= x["mAP"] - 1e-12).sum() + 1) / 501) and x["n_queries"] == len(own)


def test_adjusted_p_values_in_scopes(spark):
    r = np.random.default_rng(2)
    rows = [(s, k, float(p)) for s in ("x", "y", None) for k, p in enumerate([*(r.random(300) ** 3), *([1 / 10_001] * 200), 1.0, 1.0, 0.0, 1e-300])] + [("x", 999, None)]
    df = spark.createDataFrame(rows, "s string, k int, p double")
    got = {(x["s"], x["k"]): x["q"] for x in stats.benjamini_hochberg(df, "p", ["s"], out="q").collect()}
    assert len(got) == len(rows) and got["x", 999] is None
    for s in ("x", "y", None):
        own = sorted((p, k) for t, k, p in rows if t == s and p is not None)
        least = 1.0
        for rank in range(len(own), 0, -1):
            least = min(least, own[rank - 1][0] * len(own) / rank)
            assert got[s, own[rank - 1][1]] == pytest.approx(least)
    assert stats.benjamini_hochberg(df.limit(0), "p", []).collect() == []


def test_complementary_error_function():
    x = np.linspace(0, 12, 4001)
    assert np.allclose(stats.erfc(x), [math.erfc(v) for v in x], rtol=1e-12, atol=0)


def test_rank_sum_p_values_against_plain_counts(spark):
    r = np.random.default_rng(6)
    rows = []
    for k in range(60):
        n, m = int(r.integers(2, 14)), int(r.integers(2, 14))
        draw = r.permutation(1000) if k % 2 else r.integers(0, 6, 1000)
        rows += [(k, "a", float(v)) for v in draw[:n]] + [(k, "b", float(v)) for v in draw[n:n + m]]
    got = {x["k"]: x for x in stats.rank_sum_tests(spark.createDataFrame(rows, "k int, g string, v double"), ["k"], "v", "g").collect()}
    assert len(got) == 60
    for k, x in got.items():
        a, b = ([v for j, g, v in rows if j == k and g == arm] for arm in "ab")
        u, n, m = sum((p > q) + (p == q) / 2 for p in a for q in b), len(a), len(b)
        ties = sum(c**3 - c for c in np.unique(a + b, return_counts=True)[1])
        if min(n, m) <= 8 and ties == 0:
            ways = {0: {0: 1}}  # subsets of ranks by size and sum
            for rank in range(n + m):
                for size in sorted(ways, reverse=True):
                    for total, c in list(ways[size].items()):
                        into = ways.setdefault(size + 1, {})
                        into[total + rank] = into.get(total + rank, 0) + c
            low = min(u, n * m - u)
            counts = {total - n * (n - 1) // 2: c for total, c in ways[n].items()}
            p = min(1, 2 * sum(c for t, c in counts.items() if t <= low) / sum(counts.values()))
        else:
            var = n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1)))
            p = min(1, math.erfc(max(0, abs(u - n * m / 2) - 0.5) / math.sqrt(var) / math.sqrt(2))) if var > 0 else 1.0
        assert x["u"] == u and x["p_value"] == pytest.approx(p)


def test_value_concentration_of_ties(spark):
    df = spark.createDataFrame([([float(v), w, 1.0, NAN],) for v, w in zip([1, 1, 2, 2, 3], [1.0, 1.0, 1.0, 2.0, None], strict=True)], "features array<double>")
    got = {x["feature"]: (x["freq_ratio"], x["unique_ratio"]) for x in select.value_concentration(df, list("abcd")).collect()}
    assert got == {"a": (1.0, 0.6), "b": (1 / 3, 0.5), "c": (0.0, 0.2)}


def test_components_of_no_rows(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 1.0]), ("c", [0.0, 5.0])], "k string, features array<double>")
    none = stats.principal_components(df.limit(0))
    assert none.collect() == [] and none.columns == stats.principal_components(df).columns


def test_one_fit_for_many_classifiers(spark, monkeypatch):
    from plateaux.operators import learn

    r = np.random.default_rng(8)
    rows = []
    for task, shift in (("easy", 4.0), ("none", 0.0), ("other", -4.0)):
        for k in range(300):
            y = k % 3 == 0
            x = r.normal(size=3)
            x[1] += shift * y
            rows.append((task, k, int(y), [*map(float, x)], [task] if k < 200 else [], [task] if k >= 200 else []))
    df = spark.createDataFrame(rows, "pair string, k int, Label int, features array<double>, trains array<string>, tests array<string>").repartition(4)
    tasks = spark.createDataFrame([(t, 67, 133) for t in ("easy", "none", "other")], "task_id string, n_train_ref long, n_train_var long")
    runs = []
    for most in (1 << 18, 8):  # all tasks in one fit, and two or one
        monkeypatch.setattr(learn, "COEFFICIENTS", most)
        scored, top = learn.fit_tasks(df, tasks, ["a", "b", "c"])
        runs.append({(x["task_id"], x["k"]): (x["Label"], x["prediction"]) for x in scored.collect()})
        best = {x["task_id"]: x["feature"] for x in top.orderBy("importance").collect()}
        assert best["easy"] == best["other"] == "b" and top.count() == 9
    assert len(runs[0]) == 300 and runs[0].keys() == runs[1].keys()
    for task in ("easy", "other", "none"):
        own = [v for (t, _), v in runs[0].items() if t == task]
        good = np.mean([p > q for y, p in own if y for z, q in own if not z])
        assert good > 0.97 if task != "none" else abs(good - 0.5) < 0.25
        assert all(abs(p - runs[1][k][1]) < 0.05 for k, (_, p) in runs[0].items() if k[0] == task and task != "none")


def test_lists_of_folds_say_what_copies_say(spark):
    from plateaux.operators import folds
    from plateaux.operators.contract import PLATEMAP, WELL

    r = np.random.default_rng(9)
    rows = [(f"pair{r.integers(3)}", int(r.integers(2)), f"P{m}T{r.integers(1, 4)}", f"P{m}", f"w{r.integers(5)}") for m in r.integers(1, 3, 500)]
    cells = spark.createDataFrame(rows, f"pair_id string, Label int, {PLATE} string, {PLATEMAP} string, {WELL} string")
    for layout, found in (("plates", folds.plate_folds(cells)), ("wells", folds.well_pair_folds(cells))):
        a = folds.task_sizes(folds.split_by_fold(cells, found, layout), 1, 1)
        b = folds.list_sizes(folds.fold_lists(cells, found, layout), 1, 1)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect())) and a.count() > 3


def test_which_of_two_correlated_features_goes(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3))
    m = np.stack([x[:, 0], x[:, 0] + 0.1 * x[:, 1], x[:, 1], x[:, 0], np.ones(200), x[:, 0] + 0.2 * x[:, 2]], 1)
    names = ["d", "a", "c", "b", "one", "e"]
    corr = np.abs(np.nan_to_num(np.array([[np.corrcoef(m[:, i], m[:, j])[0, 1] if 4 not in (i, j) else 0 for j in range(6)] for i in range(6)])))
    np.fill_diagonal(corr, 0)
    total = corr.sum(1).round(9)
    want = {names[i]: any(corr[i, j] > 0.9 and (total[i] > total[j] or total[i] == total[j] and names[i] > names[j]) for j in range(6)) for i in range(6)}
    df = spark.createDataFrame([([float(v) for v in row],) for row in m], "features array<double>")
    got = {x["feature"]: x["dropped"] for x in select.correlated(df, names).collect()}
    assert got == want and 0 < sum(got.values()) < 6


def test_stars_and_shares_of_significance(spark):
    from plateaux.operators import multilabel

    df = spark.createDataFrame([(k, p, 3.0, 1.0) for k, p in enumerate([0.0005, 0.005, 0.03, 0.2, None])], "k int, corrected_p_value double, median_a double, median_b double")
    assert [(x["stars"], x["effect"]) for x in stats.effect_table(df).orderBy("k").collect()] == [("***", 2.0), ("**", 2.0), ("*", 2.0), ("", 2.0), ("", 2.0)]
    rows = [("r", f"l{k}", 0.1 * k, 0.2 * k, k < 3) for k in range(8)]
    x = multilabel.summarize(spark.createDataFrame(rows, "r string, label string, mAP double, mAP_norm double, below_corrected_p boolean"), ["r"]).first()
    assert (x["n_labels"], x["n_significant"], x["percent_significant"]) == (8, 3, 37.5) and x["median_norm"] == pytest.approx(0.7)


def test_groups_that_lie_together_are_dealt_out(spark):
    """Rows partitioned by gene, which is one of the keys: the sorts over a gene's classifiers still go to different tasks."""
    from plateaux.operators import metrics

    rows = spark.range(0, 4000, 1, 2).select(F.lit("g").alias("gene"), F.when(F.col("id") % 40 > 0, F.concat(F.lit("c"), (F.col("id") % 40).cast("string"))).alias("c"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 17 / 17).alias("prediction"))
    df = rows.repartition(3, "gene")
    found = metrics.classifier_metrics(df, ["c", "gene"])
    plans = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__g" in plans
    own = sorted((r["prediction"], r["label"]) for r in rows.where("c is null").collect())
    pairs = [(p > q) + (p == q) / 2 for p, a in own if a for q, b in own if not b]
    got = {r["c"]: r for r in found.collect()}
    assert len(got) == 40 and got[None]["auroc"] == pytest.approx(np.mean(pairs)) and got[None]["n_pos"] == sum(a for _, a in own) and got[None]["gene"] == "g"


def test_a_classifier_is_ranked_by_ranges(spark, monkeypatch):
    """Distinct scores are counted in tables of bounded size, and no window holds a classifier: ranges of it meet in several tasks."""
    from plateaux.operators import metrics

    r = np.random.default_rng(31)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1e308, 0.5]
    rows = [(c, int(r.random() < 0.4), odd[k % 60] if k % 60 < len(odd) else float(r.normal()) * 10.0 ** (k % 5 - 2) if k % 3 else float(k % 8) / 4) for c in ("a", "b", None) for k in range(3000)]
    df = spark.createDataFrame(rows, "c string, label int, prediction double").repartition(3)
    monkeypatch.setattr(metrics, "HELD", 500)
    found = metrics.classifier_metrics(df, ["c"])
    assert "hashpartitioning(__g#" in found._jdf.queryExecution().executedPlan().toString() and not any("windowspecdefinition(__g" in line and "__s" in line and "__at" not in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())
    got = {x["c"]: x for x in found.collect()}
    place = lambda x: (-1, 0.0) if x is None else (1, 0.0) if math.isnan(x) else (0, x)
    for c in ("a", "b", None):
        own = [(place(p), y) for a, y, p in rows if a == c]
        one, none = [p for p, y in own if y], [p for p, y in own if not y]
        u = sum((p > q) + (p == q) / 2 for p in one for q in none)
        ap = sum(sum(p >= x for p in one) / sum(p >= x for p, _ in own) for x in one) / len(one)
        tp, fp = (sum(p >= (0, 0.5) for p in side) for side in (one, none))
        x = got[c]
        assert (x["n_pos"], x["n_neg"]) == (len(one), len(none)) and x["auroc"] == pytest.approx(u / len(one) / len(none)) and x["auprc"] == pytest.approx(ap)
        assert x["sensitivity"] == pytest.approx(tp / len(one)) and x["specificity"] == pytest.approx(1 - fp / len(none))

    small = spark.range(0, 25000, 1, 1).select((F.col("id") * 1.5).alias("s"), F.lit(1).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    assert metrics._counted(small).agg(F.sum("pos"), F.count("*")).first()[:] == (25000, 25000)
    twice = small.withColumn("s", F.floor("s") % 7)
    assert metrics._counted(twice).count() == 7 and metrics._counted(twice).agg(F.sum("pos")).first()[0] == 25000


def test_newton_steps_reach_the_learners_optimum(spark, monkeypatch):
    """Every task's loss is at its minimum, also where classes can be told apart; the same tasks by Spark's learner agree."""
    from plateaux.operators import learn

    r = np.random.default_rng(12)
    rows = []
    for k in range(160):
        y = int(r.random() < 0.5)
        x = [float(y + r.normal()), float(r.normal(5, 3)), None if k % 11 == 0 else float(20 * y)]
        rows.append((k, y, x, ["t0", "t1"] if k % 4 else ["t2", "unknown"], ["t0"] if k % 4 == 0 else ["t2", "t1"]))
    df = spark.createDataFrame(rows, "cell int, Label int, features array<double>, trains array<string>, tests array<string>").repartition(3)
    count = lambda t, y: sum(t in row[3] and row[1] == y for row in rows)
    tasks = spark.createDataFrame([(t, count(t, 1), count(t, 0)) for t in ("t0", "t1", "t2")], "task_id string, n_train_ref long, n_train_var long")
    fit = lambda: [{(x["task_id"], x["cell"]): x["prediction"] for x in learn.fit_tasks(df, tasks, ["a", "b", "c"], 300, 1e-2)[0].collect()}, {(x["task_id"], x["feature"]): x["importance"] for x in learn.fit_tasks(df, tasks, ["a", "b", "c"], 300, 1e-2)[1].collect()}]
    calls, newton = [], learn._newton
    monkeypatch.setattr(learn, "_newton", lambda *a: calls.append(1) or newton(*a))
    got = fit()
    monkeypatch.setattr(learn, "NARROW", 0)
    want = fit()
    assert len(calls) == 2 and len(got[0]) == sum(len(row[4]) for row in rows)
    assert all(a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=2e-3) for k in b) for a, b in zip(got, want, strict=True))


def test_metrics_are_ranked_once(spark):
    """What reads the metrics of the classifiers several times finds them written, and does not rank the predictions again."""
    from conftest import SMALL
    from plateaux.plans import classification_queries as q

    for name in ("single_fold_metrics", "wide_summary", "score_correlation", "bh_adjust"):
        plan = getattr(q, name)(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "lineitem" not in plan and "l_extendedprice" not in plan


def test_counted_medians_and_tasks(spark):
    """Medians from counted values agree with plain ones, with nulls, ties, even counts and a key without values."""
    from plateaux.functions.stats import counted_medians

    rng = np.random.default_rng(5)
    rows = [(f"k{i % 7}" if i % 7 else None, None if i % 11 == 0 or i % 7 == 3 else float(rng.integers(-40, 40)) / 8) for i in range(3001)]
    found = {r["k"]: (r["m"], r["n"]) for r in counted_medians(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", "m").collect()}
    for k in {k for k, _ in rows}:
        own = [x for a, x in rows if a == k]
        have = [x for x in own if x is not None]
        assert found[k] == ((float(np.median(have)) if have else None), len(own))


def test_cells_are_not_shuffled_by_plate(spark):
    """A few plates or wells would put the cells into as few tasks, so the small side of both joins goes to the cells."""
    from plateaux.operators import normalize, qc

    cells = spark.range(4000).select(F.concat(F.lit("P"), F.col("id") % 2).alias("Metadata_Plate"), F.concat(F.lit("W"), F.col("id") % 3).alias("Metadata_well_position"), F.array(F.col("id").cast("double"), (F.col("id") % 9).cast("double")).alias("features"))
    scaled = normalize.robust_z(qc.drop_low_count_wells(cells, 5), ["a", "b"], normalize.plate_stats(cells, ["a", "b"]))
    plan = scaled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert scaled.count() == 4000


def test_preprocessing_reads_written_cells(spark):
    """The window that numbers the cells runs once, not for the manifest and every count of the chain again."""
    from conftest import SMALL
    from plateaux.plans import pipeline_queries

    df, _ = pipeline_queries._preprocessed(spark, SMALL)
    assert not any("lineitem" in f for f in df.inputFiles()) and df.count() > 0
    from plateaux.plans import pipelines
    seen = []
    real, pipelines.stored = pipelines.stored, lambda d, name: seen.append((name, d._jdf.queryExecution().optimizedPlan().toString())) or real(d, name)
    try:
        pipeline_queries._preprocessed(spark, SMALL)
    finally:
        pipelines.stored = real
    assert [n for n, _ in seen] == ["listed", "gated", "scaled"] and not any("Window" in p for _, p in seen)
