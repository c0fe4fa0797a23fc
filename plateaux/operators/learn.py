"""Many small classifiers in one fit: a logistic model for each task.

Cells that are learned from and tested in the same tasks under the same labels are a group, so a cell is one row, whatever the number of
its tasks, and a few groups say who takes part in what. With up to NARROW coefficients a task, cells are written once as blocks, matrices
of one group each, and all tasks take Newton steps together: a pass over the blocks sums loss, gradient and curvature of every task that is not
done by matrix products, and each task takes or halves its own step; some ten passes fit them, where a joint
search over all coefficients takes all its rounds. Otherwise, and for a task alone, Spark's own learner fits the same loss: the features of a row are multiplied with the indicator of its task, so the coefficients of all tasks are one long vector that
falls into a block for each, and the loss is a sum over tasks. One distributed fit then trains them all, whatever their number, and a
task with a third of the rows is spread like any other. Cells are copied for their tasks only on their way into that learner and into predictions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.blocks import column, finite, matrix
from ..functions.stats import constant
from ..sources.scratch import dropped, stored
from .contract import OBJECT, PLATE, WELL, union_all
from .order import numbered

MAX_IMBALANCE = 100
ROUNDS, PENALTY = 100, 1e-4
TOP, COEFFICIENTS = 50, 1 << 18
BLOCK, PART, HELD = 1 << 18, 32 << 20, 64 << 20  # bytes of a block, of the blocks that a task writes, and of cells that a task holds to pack them
NARROW, DECREMENT = 16, 1e-12  # coefficients of a task fitted by Newton steps, and the decrease of its loss that ends them
PREDICTION_SCHEMA = f"Classifier_ID string, {PLATE} string, {WELL} string, {OBJECT} long, Label byte, Prediction float, Feature_Type string, Control boolean"


def usable(sizes: DataFrame) -> DataFrame:
    """Tasks whose training rows have both classes, not too far from balance."""
    return sizes.where((F.col("n_train_ref") > 0) & (F.col("n_train_var") > 0) & (F.col("imbalance_ratio") <= MAX_IMBALANCE))


def _scales(cells: DataFrame, width: int) -> tuple[list[float], list[float]]:
    """Mean and spread of each feature over all cells, by which all tasks' features are scaled; missing values become the mean."""
    from .moments import moments

    found = sorted(moments(cells, width).collect(), key=lambda r: r["i"])  # a row for each feature
    spread = [float(np.sqrt((r["m2"] or 0) / max(1, r["n"]))) for r in found]
    return [float(r["mean"] or 0) for r in found], [s if s > 0 else 1.0 for s in spread]


def fit_tasks(cells: DataFrame, tasks: DataFrame, names: list[str], rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[DataFrame, DataFrame]:
    """fit_groups() of cells that have Label, ``trains`` and ``tests`` in their own rows: predictions (task_id, the columns of the
    cell, prediction) and importances. Cells that agree in the three are a group."""
    own = ["Label", "trains", "tests"]
    groups = stored(cells.groupBy(*own).agg(F.count("*").alias("__n")).withColumn("__group", F.monotonically_increasing_id()), "groups")
    at = groups.select("__group", *[F.col(c).alias(f"__{c}") for c in own])
    rest = [c for c in cells.columns if c not in ("features", *own)]
    grouped = cells.join(at, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in own])).select("__group", "features", *rest)
    scored, top, _ = fit_groups(grouped, groups, tasks, names, rounds, penalty)
    return scored.select("task_id", *[c for c in cells.columns if c not in ("features", "trains", "tests")], "prediction"), top


def fit_groups(cells: DataFrame, members: DataFrame, tasks: DataFrame, names: list[str], rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions (task_id, the columns of the cell and of the member, prediction of label 1) for the test cells of every task, importances
    (task_id, feature, importance), the fifty largest of each task, and the same predictions in lists (task_id, label, scores), which are
    written; the first are made when they are read.

    ``cells``: __group, features, and whatever else identifies a cell. ``members``: __group, __n (its cells), Label (1, 0), ``trains`` and
    ``tests`` (arrays of task ids), and other columns for the predictions; a group may have several rows.
    ``tasks``: task_id, n_train_ref, n_train_var of the tasks to be fitted. Both classes of a task weigh as much, and all tasks,
    so a task's penalty does not depend on the others. A cell counts for the scales of the features once a member.
    Importance is the share of a feature in the sum of absolute coefficients of scaled features. A fit has at most
    COEFFICIENTS of them, as the driver holds that vector; more tasks are several fits, with the same results.
    """
    spark = cells.sparkSession
    own, more = [c for c in cells.columns if c not in ("__group", "features")], [c for c in members.columns if c not in ("__group", "__n", "trains", "tests")]
    known = numbered(tasks.select("task_id", (0.5 / F.col("n_train_ref")).alias("__one"), (0.5 / F.col("n_train_var")).alias("__zero")), ["task_id"], "__task")
    n_tasks, width = known.count(), len(names)
    if not n_tasks:
        types = {f.name: f.dataType.simpleString() for d in (cells, members) for f in d.schema.fields}
        none = spark.createDataFrame([], f"task_id string, {', '.join(f'`{c}` {types[c]}' for c in own + more)}, prediction double")
        return none, spark.createDataFrame([], "task_id string, feature string, importance double"), spark.createDataFrame([], "task_id string, label int, scores array<double>")
    blocks = _blocks(cells, members, known, width) if width < NARROW else None
    means, spreads = _scales(cells.join(members.select("__group"), "__group"), width) if blocks is None else _block_scales(blocks, width)
    table = F.zip_with(constant(means, "double"), constant(spreads, "double"), lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    scaled = F.zip_with("features", table, lambda x, t: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise((x - t["m"]) / t["s"]))
    each = cells.select("__group", *own, F.concat(scaled, F.array(F.lit(1.0))).alias("__x")).join(members.drop("__n"), "__group")
    size = max(1, COEFFICIENTS // (width + 1))
    fits = [_fit(each, own + more, blocks, (means, spreads), known.where((F.col("__task") >= low) & (F.col("__task") < low + size)), low, min(size, n_tasks - low), names, rounds, penalty) for low in range(0, n_tasks, size)]
    scored, top, lists = (union_all(list(f)) for f in zip(*fits, strict=True))
    lists = stored(lists, "lists")
    if blocks is not None:
        dropped(blocks)
    return scored, top, lists


def _packed(groups: np.ndarray, parts: list[np.ndarray]):
    """Batches of blocks from the groups of matrices (feature, cell), which are of one group each, or a row of cells' groups and one matrix."""
    x, held, size = np.concatenate(parts, 1), [], 0
    order = np.argsort(groups, kind="stable")
    groups, x = groups[order], x[:, order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]])
    step = max(1, BLOCK // (8 * len(x)))
    batch = lambda rows: pa.record_batch({"__group": pa.array([g for g, _ in rows], pa.int64()), "x": pa.array([b for _, b in rows], pa.binary())})
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for at in range(low, high, step):
            held.append((int(groups[low]), np.ascontiguousarray(x[:, at:min(high, at + step)]).tobytes()))
            size += len(held[-1][1])
            if size >= 1 << 22:
                yield batch(held)
                held, size = [], 0
    if held:
        yield batch(held)


def _gathered(batches, parts_of):
    """Blocks of what comes in batches as (groups, matrix of feature and cell); a task holds up to HELD bytes of it."""
    groups, parts, size = [], [], 0
    for batch in batches:
        for g, x in parts_of(batch):
            groups.append(g)
            parts.append(x)
            size += x.nbytes
            if size >= HELD:
                yield from _packed(np.concatenate(groups), parts)
                groups, parts, size = [], [], 0
    if size:
        yield from _packed(np.concatenate(groups), parts)


def _blocks(cells: DataFrame, members: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """(x, sums, weight, trains, tests): matrices of the cells of a group, a row for each feature, as bytes of doubles; each feature's values,
    mean and squared deviations; how many members the group has, and the numbers and labels of the tasks that learn from it and test it.

    Cells are packed where they are read; small blocks of a group then meet in a task, a large group's in several.
    """
    spark = cells.sparkSession
    roles = [members.select("__group", "Label", F.explode(r).alias("task_id"), F.lit(r).alias("role")) for r in ("trains", "tests")]
    own = roles[0].unionByName(roles[1]).join(known.select("task_id", "__task"), "task_id").withColumn("t", F.struct(F.col("__task").cast("int").alias("k"), (F.col("Label") == 1).alias("one")))
    lists = own.groupBy("__group").agg(*[F.collect_list(F.when(F.col("role") == r, F.col("t"))).alias(r) for r in ("trains", "tests")])
    none = F.array().cast("array<struct<k:int,one:boolean>>")
    groups = members.groupBy("__group").agg(F.count("*").alias("weight"), F.max("__n").alias("n")).join(lists, "__group", "left").withColumns({r: F.coalesce(r, none) for r in ("trains", "tests")})
    groups = stored(groups, "members")
    size = 8 * width * (groups.agg(F.sum("n")).first()[0] or 0)
    tasks = max(spark.sparkContext.defaultParallelism, size // PART)
    shares = F.ceil(8.0 * width * F.col("n") * tasks / max(1, size))  # tasks among which a group is dealt

    def of_cells(batch):
        yield column(batch, "__group").to_numpy(), np.ascontiguousarray(matrix(column(batch, "features"), width).T)

    def of_blocks(batch):
        for g, x in zip(column(batch, "__group").to_pylist(), column(batch, "x"), strict=True):
            own = np.frombuffer(x.as_buffer()).reshape(width, -1)
            yield np.full(own.shape[1], g), own

    def summed(batches):
        for batch in _gathered(batches, of_blocks):
            sums = []
            for x in column(batch, "x"):
                zeroed, here = finite(np.frombuffer(x.as_buffer()).reshape(width, -1))
                n = here.sum(1)
                mean = zeroed.sum(1) / np.maximum(n, 1)
                sums.append(np.concatenate([n, mean, (np.where(here, zeroed - mean[:, None], 0.0) ** 2).sum(1)]))
            yield pa.record_batch({c: column(batch, c) for c in batch.schema.names} | {"sums": pa.array(sums, pa.list_(pa.float64()))})

    packed = cells.select("__group", "features").mapInArrow(lambda b: _gathered(b, of_cells), "__group long, x binary").withColumn("part", F.spark_partition_id())
    dealt = packed.join(groups.select("__group", shares.alias("shares")), "__group").repartition(tasks, "__group", F.pmod("part", "shares")).select("__group", "x")
    merged = dealt.mapInArrow(summed, "__group long, x binary, sums array<double>")
    return stored(merged.join(groups.select("__group", "weight", "trains", "tests"), "__group").drop("__group"), "blocks")


def _block_scales(blocks: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each feature over the cells of all members; missing values left out."""
    def add(a, b):
        n = np.maximum(a[0] + b[0], 1)
        away = b[1] - a[1]
        return np.stack([a[0] + b[0], a[1] + away * b[0] / n, a[2] + b[2] + away**2 * a[0] * b[0] / n])

    def run(batches):
        total = np.zeros((3, width))
        for batch in batches:
            for own, weight in zip(column(batch, "sums").flatten().to_numpy().reshape(-1, 3, width), column(batch, "weight").to_pylist(), strict=True):
                total = add(total, own * np.array([[weight], [1], [weight]]))
        yield pa.record_batch({"s": pa.array([total.ravel()], pa.list_(pa.float64()))})

    n, mean, m2 = reduce(add, [np.reshape(r["s"], (3, width)) for r in blocks.select("sums", "weight").mapInArrow(run, "s array<double>").collect()], np.zeros((3, width)))  # a row for each task
    spread = np.sqrt(m2 / np.maximum(n, 1))
    return mean.tolist(), np.where(spread > 0, spread, 1.0).tolist()


def _of(batch: pa.RecordBatch, role: str, low: int, n: int):
    """The blocks of a batch with the tasks of a fit: bytes, numbers of tasks, labels."""
    own = column(batch, role)
    flat, ends = own.flatten(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
    k, one = flat.field("k").to_numpy() - low, flat.field("one").to_numpy(zero_copy_only=False)
    for x, a, b in zip(column(batch, "x"), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        use = (k[a:b] >= 0) & (k[a:b] < n)
        if use.any():
            yield x.as_buffer(), k[a:b][use], one[a:b][use]


def _scaled(x: pa.Buffer, means: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """A block's scaled features and the constant, a row each."""
    raw = np.frombuffer(x).reshape(len(means), -1)
    with np.errstate(invalid="ignore"):
        return np.concatenate([np.where(np.isfinite(raw), (raw - means[:, None]) / spreads[:, None], 0.0), np.ones((1, raw.shape[1]))])


def _logistic(x, beta) -> np.ndarray:
    """Predictions by features times coefficients, summed in their order, so that equal cells have equal ones."""
    z = sum(a * b for a, b in zip(x, beta, strict=True))
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def _sums(x: np.ndarray, one: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Of each task: its loss, gradient and upper half of the curvature, summed over cells x (feature, cell), all of label ``one``."""
    m, sign = len(x), np.where(one, -1.0, 1.0)
    ends = np.cumsum([0, *range(m, 0, -1)])
    out, step = np.zeros((len(w), 1 + m + ends[-1])), max(256, (1 << 15) // len(w))
    for at in range(0, x.shape[1], step):
        own = x[:, at:at + step]
        products = np.empty((ends[-1], own.shape[1]))
        for i in range(m):
            np.multiply(own[i], own[i:], out=products[ends[i]:ends[i + 1]])
        v = (sign[:, None] * beta) @ own
        e = np.exp(-np.abs(v))
        r = 1 / (1 + e)
        # a logarithm for each 256 cells: r is at least a half
        out[:, 0] += np.maximum(v, 0).sum(1) - np.log(np.multiply.reduceat(r, np.arange(0, own.shape[1], 256), 1)).sum(1)
        e *= r
        out[:, 1:m + 1] += sign[:, None] * (np.where(v >= 0, r, e) @ own.T)
        out[:, m + 1:] += (e * r) @ products.T
    return w[:, None] * out


def _rows(seen: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """(k, s): a row for each task seen."""
    own = np.flatnonzero(seen)
    return pa.record_batch({"k": pa.array(own, pa.int32()), "s": pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums[own].ravel()))})


def _newton(each: DataFrame, rest: list[str], blocks: DataFrame, scales: tuple, known: DataFrame, low: int, n: int, width: int, rounds: int, penalty: float) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Predictions for the test cells, these in lists, and the coefficients (task, feature and constant), at most COEFFICIENTS numbers."""
    spark = each.sparkSession
    names = sorted((r["__task"] - low, r["task_id"], r["__one"], r["__zero"]) for r in known.collect())
    ids = spark.sparkContext.broadcast([r[1] for r in names])
    one, zero = (np.array([r[c] for r in names], float) for c in (2, 3))
    means, spreads = map(np.array, scales)
    m = width + 1
    size = 1 + m + m * (m + 1) // 2
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n * size >> 19))
    everything = training = blocks.select("x", "trains").where(F.exists("trains", lambda t: (t["k"] >= low) & (t["k"] < low + n)))

    def added(batches):
        sums, seen = np.zeros((n + 1, size)), np.zeros(n + 1, bool)
        for batch in batches:
            k = column(batch, "k").to_numpy()
            np.add.at(sums, k, column(batch, "s").flatten().to_numpy().reshape(-1, size))
            seen[k] = True
        yield _rows(seen, sums)

    def evaluated(beta: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, bool]:
        """Sums of the active tasks, and whether most of what was read is of no use to them."""
        at = spark.sparkContext.broadcast((beta, active, one, zero))

        def run(batches):
            beta, active, one, zero = at.value
            sums, seen = np.zeros((n + 1, size)), np.zeros(n + 1, bool)  # the last: bytes read, and of them used
            seen[n] = True
            for batch in batches:
                for x, k, y in _of(batch, "trains", low, n):
                    k, y = k[active[k]], y[active[k]]
                    sums[n, :2] += x.size, x.size if len(k) else 0
                    if len(k):
                        np.add.at(sums, k, _sums(_scaled(x, means, spreads), y, np.where(y, one[k], zero[k]), beta[k]))
                        seen[k] = True
            yield _rows(seen, sums)

        found = training.mapInArrow(run, "k int, s array<double>").repartition(parts, "k").mapInArrow(added, "k int, s array<double>").toArrow()  # a row for each task of the fit
        out = np.zeros((n + 1, size))
        if len(found):
            out[found.column("k").to_numpy()] = found.column("s").combine_chunks().flatten().to_numpy().reshape(-1, size)
        at.unpersist()
        return out[:n], bool(out[n, 1] < out[n, 0] / 2)

    def left(training: DataFrame, active: np.ndarray) -> DataFrame:
        """The blocks from which active tasks learn, written."""
        at = spark.sparkContext.broadcast(active)

        def run(batches):
            for batch in batches:
                own = column(batch, "trains")
                k = own.flatten().field("k").to_numpy() - low
                use = (k >= 0) & (k < n) & at.value[np.clip(k, 0, n - 1)]
                row = np.repeat(np.arange(len(batch)), own.value_lengths().to_numpy())
                yield batch.filter(pa.array(np.bincount(row[use], minlength=len(batch)) > 0))

        return stored(training.mapInArrow(run, training.schema), "training")

    i, j = np.triu_indices(m)
    beta, step, loss, slope = np.zeros((n, m)), np.zeros((n, m)), np.full(n, np.inf), np.zeros(n)
    length, active = np.ones(n), np.ones(n, bool)
    for _ in range(rounds):
        if not active.any():
            break
        trial = beta + length[:, None] * step
        got, idle = evaluated(trial, active)
        now = got[:, 0] + penalty / 2 * (trial**2).sum(1)
        good = active & ((now <= loss + 1e-4 * length * slope) | (length < 1e-6))
        own = np.flatnonzero(good)
        beta[own], loss[own] = trial[own], now[own]
        g = got[own, 1:m + 1] + penalty * trial[own]
        h = np.zeros((len(own), m, m))
        h[:, i, j] = h[:, j, i] = got[own, m + 1:]
        h += penalty * np.eye(m)
        d = -np.linalg.solve(h, g[:, :, None])[:, :, 0]
        step[own], slope[own] = d, (g * d).sum(1)
        active[own] = (-slope[own] > DECREMENT) & (length[own] >= 1e-6)
        length = np.where(good, 1.0, length / 2)
        if idle and active.any():
            last, training = training, left(training, active)
            if last is not everything:
                dropped(last)
    if training is not everything:
        dropped(training)
    final = spark.sparkContext.broadcast(beta)
    wanted = each.withColumn("task_id", F.explode("tests")).select("task_id", *rest, "__x").join(known.select("task_id", "__task"), "task_id")

    def scored(batches):
        for batch in batches:
            x, k = matrix(column(batch, "__x"), m), column(batch, "__task").to_numpy() - low
            own = {c: column(batch, c) for c in batch.schema.names if c not in ("__x", "__task")}
            yield pa.record_batch(own | {"prediction": pa.array(_logistic(x.T, final.value[k].T))})

    def listed(batches):
        for batch in batches:
            for x, k, y in _of(batch, "tests", low, n):
                x = _scaled(x, means, spreads)
                some = max(1, (1 << 19) // x.shape[1])
                for at in range(0, len(k), some):
                    own = k[at:at + some]
                    p = _logistic(x[:, None, :], final.value[own].T[:, :, None])
                    yield pa.record_batch({"task_id": pa.array([ids.value[t] for t in own.tolist()], pa.string()), "label": pa.array(y[at:at + some].astype(np.int32)), "scores": pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * x.shape[1]), pa.array(p.ravel()))})

    schema = StructType([f for f in wanted.schema.fields if f.name not in ("__x", "__task")]).add("prediction", "double")
    return wanted.mapInArrow(scored, schema), blocks.select("x", "tests").mapInArrow(listed, "task_id string, label int, scores array<double>"), beta


def _fit(each: DataFrame, rest: list[str], blocks: DataFrame | None, scales: tuple, known: DataFrame, low: int, n: int, names: list[str], rounds: int, penalty: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Interaction, OneHotEncoder, VectorAssembler, VectorSizeHint
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark, width = each.sparkSession, len(names)
    # the last feature is each task's constant; the learner drops a column that is constant, as it is with one task alone

    def rows(role: str) -> DataFrame:
        return each.withColumn("task_id", F.explode(role)).join(known, "task_id").select("task_id", *rest, array_to_vector("__x").alias("__v"), (F.col("__task") - low).cast("double").alias("__k"), F.when(F.col("Label") == 1, F.col("__one")).otherwise(F.col("__zero")).alias("__w"), F.col("Label").cast("double").alias("__y"))

    if n > 1 and blocks is not None:
        scored, lists, found = _newton(each, rest, blocks, scales, known, low, n, width, rounds, penalty)
    else:
        encoder = OneHotEncoder(inputCol="__k", outputCol="__own", dropLast=False).fit(spark.range(n).select(F.col("id").cast("double").alias("__k")))
        learner = LogisticRegression(featuresCol="__both", labelCol="__y", weightCol="__w", fitIntercept=n == 1, standardization=False, maxIter=rounds, tol=1e-9, regParam=penalty / n, probabilityCol="__p", predictionCol="__c", rawPredictionCol="__r")
        stages = [encoder, VectorSizeHint(inputCol="__v", size=width + 1), VectorAssembler(inputCols=["__v"], outputCol="__all"), Interaction(inputCols=["__own", "__all"], outputCol="__both"), learner]
        model = Pipeline(stages=stages).fit(rows("trains"))
        scored = model.transform(rows("tests")).select("task_id", *rest, vector_to_array("__p")[1].alias("prediction"))
        lists = scored.select("task_id", F.col("Label").cast("int").alias("label"), F.array("prediction").alias("scores"))
        found = model.stages[-1].coefficients.toArray().reshape(n, width + 1)
    weights = spark.sparkContext.broadcast(np.abs(found)[:, :width])

    def top(batches):
        for batch in batches:
            for name, k in zip(column(batch, "task_id").to_pylist(), column(batch, "__task").to_pylist(), strict=True):
                own = weights.value[k - low]
                order = np.lexsort((names, -own))[:TOP]
                yield pa.record_batch({"task_id": pa.array([name] * len(order)), "feature": pa.array([names[j] for j in order]), "importance": pa.array(own[order] / (own.sum() or 1.0))})

    return scored, known.select("task_id", "__task").mapInArrow(top, "task_id string, feature string, importance double"), lists
