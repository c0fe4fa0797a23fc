"""Average precision by cosine similarity without a row for each pair.

Without labels, a task gets the positives of a key, then the negatives of each key of its queries, then these queries, in this order.
It holds partners as unit vectors, in a file of its own beyond HELD, and ranks a few queries at a time: their similarities to
all positives are one matrix of at most TILE bytes, of negatives only how many stand above each positive is kept. Only the result of
a query leaves the task. Queries of a key with many are dealt to several tasks, each with its copy of the partners; their number
follows the number of cores, so what is shuffled is in proportion to the rows. The time is that of all pairs.

With labels (profiles, a row for each gene, plate or field), rows that may be compared share keys; under each key they are cut into
blocks of a few megabytes, and a pair of blocks is one matrix product. Of the positives of a query their similarities are kept; of its
negatives only how many stand above each positive.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.blocks import HELD, column, matrix
from ..sources.scratch import stored

BLOCK = 2 << 20  # bytes of vectors in a block
TILE = 16 << 20  # bytes of similarities of the queries that are ranked at a time
WORK = 1 << 24  # pairs for which a task of its own is worth while
DIGITS = 12  # similarities that agree so far are ties, which the partner's id decides
NONE = -2.0  # in place of the similarity of a vector of norm 0, below all others


class Side(NamedTuple):
    """Partners of a query agree with it in ``same``, differ from it in all of ``differ``, and, if told so, have the query's label
    (True) or none of its labels (False)."""

    same: list[str]
    differ: list[str]
    label: bool | None = None


# ---------------------------------------------------------------- blocks

def _blocks(df: DataFrame, keys: list[str], rows: int, columns: list[str]) -> DataFrame:
    """keys, ``__k`` (the block), and arrays of the ids, the features in one, and the columns (``of_`` and the name); rows with a null key go."""
    counts = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("__b"))
    placed = df.join(counts, keys).withColumn("__k", F.pmod(F.xxhash64("id"), F.col("__b")))
    members = F.collect_list(F.struct("id", "features", *columns)).alias("m")
    return placed.groupBy(*keys, "__k").agg(members).select(*keys, "__k", F.col("m.id").alias("ids"), F.flatten("m.features").alias("x"), *[F.col(f"m.{c}").alias(f"of_{c}") for c in columns])


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], extra: list[str]) -> DataFrame:
    """Every block of queries with every block of partners under the same keys. Where a key has many blocks of queries, they
    go to different tasks, each with its copies of the partners' blocks."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = left.groupBy(*keys).agg(F.least(F.count("*"), F.lit(parts)).alias("__n"))
    a = left.join(salts, keys).withColumn("__s", F.pmod("__k", "__n"))
    b = right.join(salts, keys).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    b = b.select(*keys, "__s", *[F.col(c).alias(f"__{c}") for c in ("ids", "x", *[f"of_{c}" for c in columns])])
    return a.join(b, [*keys, "__s"]).select(*keys, "ids", "x", *[f"of_{c}" for c in [*columns, *extra]], "__ids", "__x", *[f"__of_{c}" for c in columns])


def _values(batch: pa.RecordBatch, name: str, r: int) -> pa.Array:
    return column(batch, name)[r].values


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that agree where the values do; -1 for null."""
    both = pa.concat_arrays([a, b]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return both[:len(a)], both[len(a):]


def _unit(x: pa.Array, width: int) -> np.ndarray:
    return _normed(matrix(x, width))


def _normed(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / length  # a vector of norm 0 becomes NaN


class _Met:
    """A block of queries beside a block of partners: similarities, and who may be whose partner."""

    def __init__(self, batch: pa.RecordBatch, r: int, side: Side):
        self.ids, self.partners = _values(batch, "ids", r), _values(batch, "__ids", r)
        n, m = len(self.ids), len(self.partners)
        own, other = (_values(batch, c, r).to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(k, -1) for c, k in (("x", n), ("__x", m)))
        raw = _normed(own) @ _normed(other).T
        self.sims = np.where(np.isnan(raw), NONE, np.round(raw, DIGITS))
        a, b = _codes(self.ids, self.partners)
        self.mask = a[:, None] != b[None, :]
        for c in side.differ:
            a, b = _codes(_values(batch, f"of_{c}", r), _values(batch, f"__of_{c}", r))
            self.mask &= (a[:, None] != b[None, :]) & (a >= 0)[:, None] & (b >= 0)[None, :]
        self.labels = None
        if side.label is not None:
            own, other = ([x or [] for x in _values(batch, c, r).to_pylist()] for c in ("of_labels", "__of_labels"))
            members: dict[str, np.ndarray] = {}
            for k, names in enumerate(other):
                for name in names:
                    members.setdefault(name, np.zeros(m, bool))[k] = True
            self.labels, self.members, self.none = own, members, np.zeros(m, bool)

    def having(self, label: str) -> np.ndarray:
        return self.members.get(label, self.none)


def _emit(batch: pa.RecordBatch, r: int, run: list[str], n: int) -> dict[str, pa.Array]:
    return {c: pa.array([column(batch, c)[r].as_py()] * n, batch.schema.field(c).type) for c in run}


# ---------------------------------------------------------------- positives, then what stands above them

def _positives(pairs: DataFrame, side: Side, run: list[str], schema: StructType) -> DataFrame:
    def meet(batches):
        for batch in batches:
            for r in range(len(batch)):
                met = _Met(batch, r, side)
                rows, labels, sims, partners = [], [], [], []
                for q in range(len(met.ids)):
                    for label in met.labels[q] if side.label else [None]:
                        own = np.flatnonzero(met.mask[q] & met.having(label) if side.label else met.mask[q])
                        if len(own):
                            rows.append(q)
                            labels.append(label)
                            sims.append(met.sims[q, own])
                            partners.append(met.partners.take(pa.array(own)))
                if rows:
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sims])]).astype(np.int32))
                    yield pa.record_batch(_emit(batch, r, run, len(rows)) | {
                        "id": met.ids.take(pa.array(rows)), "label": pa.array(labels, pa.string()),
                        "sims": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sims))), "partners": pa.ListArray.from_arrays(ends, pa.concat_arrays(partners))})

    found = pairs.mapInArrow(meet, schema)
    return found.groupBy(*run, "id", "label").agg(F.flatten(F.collect_list("sims")).alias("sims"), F.flatten(F.collect_list("partners")).alias("partners"))


def _sorted(p: dict) -> tuple[np.ndarray, list]:
    """Similarities and partners of a query's positives, from the first."""
    order = sorted(range(len(p["sims"])), key=lambda k: (-p["sims"][k], p["partners"][k]))
    return np.array([p["sims"][k] for k in order]), [p["partners"][k] for k in order]


def _above(sims: np.ndarray, ids: list, positive: np.ndarray, partners: list) -> np.ndarray:
    """How many of some rows stand above each positive."""
    order = np.sort(sims)
    low, high = np.searchsorted(order, positive, "left"), np.searchsorted(order, positive, "right")
    out = len(order) - high
    for k in np.flatnonzero(high > low):
        out[k] += sum(ids[j] < partners[k] for j in np.flatnonzero(sims == positive[k]))
    return out


def _negatives(pairs: DataFrame, side: Side, run: list[str], schema: StructType) -> DataFrame:
    labelled = side.label is not None

    def handed(held: dict, kinds: dict):
        keys = list(held)
        yield pa.record_batch({c: pa.array([k[0][j] for k in keys], kinds[c]) for j, c in enumerate(run)} | {
            "id": pa.array([k[1] for k in keys], kinds["ids"]), "label": pa.array([k[2] for k in keys], pa.string()),
            "n_neg": pa.array([v[0] for v in held.values()], pa.int64()), "above": pa.array([v[1] for v in held.values()], pa.list_(pa.int64()))})

    def meet(batches):
        held, size, kinds = {}, 0, {}
        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in run} | {"ids": batch.schema.field("ids").type.value_type}
            for r in range(len(batch)):
                met = _Met(batch, r, side)
                where, names, ids = tuple(column(batch, c)[r].as_py() for c in run), met.ids.to_pylist(), met.partners.to_pylist()
                found = _values(batch, "of_positives", r).to_pylist()
                for q, name in enumerate(names):
                    own = met.mask[q]
                    if labelled:
                        for label in met.labels[q]:
                            own = own & ~met.having(label)
                    own = np.flatnonzero(own)
                    if not len(own):
                        continue
                    of = {p["label"]: p for p in found[q] or []}
                    for label in met.labels[q] if labelled else [None]:
                        key = (where, name, label)
                        if key not in held:
                            held[key] = [0, np.zeros(len(of[label]["sims"]) if label in of else 0, np.int64)]
                            size += 200 + 8 * len(held[key][1])
                        held[key][0] += len(own)
                        if label in of:
                            if "order" not in of[label]:
                                of[label]["order"] = _sorted(of[label])
                            held[key][1] += _above(met.sims[q, own], [ids[k] for k in own], *of[label]["order"])
                if size > HELD:
                    yield from handed(held, kinds)
                    held, size = {}, 0
        if held:
            yield from handed(held, kinds)

    found = pairs.mapInArrow(meet, schema)
    add = F.aggregate(F.collect_list("above"), F.lit(None).cast("array<long>"), lambda s, x: F.when(s.isNull(), x).otherwise(F.zip_with(s, x, lambda a, b: a + b)))
    return found.groupBy(*run, "id", "label").agg(F.sum("n_neg").alias("n_neg"), add.alias("above"))


# ---------------------------------------------------------------- without labels: a few queries at a time beside all their partners

class _Partners:
    """Partners of a key: ids, codes of what must differ, and unit vectors, which go to a file when they get too many."""

    def __init__(self, known: dict[str, dict], width: int):
        self.known, self.width, self.n, self.held, self.size, self.file = known, width, 0, [], 0, None
        self.ids: list[pa.Array] = []
        self.parts: dict[str, list[np.ndarray]] = {c: [] for c in known}
        self.whole: dict[str, np.ndarray] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        x = _unit(column(batch, "features"), self.width)
        self.ids.append(column(batch, "id"))
        for c, codes in self.known.items():
            self.parts[c].append(_coded(column(batch, c), codes))
        self.n, self.size = self.n + len(x), self.size + x.nbytes
        self.held.append(x)
        if self.size > HELD:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
            for own in self.held:
                self.file.write(own.tobytes())
            self.file.flush()
            self.held, self.size = [], 0
        self.whole = {}

    def codes(self, name: str) -> np.ndarray:
        if name not in self.whole:
            self.whole[name] = np.concatenate([*self.parts[name], np.zeros(0, np.int64)])
        return self.whole[name]

    def blocks(self, rows: int) -> Iterator[tuple[int, np.ndarray]]:
        """Places and vectors of a few partners after another."""
        at, each = 0, 8 * self.width
        filed = os.fstat(self.file.fileno()).st_size // each if self.file else 0
        while at < filed:
            n = min(rows, filed - at)
            yield at, np.frombuffer(os.pread(self.file.fileno(), n * each, at * each)).reshape(n, self.width)
            at += n
        for own in self.held:
            for k in range(0, len(own), rows):
                yield at + k, own[k:k + rows]
            at += len(own)


def _coded(values: pa.Array, known: dict) -> np.ndarray:
    """Numbers that agree where the values do, in all batches of a key; -1 for null."""
    own = values.dictionary_encode()
    names = np.array([known.setdefault(v, len(known)) for v in own.dictionary.to_pylist()] + [-1], np.int64)
    return names[own.indices.fill_null(-1).to_numpy(zero_copy_only=False)]


def _similar(x: np.ndarray, own: dict[str, np.ndarray], partners: _Partners, low: int, y: np.ndarray, differ: list[str]) -> np.ndarray:
    """Similarities of queries and partners, NaN where the two may not meet."""
    raw = x @ y.T
    out = np.where(np.isnan(raw), NONE, np.round(raw, DIGITS))
    for c in ("id", *differ):
        a, b = own[c][:, None], partners.codes(c)[None, low:low + len(y)]
        out[(a == b) if c == "id" else (a == b) | (a < 0) | (b < 0)] = np.nan
    return out


def _ranked(batch: pa.RecordBatch, positives: _Partners, negatives: _Partners, pos: Side, neg: Side, run: list[str], rows: int, order: list):
    """Counts and average precision of the queries of a batch, which all have these partners."""
    each = max(1, TILE // (8 * max(1, positives.n, rows)))
    for start in range(0, len(batch), each):
        part = batch.slice(start, each)
        x, n = _unit(column(part, "features"), positives.width), len(part)
        own = {c: _coded(column(part, c), codes) for c, codes in positives.known.items()}
        sims = np.full((n, positives.n), np.nan)
        for low, y in positives.blocks(rows):
            sims[:, low:low + len(y)] = _similar(x, own, positives, low, y, pos.differ)
        n_pos = (~np.isnan(sims)).sum(1)
        up = np.sort(sims, 1)  # NaN last
        n_neg, above = np.zeros(n, np.int64), np.zeros(sims.shape, np.int32 if negatives.n < 1 << 31 else np.int64)
        for low, y in negatives.blocks(4 * rows):
            met = _similar(x, own, negatives, low, y, neg.differ)
            m = (~np.isnan(met)).sum(1)
            n_neg += m
            ordered = np.sort(met, 1)
            for q in np.flatnonzero((m > 0) & (n_pos > 0)):
                mine, theirs = up[q, :n_pos[q]], ordered[q, :m[q]]
                high = theirs.searchsorted(mine, "right")
                if (theirs.searchsorted(mine, "left") == high).all():
                    above[q, :n_pos[q]] += (m[q] - high).astype(above.dtype)
                    continue
                if not order:  # ties: numbers of the ids in their order, made once for these partners
                    order.append(pc.rank(pa.concat_arrays([*positives.ids, *negatives.ids]), tiebreaker="dense").to_numpy().astype(np.int64))
                a, b = np.flatnonzero(~np.isnan(sims[q])), np.flatnonzero(~np.isnan(met[q]))
                ids = np.concatenate([1 - 2 * order[0][a], -2 * order[0][positives.n + low + b]])
                upward = np.lexsort((ids, np.concatenate([sims[q, a], met[q, b]])))
                is_neg = upward >= len(a)
                above[q, :n_pos[q]] += (m[q] - np.cumsum(is_neg)[~is_neg]).astype(above.dtype)
        ap = np.full(n, np.nan)
        for q in np.flatnonzero(n_pos):
            k = np.arange(n_pos[q], 0, -1.0)
            ap[q] = (k / (k + above[q, :n_pos[q]])).mean()
        met = np.flatnonzero(n_pos + n_neg)
        if len(met):
            taken = part.take(pa.array(met))
            yield pa.record_batch({c: column(taken, f"run_{c}") for c in run} | {"id": column(taken, "id"), "n_pos": pa.array(n_pos[met]), "n_total": pa.array((n_pos + n_neg)[met]), "ap": pa.array(ap[met], mask=n_pos[met] == 0)})


def _key(names: list[str]) -> Column:
    """The values of some columns as one, null where any is null."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names], F.lit(True))
    return F.when(known, F.struct(*[F.col(c) for c in names] or [F.lit(0).alias("one")]))


def _unlabelled(queries: DataFrame, pool: DataFrame, pos: Side, neg: Side, run: list[str], rows: int, width: int) -> DataFrame:
    spark = pool.sparkSession
    differ = list(dict.fromkeys([*pos.differ, *neg.differ]))
    keys = {"__pos": _key(list(dict.fromkeys([*run, *pos.same]))), "__neg": _key(list(dict.fromkeys([*run, *neg.same])))}
    queries, pool = queries.withColumns(keys).where("__pos is not null or __neg is not null"), pool.withColumns(keys)
    # queries of a key are dealt to so many tasks
    count = lambda d, k, n: d.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias(n))
    met = queries.groupBy("__pos", "__neg").agg(F.count("*").alias("__q")).join(count(pool, "__pos", "__p"), "__pos", "left").join(count(pool, "__neg", "__m"), "__neg", "left")
    work = met.groupBy("__pos").agg(F.sum(F.col("__q") * (F.coalesce("__p", F.lit(0)) + F.coalesce("__m", F.lit(0)))).alias("__w"))
    share = F.col("__w") / F.greatest("__all", F.lit(1)) * 4 * spark.sparkContext.defaultParallelism
    tasks = work.crossJoin(work.agg(F.sum("__w").alias("__all"))).select(F.col("__pos").alias("__own"), F.greatest(F.lit(1), F.least(F.ceil(F.col("__w") / WORK), F.ceil(share))).alias("__n"))  # one row of a sum
    asked = queries.join(tasks, F.col("__pos").eqNullSafe(F.col("__own"))).withColumn("__s", F.pmod(F.xxhash64("id"), "__n"))
    turns = asked.select("__pos", "__s", "__neg").distinct()
    kinds = {c: pool.schema[c].dataType for c in run}

    def rows_of(df: DataFrame, role: int) -> DataFrame:
        own = [(F.col(c) if role == 2 else F.lit(None).cast(kinds[c])).alias(f"run_{c}") for c in run]
        other = F.lit(None).cast(queries.schema["__neg"].dataType) if role == 0 else F.col("__neg")
        return df.select("__pos", "__s", other.alias("__neg"), F.lit(role).alias("__role"), "id", "features", *[F.col(c).alias(f"of_{c}") for c in differ], *own)

    every = rows_of(pool.drop("__neg").join(turns.select("__pos", "__s").distinct(), "__pos"), 0)
    every = every.unionAll(rows_of(pool.drop("__pos").join(turns, "__neg"), 1)).unionAll(rows_of(asked, 2))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    placed = every.repartition(parts, "__pos", "__s").sortWithinPartitions("__pos", "__s", "__neg", "__role")  # null first: positives
    marks = [F.xxhash64(F.col("__pos").isNull(), "__pos", "__s").alias("g"), F.xxhash64(F.col("__neg").isNull(), "__neg").alias("h"), F.col("__role").alias("role")]
    pos, neg = pos._replace(differ=[f"of_{c}" for c in pos.differ]), neg._replace(differ=[f"of_{c}" for c in neg.differ])

    def meet(batches):
        fresh = lambda known: _Partners(known, width)
        group = turn = positives = negatives = None
        order: list = []
        for batch in batches:
            g, h, role = (column(batch, c).to_numpy() for c in ("g", "h", "role"))
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (role[1:] != role[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                own = batch.slice(low, high - low)
                if not len(own):
                    continue
                if g[low] != group:
                    positives = fresh({c: {} for c in ("id", *[f"of_{c}" for c in differ])})
                if g[low] != group or h[low] != turn:
                    negatives, order = fresh(positives.known), []
                group, turn = g[low], h[low]
                if role[low] < 2:
                    (negatives if role[low] else positives).add(own)
                else:
                    yield from _ranked(own, positives, negatives, pos, neg, run, rows, order)

    head = "".join(f"`{c}` {kinds[c].simpleString()}, " for c in run)
    return placed.select(*marks, "id", "features", *[f"of_{c}" for c in differ], *[f"run_{c}" for c in run]).mapInArrow(meet, f"{head}id {pool.schema['id'].dataType.simpleString()}, n_pos long, n_total long, ap double")


def precision(queries: DataFrame, pool: DataFrame, pos: Side, neg: Side, run: list[str]) -> DataFrame:
    """run, id, label, n_pos, n_total and ap (null without positives) of every query and, with labels, every label of it.

    ``queries`` and ``pool`` have id, features, the columns of both sides and run; ids are told apart within a run. Ranks
    go by similarity, then partner id; vectors of norm 0 come last. Queries without any partner have no row.
    """
    one = "__one"
    run = list(run)
    used = list(dict.fromkeys([*pos.differ, *neg.differ, *(["labels"] if pos.label is not None else [])]))
    queries, pool = (d.withColumn(one, F.lit(0)) for d in (queries, pool))
    width = pool.select(F.size("features").alias("n")).where("n > 0").first()
    rows = max(1, BLOCK // (8 * width["n"])) if width else 1
    if pos.label is None and neg.label is None:
        return _unlabelled(queries, pool, pos, neg, run, rows, width["n"] if width else 1).withColumn("label", F.lit(None).cast("string"))
    kind, types = pool.schema["id"].dataType.simpleString(), {c: pool.schema[c].dataType.simpleString() for c in run}
    head = "".join(f"`{c}` {types[c]}, " for c in run)
    keys = lambda side: list(dict.fromkeys([*run, *side.same])) or [one]
    blocks = lambda d, side, extra=(): _blocks(d, keys(side), rows, [*used, *extra])
    met = _pairs(blocks(queries, pos), blocks(pool, pos), keys(pos), used, [])
    positives = stored(_positives(met, pos, run, f"{head}id {kind}, label string, sims array<double>, partners array<{kind}>"), "positives")
    own = positives.groupBy(*run, "id").agg(F.collect_list(F.struct("label", "sims", "partners")).alias("positives"))
    asked = queries.join(own, [*run, "id"], "left")
    met = _pairs(blocks(asked, neg, ["positives"]), blocks(pool, neg), keys(neg), used, ["positives"])
    negatives = _negatives(met, neg, run, f"{head}id {kind}, label string, n_neg long, above array<long>")
    m, n = positives.select(*run, "id", "label", F.size("sims").cast("long").alias("n_pos")), negatives
    on = F.lit(True)
    for c in [*run, "id", "label"]:
        on = on & m[c].eqNullSafe(n[c])
    both = m.join(n, on, "full").select(*[F.coalesce(m[c], n[c]).alias(c) for c in [*run, "id", "label"]], F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg"), "above")
    steps = F.transform("above", lambda x, k: (k + 1) / (k + 1 + x))
    hit = F.when(F.col("n_neg") == 0, 1.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.col("n_pos"))
    return both.select(*run, "id", "label", "n_pos", (F.col("n_pos") + F.col("n_neg")).alias("n_total"), F.when(F.col("n_pos") > 0, hit).alias("ap"))
