"""Exact medians of thousands of features by group, without a row for each value.

A double is an integer of the same order (its bits, with negative ones turned round), so a median is found as in a search tree:
every pass counts the values of each group and feature in up to 2,048 equal ranges of a bracket, and the range that holds the middle is the next
bracket, narrowed to the values that it really holds. The first bracket is the mean and one standard deviation to both
sides, which always holds the median. When few values are left, they are gathered and the middle is read off. State is one row of arrays a group, and what a task
sends on is bounded by groups x features x ranges, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import HELD, Held, by_group, column, matrix
from ..sources.scratch import dropped, stored
from .moments import moments

SUMS, VALUES = 32 << 20, 1 << 22  # bytes of counts that a task holds for a group, and values of a group that are gathered


def ranges_of(width: int) -> int:
    """Bits of the number of ranges a pass: 2,048 ranges for up to some hundred features, fewer for thousands, 256 at least."""
    return min(11, max(8, (SUMS // (24 * max(1, width))).bit_length() - 1))


def gathered_of(width: int) -> int:
    """How many values of a feature's bracket are gathered at the end."""
    return min(8192, max(256, VALUES // max(1, width)))


_SIGN = np.int64(-(1 << 63))
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: open: count on; few: so few values are left that they are gathered; done: ``value`` holds.
OPEN, FEW, DONE = 0, 1, 2
_STATE = "lo array<long>, hi array<long>, below array<long>, n array<long>, status array<int>, value array<double>"


def ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits ^ _SIGN, bits)


def unordered(k: np.ndarray) -> np.ndarray:
    return np.where(k < 0, ~(k ^ _SIGN), k).view(np.float64)


def _shift(lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    """By how many bits an offset from lo is shifted so that hi falls into the last of the ranges at most."""
    span = (hi.view(np.uint64) - lo.view(np.uint64)).astype(np.float64)
    need = np.frexp(span + 1)[1]  # never too small; 1 too large at most
    return np.maximum(need - bits, 0).astype(np.uint64)


def _ranges(k: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    """0 below the bracket, 1 to 2 ** bits in it, the next above it."""
    inside = ((k.view(np.uint64) - lo.view(np.uint64)) >> _shift(lo, hi, bits)).astype(np.int64) + 1
    return np.where(k < lo, 0, np.where(k > hi, (1 << bits) + 1, inside))


def _middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = unordered(a), unordered(b)
    return np.where(a == b, low, low / 2 + high / 2 if np.abs([low, high]).max(initial=0) > 1e300 else (low + high) / 2)


def _narrowed(counts: np.ndarray, least: np.ndarray, most: np.ndarray, n: np.ndarray, gather: int):
    """The next bracket, how many values are below it, status and value, from the counts and the extremes of ranges
    (feature, range). The bracket is what the middle range really holds, so equal values end the search at once."""
    first, second = (n - 1) // 2, n // 2
    upto = np.cumsum(counts, 1)
    a, b = (upto <= first[:, None]).sum(1), (upto <= second[:, None]).sum(1)
    at = lambda x, k: np.take_along_axis(x, k[:, None], 1)[:, 0]
    before = np.where(a > 0, at(upto, np.maximum(a - 1, 0)), 0)
    lo, hi = at(least, a), at(most, a)
    # the middle two on both sides of a cut are the last of one range and the first of the next
    one, two = np.where(b > a, hi, lo), np.where(b > a, at(least, b), lo)
    # so many values, or so many different ones: doubles that differ in their last bits are few
    few = (at(upto, a) - before <= gather) | (hi.view(np.uint64) - lo.view(np.uint64) < np.uint64(gather))
    status = np.where((b > a) | (lo == hi), DONE, np.where(few, FEW, OPEN))
    return lo, hi, before, status, np.where(status == DONE, _middle(one, two), np.nan)


def _arrays(group: object, kind: pa.DataType, **columns: np.ndarray) -> pa.Table:
    return pa.table({"group": pa.array([group], kind)} | {k: pa.array([v], pa.list_(pa.from_numpy_dtype(v.dtype))) for k, v in columns.items()})


def _first(values: pa.Table, name: str) -> np.ndarray:
    return values.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).copy()


class _Ranges:
    """Counts, smallest and largest values of (feature, range)."""

    def __init__(self, width: int, bits: int):
        self.each = (1 << bits) + 2
        size = width * self.each
        self.n, self.least, self.most = np.zeros(size, np.int64), np.full(size, _MOST), np.full(size, _LEAST)

    def add(self, i: np.ndarray, at: np.ndarray, k: np.ndarray) -> None:
        where = i * self.each + at
        self.n += np.bincount(where, minlength=len(self.n))
        np.minimum.at(self.least, where, k)
        np.maximum.at(self.most, where, k)

    def rows(self) -> tuple[np.ndarray, ...]:
        own = np.flatnonzero(self.n)
        i, at = np.divmod(own, self.each)
        return i, at, self.n[own], self.least[own], self.most[own]


class _Values:
    """The values of small brackets with their counts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, i: np.ndarray, k: np.ndarray) -> None:
        pairs, n = np.unique(np.stack([i, k], 1), axis=0, return_counts=True)
        self.parts.append((pairs[:, 0], pairs[:, 1], n, pairs[:, 1], pairs[:, 1]))

    def rows(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64),) * 5


def _counted(joined: DataFrame, width: int, kind: str, gather: bool, prepare: Callable) -> DataFrame:
    """(group, i, at, n, least, most): how many values are in each range of the open brackets and their extremes, or (at) which
    values are in the small ones."""

    bits = ranges_of(width)

    def out(name: object, sums) -> pa.RecordBatch:
        i, at, n, least, most = sums.rows()
        return pa.record_batch({"group": pa.array([name] * len(i), sums.kind), "i": pa.array(i, pa.int32()), "at": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64()), "least": pa.array(least, pa.int64()), "most": pa.array(most, pa.int64())})

    def run(batches):
        held = Held(_Values, HELD, out) if gather else Held(lambda: _Ranges(width, bits), width * ((1 << bits) + 2) * 24, out)
        for batch in batches:
            x = matrix(column(batch, "features"), width)
            lists = {c: column(batch, c) for c in ("lo", "hi", "status", "centre") if c in batch.schema.names}
            for name, rows in by_group(batch, "group"):
                own = {c: np.asarray(a[int(rows[0])].values.to_numpy(zero_copy_only=False)) for c, a in lists.items()}
                values = prepare(x[rows], own)
                k, lo, hi = ordered(values), own["lo"], own["hi"]
                use = np.isfinite(values) & (own["status"] == (FEW if gather else OPEN))
                if gather:
                    use &= (k >= lo) & (k <= hi)
                r, i = np.nonzero(use)
                sums, k = held.of(name), k[r, i]
                sums.kind = batch.schema.field("group").type
                sums.add(i, k) if gather else sums.add(i, _ranges(k, lo[i], hi[i], bits), k)
            yield from held.rest() if gather else held.full()
        yield from held.rest()

    return joined.mapInArrow(run, f"group {kind}, i int, at long, n long, least long, most long").groupBy("group", "i", "at").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def _updated(state: DataFrame, counted: DataFrame, width: int, gather: bool) -> DataFrame:
    """The states with the counts taken in: a group's state and at most features x ranges counts meet in a task."""
    bits, few = ranges_of(width), gathered_of(width)

    def update(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        s = {c: _first(left, c) for c in ("lo", "hi", "below", "n", "status", "value")}
        i, at, n, least, most = (right.column(c).to_numpy() for c in ("i", "at", "n", "least", "most"))
        if gather:
            order = np.lexsort((at, i))
            i, at, n = i[order], at[order], n[order]
            edges = np.searchsorted(i, np.arange(width + 1))
            for f in np.flatnonzero(s["status"] == FEW):
                own, upto = at[edges[f]:edges[f + 1]], s["below"][f] + np.cumsum(n[edges[f]:edges[f + 1]])
                pick = own[[int((upto <= (s["n"][f] - 1) // 2).sum()), int((upto <= s["n"][f] // 2).sum())]]
                s["value"][f] = _middle(pick[:1], pick[1:])[0]
            s["status"][s["status"] == FEW] = DONE
        else:
            shape = (width, (1 << bits) + 2)
            counts, low, high = np.zeros(shape, np.int64), np.full(shape, _MOST), np.full(shape, _LEAST)
            counts[i, at], low[i, at], high[i, at] = n, least, most
            o = s["status"] == OPEN
            if o.any():
                got = _narrowed(counts[o], low[o], high[o], s["n"][o], few)
                for c, v in zip(("lo", "hi", "below", "status", "value"), got, strict=True):
                    s[c][o] = v
        s["status"] = s["status"].astype(np.int32)
        return _arrays(left.column("group")[0].as_py(), left.schema.field("group").type, **s)

    kind = state.schema["group"].dataType.simpleString()
    return state.groupBy("group").cogroup(counted.groupBy("group")).applyInArrow(update, f"group {kind}, {_STATE}")


def _select(keyed: DataFrame, state: DataFrame, width: int, prepare: Callable) -> DataFrame:
    """States of which all are done. Passes go on while a bracket is open; each reads the table once."""
    kind = state.schema["group"].dataType.simpleString()
    unfinished = lambda which: F.exists("status", lambda x: x == which)
    extra = ["centre"] if "centre" in keyed.columns else []
    while state.where(unfinished(OPEN)).limit(1).count():
        joined = keyed.join(state.select("group", "lo", "hi", "status").where(unfinished(OPEN)), "group")
        last, state = state, stored(_updated(state, _counted(joined.select("group", "features", *extra, "lo", "hi", "status"), width, kind, False, prepare), width, False), "brackets")
        dropped(last)
    joined = keyed.join(state.select("group", "lo", "hi", "status").where(unfinished(FEW)), "group")
    out = stored(_updated(state, _counted(joined.select("group", "features", *extra, "lo", "hi", "status"), width, kind, True, prepare), width, True), "medians")
    dropped(state)
    return out


def _states(per: DataFrame, low: str, high: str) -> DataFrame:
    """One row of arrays a group from (group, i, n, low, high)."""
    def build(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("i").to_numpy())
        c = {k: rows.column(k).to_numpy(zero_copy_only=False)[order] for k in ("n", "low", "high")}
        n = c["n"].astype(np.int64)
        low, high = (np.nan_to_num(c[k].astype(float), nan=0.0, posinf=np.finfo(float).max, neginf=-np.finfo(float).max) for k in ("low", "high"))
        status = np.where(n > 0, OPEN, DONE).astype(np.int32)
        return _arrays(rows.column("group")[0].as_py(), rows.schema.field("group").type, lo=ordered(low), hi=ordered(np.maximum(high, low)), below=np.zeros(len(n), np.int64), n=n, status=status, value=np.full(len(n), np.nan))

    kind = per.schema["group"].dataType.simpleString()
    return per.select("group", "i", "n", F.expr(low).alias("low"), F.expr(high).alias("high")).groupBy("group").applyInArrow(build, f"group {kind}, {_STATE}")


def medians_and_mads(df: DataFrame, width: int, group: str) -> DataFrame:
    """(group, i, n, min, max, median, mad) of every group (not null) and feature; null without values.

    The median of an even number of values is the mean of the middle two, and the MAD is the median distance from it.
    """
    keyed = df.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), "features")
    per = stored(moments(keyed, width, F.col("group")), "moments")
    std = "sqrt(m2 / n)"
    mid = _select(keyed, stored(_states(per, f"mean - {std}", f"mean + {std}"), "brackets"), width, lambda x, _: x)
    # half of the distances are at most 2 standard deviations; far smaller ones are searched for below the bracket
    far = stored(_states(per, f"{std} / 4096", f"2 * {std}"), "brackets")
    centred = keyed.join(mid.select("group", F.col("value").alias("centre")), "group")

    def away(x: np.ndarray, own: dict) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(x), np.abs(x - own["centre"]), np.nan)

    mad = _select(centred, far, width, away)
    flat = lambda d, name: d.select("group", F.posexplode("value").alias("i", name))
    return per.select("group", "i", "n", "min", "max").join(flat(mid, "median"), ["group", "i"]).join(flat(mad, "mad"), ["group", "i"]).withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("median", "mad")})
