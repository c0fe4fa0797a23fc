"""Best-fit packing of tokenized documents into sequences of fixed capacity, planned on counts of lengths.

Documents longer than the capacity are cut into full pieces, the first of which may be shorter. Every piece gets a rank
among the pieces of its length. The planner sees only how many pieces there are of each length, a table of at most
``capacity`` rows whatever the corpus, and works by exact complements: for the longest length left it looks up the gap in
an index of single lengths, of pair sums and of triple sums, and uses the combination that fills the gap exactly as
often as the counts allow. What then remains is placed best fit, longest first. Exact fills may spend early the small pieces
that best fit needs, so several orders of filling are planned and the plan of fewest sequences is kept; it is never
longer than best fit alone. The plan is a table of (length, ranks
from, ranks to, first sequence, offset); tasks look their pieces up in it, so pieces never meet in one place.

Nulls: a null text is empty (its end id alone). Documents of equal length or text, repeated rows too, are told apart by
their ranks. A very long text is encoded whole in its task and gives as many pieces as it needs. An empty table gives no rows. Other columns are not read, whatever their names. A null doc_id is kept as it is.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import small_batches, stored, texts
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
# orders in which exact fills are tried; the last leaves all to best fit, so that no plan is worse than that
ORDERS = ((("single",), ("pair",), ("triple",)), (("single", "pair", "triple"),), (("single",), ("pair",)), (("single",),), ())


class Plan:
    """Patterns of lengths and how often each is used."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.patterns: list[tuple[tuple[int, ...], int]] = []

    def add(self, lengths, times: int) -> None:
        self.patterns.append((tuple(lengths), times))


class Sums:
    """The lengths that are left and how many pairs and triples of them give each sum, kept up to date as lengths run out."""

    def __init__(self, left: np.ndarray, capacity: int, triples: bool):
        self.left, self.have = left, np.zeros(capacity + 1, bool)
        self.pairs, self.triples = np.zeros(2 * capacity + 1, np.int64), np.zeros(3 * capacity + 1, np.int64) if triples else None
        for a in np.flatnonzero(left > 0):
            self.have[a] = True
            self.pairs[a + np.flatnonzero(self.have)] += 1
            if triples:
                self.triples[a:a + len(self.pairs)] += self.pairs

    def enough(self, lengths: list[int]) -> bool:
        own, need = np.unique(lengths, return_counts=True)
        return bool((self.left[own] >= need).all())

    def take(self, lengths: list[int]) -> int:
        """Use a combination as often as the counts allow."""
        own, need = np.unique(lengths, return_counts=True)
        times = int((self.left[own] // need).min())
        self.left[own] -= need * times
        for a in own[self.left[own] == 0]:
            if self.triples is not None:
                self.triples[a:a + len(self.pairs)] -= self.pairs
            self.pairs[a + np.flatnonzero(self.have)] -= 1
            self.have[a] = False
        return times

    def single(self, gap: int, with_: list[int]) -> list[int] | None:
        return [*with_, gap] if self.have[gap] and self.enough([*with_, gap]) else None

    def pair(self, gap: int, with_: list[int]) -> list[int] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        a = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
        for x in a[self.have[a] & self.have[gap - a]].tolist():
            if self.enough([*with_, x, gap - x]):
                return [*with_, x, gap - x]
        return None

    def triple(self, gap: int, with_: list[int]) -> list[int] | None:
        if gap < 3 or not self.triples[gap]:
            return None
        a = np.arange(gap - 2, 0, -1)
        for x in a[self.have[a] & (self.pairs[gap - a] > 0)].tolist():
            if self.enough([*with_, x]) and (found := self.pair(gap - x, [*with_, x])):
                return found
        return None


def complements(counts: np.ndarray, capacity: int, rounds: tuple[tuple[str, ...], ...]) -> tuple[Plan, np.ndarray]:
    """Use combinations of a longest piece and others that fill a sequence exactly.

    ``rounds`` names the indexes that are tried for each length, longest first; the next round begins when all lengths had
    their turn, so that few and large pieces go first and small ones are kept for what nothing else fills.
    """
    plan, left = Plan(capacity), counts.astype(np.int64).copy()
    sums = Sums(left, capacity, any("triple" in kinds for kinds in rounds))
    if left[capacity]:
        plan.add([capacity], sums.take([capacity]))
    for kinds in rounds:
        for longest in range(capacity - 1, 0, -1):
            while left[longest]:
                found = next((f for f in (getattr(sums, kind)(capacity - longest, [longest]) for kind in kinds) if f), None)
                if not found:
                    break
                plan.add(found, sums.take(found))
    return plan, left


def best_fit(plan: Plan, left: np.ndarray) -> None:
    """Place what remains, longest first, each into the fullest open sequences that hold it."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if room == 0:
            plan.add(lengths, times)
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((lengths, times))

    for length in range(len(left) - 1, 0, -1):
        todo = int(left[length])
        while todo:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = plan.capacity // length
                if todo >= each:
                    put(plan.capacity - each * length, (length,) * each, todo // each)
                    todo %= each
                if todo:
                    put(plan.capacity - todo * length, (length,) * todo, 1)
                break
            room = rooms[k]
            lengths, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            each = min(room // length, todo)
            used = min(times, todo // each)
            put(room - each * length, lengths + (length,) * each, used)
            if times > used:
                put(room, lengths, times - used)
            todo -= each * used
    for room in rooms:
        for lengths, times in open_[room]:
            plan.add(lengths, times)


def best_plan(counts: np.ndarray, capacity: int) -> Plan:
    """The plan of fewest sequences, of those that index more or fewer sums before they place the rest best fit."""
    plans = []
    for rounds in ORDERS:
        plan, left = complements(counts, capacity, rounds)
        best_fit(plan, left)
        plans.append(plan)
    return min(plans, key=lambda p: sum(times for _, times in p.patterns))  # the first of equals


def plan_table(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, one past the last rank, first sequence, offset), sorted by length and rank."""
    plan = best_plan(counts, capacity)
    given = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for lengths, times in plan.patterns:
        offset = 0
        for n in lengths:
            rows.append((n, given[n], given[n] + times, sequence, offset))
            given[n] += times
            offset += n
        sequence += times
    if (given != counts).any():
        raise AssertionError("the plan does not place every piece once")
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's rank among those of its length in its task."""
    def run(batches):
        import pyarrow as pa

        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth")}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text) + end, enc.dtype).astype("<u4")
                edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                    for name, v in zip(out, (doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), int(seen[j - i])), strict=True):
                        out[name].append(v)
                    seen[j - i] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            columns = [pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)]
            yield pa.record_batch([*columns, pa.array(np.full(len(columns[0]), task))], names=[*out, "task"])

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    cut = stored(pieces(docs, vocabulary or vocabulary_path(), capacity, end_id), "pieces")
    # ranks over all tasks: what the tasks before have of the same length; a row for each task and length
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    own = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(plan_table(counts, capacity))  # a few rows for each length

    def place(batches):
        import pyarrow as pa

        rows = plan.value
        first = {n: i for i, n in reversed(list(enumerate(rows[:, 0].tolist())))}
        last = {n: i + 1 for i, n in enumerate(rows[:, 0].tolist())}
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("base").to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                at[own] = first[n] + np.searchsorted(rows[first[n]:last[n], 1], rank[own], "right") - 1
            found = rows[at]
            yield pa.record_batch([*(b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = cut.join(bases, ["task", "length"])
    return joined.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
