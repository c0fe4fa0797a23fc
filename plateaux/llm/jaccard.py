"""Exact n-gram Jaccard join by partitioned universes, and its linked groups.

A document's set are the 64-bit hashes of its distinct shingles. Sets of similar size share a *scheme*: the hash universe
is cut into segments, and each segment has an allocation of 1 (the two sets must agree on it) or 2 (they may differ there
by one element; sets index their one-deletion neighbourhoods). Two sets whose Jaccard similarity reaches the threshold
differ in at most ``H`` elements, so if the allocations of one set's non-empty segments add up to more than H, at least
one segment must match, and its signature meets in one bucket. A cost model picks, for each size band, how many segments
get 1 or 2, with slack for empty segments; a set whose own allocations still fall short also goes to a second and third
universe and at last to a bucket of the band, so no pair is lost.

Buckets are not expanded into pairs. Every member is compared with its bucket's hub, the member that meets most others,
on the whole sets; members similar to the hub are one group. What may be left are pairs of which at least one is not
similar to their hub h, and which share a bucket all the same. Buckets of a few members with several groups give their pairs;
members of no larger one are done. Write D(x) for the symmetric difference of x and h: x and y differ in |D(x)| + |D(y)| - 2 |D(x)
and D(y) share| elements, so such a similar pair must share many elements of D. Those pairs are found with an index of
prefixes of D under each hub (elements foreign to the hub first, as they are rare; a match at places i and j bounds what
can still be shared), unless both are in one linked group already, and verified on the whole sets. So near copies that
differ from each other too much never become pairs, however many there are. Linked groups come from min-label propagation
with shortcuts over stored edge tables.

Nulls: a null text or one without words has an empty set, links with nothing and is its own component. Fewer words than a
shingle make one element. Rows that share a doc_id are one node; a null doc_id gets its set size and a null component. An
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACED, WordHasher, _odd, dropped, fits_broadcast, mix, semi, small_batches, stored, texts, utf8

WORDS = 4
SIMILARITY = 85  # per cent
LEVELS = 3
SEEN = 50_000
COMMON, BITS = 32, 24
FEW = 4  # members of a bucket that are paired with each other


# ---------------------------------------------------------------- sets

_STEPS = _odd(91, 16)
_EXTRA = _odd(92, 2 * LEVELS + 6)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document of a batch."""
    starts, ends = hasher.spans(data, offsets)
    h = hasher.hashes(data, starts, ends)
    n = len(h)
    every = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words):
        every += h[j:j + len(every)] * _STEPS[j]
    every = mix(every)
    cut = np.searchsorted(starts, offsets)
    out = []
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if j - i >= words:
            s = np.sort(every[i:j - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif j > i:
            out.append(mix(np.array([np.sum(h[i:j] * _STEPS[:j - i]) + np.uint64(j - i)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---------------------------------------------------------------- schemes

def band_lows(largest: int, similarity: int = SIMILARITY) -> list[int]:
    """Smallest size of each band; sets of similar pairs are in one band or in neighbours."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(lows[-1] * 100 // similarity + 1)
    return lows


def difference(size: int, similarity: int = SIMILARITY) -> int:
    """The most elements in which two similar sets of at most this size differ."""
    return (100 - similarity) * 2 * size // (100 + similarity)


def allocate(size: float, most: int, population: float, common: float = 0.01) -> tuple[int, int]:
    """(segments with allocation 1, segments with allocation 2) of least cost for sets of at least this size.

    The cost is the number of signatures plus a fifth of the chance meetings expected in a band of ``population`` sets
    when this share of all elements is common to many sets: larger segments meet less, deletions write more.
    """
    best = None
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        need = most + 1
        for _ in range(6):  # the slack depends on the segment size and the other way round
            two = round(need * share / 2)
            one = max(0, need - 2 * two)
            t = size / max(1, one + two)
            empty = (one + 2 * two) * math.exp(-t)
            slack = math.ceil(empty + 3 * math.sqrt(empty) + 1) if one + two > 1 else 0
            need = most + 1 + slack
        two = round(need * share / 2)
        one = max(0, need - 2 * two)
        t = size / (one + two)
        alike = common * t * math.exp(-t)
        near = alike * (1 + t)
        cost = one + two * (t + 1) + 0.2 * population * (one * alike**2 + two * near**2)
        if best is None or cost < best[0]:
            best = (cost, one, two)
    return best[1:]


class Schemes:
    def __init__(self, population: float, similarity: int = SIMILARITY):
        self.population, self.similarity = population, similarity
        self.lows = band_lows(64, similarity)
        self.known: dict[int, tuple[int, int, int]] = {}

    def bands(self, n: int) -> list[int]:
        while self.lows[-1] <= 2 * n:
            self.lows.append(self.lows[-1] * 100 // self.similarity + 1)
        k = bisect_right(self.lows, n) - 1
        return [k, k + 1] if 100 * n >= self.similarity * self.lows[k + 1] else [k]

    def scheme(self, k: int) -> tuple[int, int, int]:
        if k not in self.known:
            high = self.lows[k + 1] - 1
            most = difference(high, self.similarity)
            self.known[k] = (most, *allocate(self.similarity * self.lows[k] / 100, most, self.population))
        return self.known[k]

    def signatures(self, s: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """Bucket keys of a set of sorted hashes; equal segments of sets in one scheme have equal keys.

        Segments of ``common`` elements alone are left out where the others suffice: whether a segment is left out depends
        on its elements only, so two sets agree on it.
        """
        out = []
        plain = np.zeros(len(s), bool)
        for k in self.bands(len(s)):
            most, one, two = self.scheme(k)
            for level in range(LEVELS + 1):
                if level <= 1:
                    h, held = s, plain if common is None or level else common
                else:
                    h, held = np.sort(mix(s ^ _EXTRA[level - 1])), plain
                keys, enough = self._segments(h, held, one, two, most)
                out.append(mix(keys + np.array([(k * (LEVELS + 1) + max(0, level - 1)) * 2 + 1], np.uint64) * _EXTRA[LEVELS]))
                if enough:
                    break
            else:
                out.append(mix(np.array([k], np.uint64) * _EXTRA[LEVELS + 1]))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    @staticmethod
    def _segments(h: np.ndarray, common: np.ndarray, one: int, two: int, most: int) -> tuple[np.ndarray, bool]:
        m = one + two
        segment = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # in order, as h is
        edge = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
        value = mix(h ^ _EXTRA[LEVELS + 2])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        seen = np.concatenate([[0], np.cumsum(~common)])
        rare = seen[edge[1:]] - seen[edge[:-1]]
        count = np.diff(edge)
        sums = total[edge[1:]] - total[edge[:-1]]
        names = np.arange(m, dtype=np.uint64) * _EXTRA[LEVELS + 3]
        full = rare > 0
        keys = mix(sums[full] + names[full])
        if two:  # the first segments have allocation 2
            at = segment.astype(np.int64)
            own = np.flatnonzero((at < two) & (count[at] > 1) & (rare[at] > ~common))
            at = at[own]
            keys = np.concatenate([keys, mix(sums[at] - value[own] + names[at])])
        worth = int(np.minimum(rare[:two], 2).sum() + full[two:].sum())
        return keys, worth > most


# ---------------------------------------------------------------- common elements

class Tally:
    """Elements that many sets of a task have, with how many: counted in windows of ``SPAN`` elements by hashed counters."""

    SPAN, LEAST = 1 << 21, 4

    def __init__(self):
        self.counter, self.added = np.zeros(1 << 22, np.uint16), 0
        self.found: list[np.ndarray] = []

    def add(self, elements: np.ndarray) -> None:
        at = (elements >> np.uint64(42)).astype(np.int64)
        np.add.at(self.counter, at, 1)
        self.found.append(elements[self.counter[at] >= self.LEAST])
        self.added += len(elements)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The elements of a full window and their counts."""
        own, n = np.unique(np.concatenate([*self.found, np.zeros(0, np.uint64)]), return_counts=True)
        self.counter[:], self.added, self.found = 0, 0, []
        return own, n


def common_bits(docs: DataFrame, words: int) -> np.ndarray:
    """Bits, by the upper ``BITS`` of an element's hash, of the elements that ``COMMON`` sets or more have.

    All documents are counted. What falls short in the window of a task is not; that, and bits that elements share, change
    only which segments are left out, never which pairs are found.
    """
    def run(batches):
        import pyarrow as pa

        hasher, tally, seen = WordHasher(SPACED), Tally(), {}
        row = lambda own, n: pa.record_batch([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["e", "n"])
        for b in batches:
            fresh = []
            for s in shingle_sets(*utf8(b.column(1)), hasher, words):
                key = (len(s), int(s.sum(dtype=np.uint64)))
                if len(s) and key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[key] = True
                    fresh.append(s)
            if fresh:
                tally.add(np.concatenate(fresh))
            if tally.added >= tally.SPAN:
                yield row(*tally.taken())
        yield row(*tally.taken())

    counted = texts(docs, "doc_id").mapInArrow(run, "e long, n long").groupBy("e").agg(F.sum("n").alias("n"))
    place = F.shiftrightunsigned("e", 64 - BITS)
    rows = counted.where(F.col("n") >= COMMON).groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    bits = np.zeros((1 << BITS - 15, 4096), np.uint8)
    for r in rows.collect():  # a fixed size: 512 rows of 4 kB at most
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(-1)


def is_common(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    place = (s >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


# ---------------------------------------------------------------- Spark steps

def _set_rows(docs: DataFrame, schemes: Schemes, words: int, bits: np.ndarray) -> DataFrame:
    """doc_id, n, k1, k2 (which together tell sets apart) and signatures, those of recent copies left out."""
    known = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import pyarrow as pa

        hasher, seen = WordHasher(SPACED), {}
        for b in batches:
            n, k1, k2, keys, ends = [], [], [], [], [0]
            for s in shingle_sets(*utf8(b.column(1)), hasher, words):
                a, c = int(mix(s ^ _EXTRA[LEVELS + 4]).sum(dtype=np.uint64)), int(mix(s ^ _EXTRA[LEVELS + 5]).sum(dtype=np.uint64))
                n.append(len(s))
                k1.append(a)
                k2.append(c)
                if len(s) and (a, c) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[a, c] = True
                    keys.append(schemes.signatures(s, is_common(known.value, s)))
                    ends.append(ends[-1] + len(keys[-1]))
                else:
                    ends.append(ends[-1])
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            column = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), column(k1), column(k2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "n", "k1", "k2", "signatures"])

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, signatures array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(SPACED)
        for b in batches:
            sets = shingle_sets(*utf8(b.column(1)), hasher, words)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "elements"])

    return texts(docs, "doc_id").mapInArrow(run, "id long, elements array<long>")


def hub_pairs(active: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a: member, b: hub of one of its buckets), with the size of the hub's smallest member; and the buckets they come
    from (bucket, a, b), of two members or more that are not the hub.

    A hub need not lie in its bucket: it only has to be one for all members. Members look for the set that meets most
    others in any of their buckets, as the middle of a group of near copies does, and a bucket takes the best that its
    members found, so one hub serves most buckets of a group.
    """
    meetings = stored(active.groupBy("rep").agg(F.sum("c").alias("meetings")), "meetings")
    light = fits_broadcast(meetings, 24)
    known = meetings.select("rep", F.struct("meetings", "rep").alias("best"))
    several = active.join(F.broadcast(known) if light else known, "rep").groupBy("bucket").agg(F.max("best").alias("best"), F.min("rep").alias("low"), F.max("rep").alias("high"))
    found = stored(active.join(stored(several.where("low < high").select("bucket", "best"), "several"), "bucket").select("bucket", "rep", "best"), "found")
    pivot = stored(found.groupBy("rep").agg(F.max("best").alias("pivot")), "pivots")
    hubs = found.select("bucket", "rep").join(F.broadcast(pivot) if light else pivot, "rep").groupBy("bucket").agg(F.max("pivot")["rep"].alias("hub"))
    placed = found.join(stored(hubs, "bucket_hubs"), "bucket").where("rep <> hub").select("bucket", F.col("rep").alias("a"), F.col("hub").alias("b"))
    pairs = stored(placed.select("a", "b").distinct().join(sizes, F.col("a") == F.col("rep")).select("a", "b", "n"), "pairs")
    return pairs.join(stored(pairs.groupBy("b").agg(F.min("n").alias("least")), "smallest"), "b").select("a", "b", "least"), placed


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sets and the size of what they share."""
    one = sets.select(F.col("id").alias("a"), F.col("elements").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("elements").alias("right"))
    return pairs.join(one, "a").join(two, "b").withColumns({"na": F.size("left"), "nb": F.size("right"), "both": F.size(F.array_intersect("left", "right"))})


def _similar(similarity: int) -> Column:
    return 100 * F.col("both") >= similarity * (F.col("na") + F.col("nb") - F.col("both"))


def _over(x: Column, by: int) -> Column:
    """x / by, rounded up."""
    return F.ceil(x / by).cast("int")


def against_hubs(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a: member, b: hub) with the sizes na, nb, how many of the hub's elements the member misses and how many it has
    besides, whether similar, and the starts of these two differences (``extra``, ``missing``) that can meet a similar
    member's. ``least`` of a pair is the size of the hub's smallest member."""
    rows = _with_sets(pairs, sets).withColumn("similar", _similar(similarity))
    scale = 100 + similarity
    # x and y can share what they share with the hub, at most nb less the larger miss, and extra elements
    lacks = similarity * (F.col("na") + F.greatest("least", _over(similarity * F.col("na"), 100))) - scale * F.col("both")
    own = rows.withColumns({"missed": F.col("nb") - F.col("both"), "more": F.col("na") - F.col("both"), "need": _over(lacks, scale)})
    behind = _over(similarity * (F.col("na") + F.col("nb")) - scale * F.col("both"), scale)  # how far a member falls short of the hub
    start = lambda array, n, least: F.slice(F.array_sort(array), F.lit(1), F.greatest(F.lit(0), n - F.greatest(F.lit(1), least) + 1).cast("int"))
    missing = F.when(F.col("need") <= 0, start(F.array_except("right", "left"), F.col("missed"), behind)).otherwise(F.array().cast("array<long>"))
    return own.select("a", "b", "na", "nb", "missed", "more", "similar", start(F.array_except("left", "right"), F.col("more"), F.col("need")).alias("extra"), missing.alias("missing"))


def _may_meet(similarity: int) -> Column:
    """Two members (a, _a) of different groups whose sizes allow that they are similar, each pair once."""
    return (100 * F.least("na", "_na") >= similarity * F.greatest("na", "_na")) & (F.col("a") < F.col("_a")) & (F.col("group") != F.col("_group"))


def open_buckets(rows: DataFrame, placed: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of members that share a bucket of at most FEW and may be similar, and members (a) of larger buckets with
    several groups.

    Similar members share a bucket. Most that share a hub do not: they met it, or one other member, by chance, and such
    meetings grow faster than the documents. A bucket of a few gives its pairs, at most (FEW - 1) / 2 for each of its rows.
    ``rows`` are pairs of members and hubs with the member's ``group``, ``placed`` the buckets of these pairs; only those of
    hubs with several groups are read on.
    """
    mixed = lambda df, key: df.groupBy(key).agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("members")).where("low < high").drop("low", "high")
    own = rows.join(stored(mixed(rows, "b").drop("members"), "hubs"), "b", "left_semi").select("a", "b", "na", "nb", "missed", "more", "group")
    met = stored(placed.join(own, ["a", "b"]).drop("b"), "met")
    met = stored(met.join(stored(mixed(met, "bucket"), "open_buckets"), "bucket"), "open_members")
    few = met.where(F.col("members") <= FEW)
    other = few.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("a", "na", "missed", "more", "group")])
    # what both share with the hub, and all that one has besides
    both = F.col("nb") - F.greatest("missed", "_missed") + F.least("more", "_more")
    fits = _may_meet(similarity) & ((100 + similarity) * both >= similarity * (F.col("na") + F.col("_na")))
    return few.join(other, "bucket").where(fits).select("a", F.col("_a").alias("b")).distinct(), met.where(F.col("members") > FEW).select("a").distinct()


def around_hubs(compared: DataFrame, groups: DataFrame, placed: DataFrame, similarity: int) -> DataFrame:
    """Pairs of members of one hub that are not yet in one group and may be similar.

    Buckets of a few members give their pairs; elements are only spread of members of larger ones that hold several groups.
    Members may meet under several hubs. Two that have the same nearest hub are looked at under that one only, where what
    sets them apart is smallest; a hub is its own nearest.
    """
    scale = 100 + similarity
    nearest = compared.groupBy("a").agg(F.min(F.struct(F.col("missed") + F.col("more"), "b"))["b"].alias("nearest"))
    itself = compared.select(F.col("b").alias("a")).distinct().withColumn("nearest", F.col("a"))
    nearest = nearest.join(itself, "a", "left_anti").union(itself)
    rows = compared.join(groups, F.col("a") == F.col("id"), "left").withColumn("group", F.coalesce("component", "a")).drop("id", "component")
    rows = stored(rows.join(stored(nearest, "nearest"), "a"), "grouped")
    direct, members = open_buckets(rows, placed, similarity)
    rows = stored(rows.join(stored(members, "many"), "a", "left_semi"), "open_rows")
    open_ = rows.groupBy("b").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("b")
    open_ = stored(open_, "hubs")
    narrow = ["b", "a", "na", "nb", "missed", "more", "group", "nearest"]

    def meet(array: str, rows: DataFrame, may: Column) -> DataFrame:
        spread = rows.select(*narrow, F.posexplode(array).alias("at", "e"))
        # only elements that members of several groups have, and not only members of another hub
        several = [f(c).alias(f"{n}_{c}") for c in ("group", "nearest") for n, f in (("low", F.min), ("high", F.max))]
        mixed = spread.groupBy("b", "e").agg(*several).where("low_group < high_group and (low_nearest < high_nearest or low_nearest = b)").select("b", "e")
        spread = stored(spread.join(stored(mixed, "mixed"), ["b", "e"], "left_semi"), "spread")
        other = spread.select("b", "e", *[F.col(c).alias(f"_{c}") for c in ("a", "na", "missed", "more", "at", "group", "nearest")])
        fits = _may_meet(similarity) & ((F.col("nearest") != F.col("_nearest")) | (F.col("nearest") == F.col("b")))
        return spread.join(other, ["b", "e"]).where(fits & may).select("a", F.col("_a").alias("b")).distinct()

    wanted = similarity * (F.col("na") + F.col("_na"))
    rest = lambda c: 1 + F.least(F.col(c) - 1 - F.col("at"), F.col(f"_{c}") - 1 - F.col("_at"))
    known = F.col("nb") - F.greatest("missed", "_missed")
    rows = rows.join(open_, "b", "left_semi")
    # members that share an extra element: at most the rest of the shorter one from its place on
    extra = meet("extra", rows, scale * (known + rest("more")) >= wanted)
    # members that share none must miss the same elements; possible only where both are smaller than the hub is wide
    bare = rows.where(F.size("missing") > 0)
    # one of the two is not similar to the hub: a similar member's partner is such a one, any other's may be either
    reach = similarity * F.col("na") + scale * F.col("missed")
    far = bare.groupBy("b").agg(F.min(F.when(~F.col("similar"), reach)).alias("far"), F.min(reach).alias("near")).where("far is not null")
    bare = bare.join(stored(far, "bare_hubs"), "b").where(similarity * F.col("na") + F.when(F.col("similar"), F.col("far")).otherwise(F.col("near")) <= scale * F.col("nb"))
    missing = meet("missing", bare, (scale * known >= wanted) & (scale * (F.col("nb") - F.col("missed") - F.col("_missed") + rest("missed")) >= wanted))
    return direct.union(extra).union(missing).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge; the component is the smallest id reachable. Edges must be stored."""
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        seen = labels.select(F.col("x").alias("y"), F.col("label").alias("other"))
        hooked = both.join(seen, "y").groupBy("x").agg(F.min("other").alias("near"))
        step = stored(labels.join(hooked, "x").select("x", F.least("label", "near").alias("label"), F.col("label").alias("old")), "hooked")
        jump = step.select(F.col("x").alias("label"), F.col("label").alias("far"))
        after = stored(step.join(jump, "label").select("x", F.col("far").alias("label"), (F.col("far") != F.col("old")).alias("moved")), "labels")
        done = after.where("moved").limit(1).count() == 0
        dropped(labels)
        dropped(step)
        labels = after.drop("moved")
        if done:
            dropped(both)
            return labels.select(F.col("x").alias("id"), F.col("label").alias("component"))


def _closed(edges: DataFrame) -> DataFrame:
    return stored(components(edges), "components")


def link_components(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    schemes = Schemes(docs.count() / 20, similarity)
    rows = stored(_set_rows(docs, schemes, words, common_bits(docs, words)), "sets")
    same = ["n", "k1", "k2"]
    copies = stored(rows.where("n > 0 and doc_id is not null").groupBy(same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "copies")
    members = stored(rows.drop("signatures").join(copies, same, "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "members")

    # buckets of two documents or more; those with the same members are one from here on
    bucket = W.partitionBy("sig")
    meets = rows.where("doc_id is not null").select("doc_id", F.explode("signatures").alias("sig")).select("sig", "doc_id")
    met = meets.withColumns({"low": F.min("doc_id").over(bucket), "high": F.max("doc_id").over(bucket), "c": F.count("*").over(bucket), "mark": F.bit_xor(F.xxhash64("doc_id")).over(bucket)})
    shared = stored(met.where("low < high").select(F.xxhash64("low", "high", "c", "mark").alias("bucket"), "doc_id", "c"), "shared")
    dropped(rows)
    own = members.where("doc_id is not null").groupBy("doc_id", "rep").agg(F.min("n").alias("n"))
    active = stored(shared.join(own, "doc_id").groupBy("bucket", "rep").agg(F.max("c").alias("c")), "active")
    dropped(shared)
    pairs, placed = hub_pairs(active, own.groupBy("rep").agg(F.min("n").alias("n")))
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    sets = stored(_sets(semi(docs, wanted, "doc_id"), words), "elements")
    compared = stored(against_hubs(pairs, sets, similarity), "compared")
    dropped(active)
    links = compared.where("similar").select("a", "b")
    groups = _closed(links)
    more = stored(around_hubs(compared, groups, placed, similarity), "candidates")
    if more.limit(1).count():
        groups = _closed(links.union(stored(_with_sets(more, sets).where(_similar(similarity)).select("a", "b"), "links")))
    found = members.join(groups, members["rep"] == groups["id"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
