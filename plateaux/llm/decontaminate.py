"""Benchmark decontamination by suffix arrays over the words of training shards.

Every task gathers its documents into shards of about ``SHARD`` words, sorts all suffixes of a shard by prefix doubling
(to ``window`` words or more) and binary-searches every different benchmark window in it. The suffixes that share a
window lie together, so one search gives all places of that window. Hit words are marked by window; which items hold a
window is a list apart, looked up once for each different set of windows, so that many items that share a prompt with
many documents make no product of rows. Longest verbatim matches are read off the ranks of a suffix order of the hit stretches
of documents and items. Words are compared by 64-bit hashes (a false hit needs ten hashes to collide at once).

The benchmark goes to the tasks in blocks of at most ``BLOCK`` bytes of text, the only data that is broadcast; a larger
benchmark takes several passes, whose hit words and lists of items are then merged by document (one pass makes lists only
where the caller asks for them).

Nulls: a null text (of a document or an item) has no words; a null item_id counts as the empty string. Items that repeat
an item_id count once. Documents of equal doc_id, repeated rows too, keep a row each, however many passes there are. A very
long text makes a shard of its own. An empty benchmark gives no hits, an empty table no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, WordHasher, small_batches, stored, texts, utf8, without

WINDOW = 10
SHARD = 400_000
BLOCK = 32 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
_ITEMS: dict = {}
SCHEMA = "doc_id long, row long, n_words long, spans array<struct<first:long,last:long>>, items array<string>, n_items long, items_sha256 string, longest_match long, longest_start long"


class Items:
    """The windows of benchmark items as hashed words: each different window once, and the items of each in a list apart.

    ``at`` and ``length`` say where a window lies in ``words``; ``of`` gives the number of the window that begins at each
    of the places ``begins``. Windows of the same items share a set: ``set_of`` of a window, ``members`` of a set.
    """

    def __init__(self, ids: list[str], bodies: list[str], window: int):
        hasher = WordHasher(ALNUM)
        words, begins, item, length = [], [], [], []
        total = 0
        for k, body in enumerate(bodies):
            data = np.frombuffer(body.encode(), np.uint8)
            h = hasher.hashes(data, *hasher.spans(data))
            n = min(window, len(h))
            if n:
                starts = np.arange(len(h) - n + 1)
                begins.append(total + starts)
                item.append(np.full(len(starts), k))
                length.append(np.full(len(starts), n))
            words.append(h)
            total += len(h)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.ids, self.window = ids, window
        self.words = np.concatenate([*words, np.zeros(window, np.uint64)])
        self.begins, item, length = join(begins, np.int64), join(item, np.int64), join(length, np.int64)
        self.owner = item
        self._number(item, length)

    def _number(self, item: np.ndarray, length: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            keys = []
            for factor in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):  # two odd numbers, for keys of 128 bits
                key = length.astype(np.uint64)
                for j in range(self.window):
                    word = np.where(j < length, self.words[self.begins + np.minimum(j, length - 1)], np.uint64(0))
                    key = (key ^ word) * factor
                    key ^= key >> np.uint64(29)
                keys.append(key)
        order = np.lexsort((item, *keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])
        number = np.cumsum(new) - 1
        self.of = np.empty(len(order), np.int64)
        self.of[order] = number
        self.at, self.length = self.begins[order][new], length[order][new]
        # an item counts once for a window; equal lists of items are one set
        own = item[order]
        once = new.copy()
        once[1:] |= np.diff(own) != 0
        own, number = own[once], number[once]
        edges = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(own))
        several = np.flatnonzero(np.diff(edges) > 1)
        self.members: list[np.ndarray] = [np.array([k]) for k in range(len(self.ids))]
        self.set_of = own[edges[:-1]]  # a window of one item: the set of that item
        known: dict[bytes, int] = {}
        for w in several.tolist():
            group = own[edges[w]:edges[w + 1]]
            name = group.tobytes()
            if name not in known:
                known[name] = len(self.members)
                self.members.append(group)
            self.set_of[w] = known[name]

    def found(self, sets: np.ndarray) -> list[str]:
        """Sorted item ids of some sets."""
        return sorted({self.ids[i] for i in np.unique(np.concatenate([self.members[k] for k in sets.tolist()])).tolist()})


def suffix_order(words: np.ndarray, depth: int, ranks: list | None = None) -> np.ndarray:
    """Starts of suffixes in the order of their first ``depth`` words or more; equal ones in order of place.

    ``ranks``, if given, receives the rank of each start by its first 1, 2, 4 ... words.
    """
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    keep = ranks is not None
    if keep:
        ranks.append(rank)
    order, done, n = None, 1, len(words)
    while done < depth:
        after = np.zeros(n, np.int64)
        after[:max(0, n - done)] = rank[done:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if keep:
            ranks.append(rank)
        done *= 2
    return order if order is not None else np.argsort(rank, kind="stable")


def bounds(words: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For every window: where the suffixes that begin with it start and end in the order.

    One look-up of the first word leaves few windows and few suffixes; a binary search over those settles the rest.
    """
    padded = np.concatenate([words, np.zeros(items.window, np.uint64)])
    first = words[order]
    # sorting words by their hashes or by their ranks is the same order
    start, end = np.searchsorted(first, items.words[items.at], "left"), np.searchsorted(first, items.words[items.at], "right")
    open_windows = np.flatnonzero(start < end)
    at, length = items.at[open_windows], items.length[open_windows]

    def search(above: bool) -> np.ndarray:
        low, high = start[open_windows], end[open_windows]
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            place = order[np.minimum(middle, len(order) - 1)]
            sign = np.zeros(len(low), np.int8)  # of suffix against window
            for j in range(1, items.window):
                todo = np.flatnonzero((sign == 0) & (j < length) & open_)
                if not len(todo):
                    break
                own, test = padded[place[todo] + j], items.words[at[todo] + j]
                short = place[todo] + j >= len(words)
                sign[todo] = np.where(short | (own < test), -1, np.where(own > test, 1, 0))
            right = open_ & ((sign <= 0) if above else (sign < 0))
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        return low

    low, high = start, start.copy()
    low[open_windows], high[open_windows] = search(False), search(True)
    return low, high


def find(words: np.ndarray, doc_of: np.ndarray, items: Items):
    """All places of all different windows: (word place, window), places that cross documents left out.

    A place begins one window of each length at most, so there are no more than ``window`` rows for each word.
    """
    if not len(words) or not len(items.at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_order(words, items.window)
    low, high = bounds(words, order, items)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    place = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    same = doc_of[place] == doc_of[place + items.length[which] - 1]
    return place[same], which[same]


def _runs(starts: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of consecutive windows of one owner, from the places (ascending) where windows start: first word, size, and the stretch of each window."""
    first = np.flatnonzero((np.diff(starts, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
    last = np.append(first[1:], len(starts)) - 1
    size = starts[last] - starts[first] + width
    return starts[first], size, np.repeat(np.arange(len(first)), last - first + 1)


def longest_matches(words: np.ndarray, doc_of: np.ndarray, place: np.ndarray, which: np.ndarray, items: Items) -> np.ndarray:
    """For each (place, window): how many words from there on stand in one benchmark item in the same order.

    Stretches of hit words and the stretches of items that hold the same windows are put in one suffix order, each
    stretch once and closed by an end of its own. The longest match of a place is with the nearest item suffix above or
    below it there, and its length is read off the ranks, from the longest power of two down. A shorter item is its only window.
    """
    out = items.length[which].copy()
    full = np.flatnonzero(out == items.window)
    if not len(full):
        return out
    own = np.unique(place[full])
    used = np.zeros(len(items.at), bool)
    used[which[full]] = True
    theirs = used[items.of]

    def stretches(source: np.ndarray, starts: np.ndarray, owner: np.ndarray):
        """Different stretches, and for each start its stretch and its place within."""
        begin, size, run = _runs(starts, owner, items.window)
        names: dict[bytes, int] = {}
        kept = [names.setdefault(source[b:b + n].tobytes(), len(names)) for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
        return [np.frombuffer(name, np.uint64) for name in names], np.array(kept)[run], starts - begin[run]

    ours, of, within = stretches(words, own, doc_of[own])
    items_runs, _, _ = stretches(items.words, items.begins[theirs], items.owner[theirs])
    every = [*ours, *items_runs]
    sizes = np.array([len(x) for x in every])
    _, coded = np.unique(np.concatenate(every), return_inverse=True)
    # an end of its own after each stretch, so that no match runs on into the next
    ends = np.cumsum(sizes + 1) - 1
    text = np.empty(ends[-1] + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside], text[ends] = coded, coded.max() + 1 + np.arange(len(ends))
    begins = ends - sizes
    ranks: list[np.ndarray] = []
    order = suffix_order(text, int(sizes.max()) + 1, ranks)
    is_item = np.zeros(len(text), bool)
    is_item[begins[len(ours)]:] = True
    is_item &= inside
    at = np.arange(len(order))
    above = np.maximum.accumulate(np.where(is_item[order], at, -1))
    below = np.minimum.accumulate(np.where(is_item[order], at, len(order))[::-1])[::-1]
    position = np.empty(len(order), np.int64)
    position[order] = at
    p = begins[of] + within
    best = np.zeros(len(p), np.int64)
    for near in (above[position[p]], below[position[p]]):
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        x, y = p[ok], order[near[ok]]
        n = np.zeros(len(ok), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            i, j = x + n, y + n
            can = (i < len(text)) & (j < len(text))
            can[can] = ranks[k][i[can]] == ranks[k][j[can]]
            n += can.astype(np.int64) << k
        best[ok] = np.maximum(best[ok], n)
    out[full] = best[np.searchsorted(own, place[full])]
    return out


def _judge(keys, hashed: list[np.ndarray], items: Items, with_items: bool):
    """A row for each document of a shard."""
    sizes = np.array([len(h) for h in hashed], np.int64)
    words = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    place, which = find(words, doc_of, items)
    by_place = np.argsort(place, kind="stable")
    place, which = place[by_place], which[by_place]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + items.length[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    length = longest_matches(words, doc_of, place, which, items)
    lists: dict[bytes, tuple] = {}  # documents with the same sets of items have the same list
    cut = np.searchsorted(place, np.append(starts, len(words)))
    for d, key in enumerate(keys):
        i, j = int(cut[d]), int(cut[d + 1])
        row = {"doc_id": key[0], "row": key[1], "n_words": int(sizes[d]), "spans": [], "items": [], "n_items": 0, "items_sha256": NOTHING, "longest_match": 0, "longest_start": None}
        if i < j:
            own = np.concatenate([[0], hit[starts[d]:starts[d] + sizes[d]].astype(np.int8), [0]])
            turn = np.flatnonzero(np.diff(own))
            row["spans"] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(turn[::2], turn[1::2], strict=True)]
            sets = np.unique(items.set_of[which[i:j]])
            name = sets.tobytes()
            if name not in lists:
                found = items.found(sets)
                lists[name] = (len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), found if with_items else [])
            row["n_items"], row["items_sha256"], row["items"] = lists[name]
            best = i + int(np.argmax(length[i:j]))  # the first of the longest
            row["longest_match"], row["longest_start"] = int(length[best]), int(place[best] - starts[d])
        yield row


def _items(name: str, block, window: int) -> Items:
    """A block's windows, hashed once for each worker process."""
    if name not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[name] = Items(*block, window)
    return _ITEMS[name]


def _pass(docs: DataFrame, block, window: int, with_items: bool) -> DataFrame:
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK bytes of text

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(kind)), ("items", pa.list_(pa.string())), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("longest_match", pa.int64()), ("longest_start", pa.int64())])
        items, hasher = _items(name, shared.value, window), WordHasher(ALNUM)
        keys, hashed, total = [], [], 0
        for b in batches:
            data, offsets = utf8(b.column(2))
            starts, ends = hasher.spans(data, offsets)
            every = hasher.hashes(data, starts, ends)
            cut = np.searchsorted(starts, offsets)
            hashed += [every[i:j] for i, j in zip(cut, cut[1:], strict=False)]
            keys += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            total += len(every)
            if total >= SHARD:
                yield pa.RecordBatch.from_pylist(list(_judge(keys, hashed, items, with_items)), schema)
                keys, hashed, total = [], [], 0
        if keys:
            yield pa.RecordBatch.from_pylist(list(_judge(keys, hashed, items, with_items)), schema)

    return docs.mapInArrow(run, SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_items: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, longest_match, longest_start, and the list ``items`` if asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = texts(docs, "doc_id").select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (BLOCK // 2)
    if n_blocks > 1:
        keyed = stored(keyed, "numbered")  # the passes must see the same numbers
    passes = []
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k)
        rows = sorted((r["id"], r["text"]) for r in part.collect())  # bounded by BLOCK
        passes.append(_pass(keyed, ([r[0] for r in rows], [r[1] for r in rows]), window, with_items or n_blocks > 1))
    found = passes[0]
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    if n_blocks > 1:
        for other in passes[1:]:
            found = found.unionByName(other)
        best = F.max(F.struct("longest_match", (-F.col("longest_start")).alias("back")))
        found = found.groupBy("doc_id", "row", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("b"))
        found = found.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", "items"), 256), "longest_match": F.col("b")["longest_match"], "longest_start": -F.col("b")["back"]})
        n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))).cast("long")
    columns = [F.col("doc_id"), F.col("n_words"), n_hit.alias("n_hit"), F.col("n_items"), F.col("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.col("spans"), F.col("longest_match"), F.col("longest_start")]
    return found.select(*columns, *([F.col("items")] if with_items else []))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    return without(docs, stored(contamination(docs, benchmark, window).where("contaminated and doc_id is not null").select("doc_id").distinct(), "contaminated"))
