"""Line dedup by winnowing: later repeats of passages are deleted word by word, wherever they are cut or pasted.

A *line* is ``LINE`` words, one from every word of a text on, as texts here come with line feeds anywhere or nowhere; A-Z
count as a-z. Every run of ``min_words`` words has one fingerprint, the least line hash in it, so equal runs share a
fingerprint at the same place in the run. The steps:

1. Fingerprints are counted. Those of two places or more are sent to the tasks as bits (16 MB at most; with too few bits
   only more places go on to the next step), and their places are written with the words on both sides.
2. Places are joined with the first place of their fingerprint, by (doc_id, place), and the match is extended word by word
   both ways. As the fingerprints of a longer match lie close enough, its first and last words are reached.
3. Runs at a place that the extension did not cover differ from those at the first place. They may still repeat one at
   another, so they are compared with each other by a hash of all their words. A run equal to an earlier one that differs
   from the first place's has the same gap there, so nothing is lost, and no two later places are ever paired.
4. A word goes if it lies in a match of ``min_words`` words or more; the first occurrence stays.

A later document with the same text as an earlier one goes whole and takes no part in this.

Nulls: a null text stays null; rows with a null doc_id take no part and stay as they are. Rows equal in doc_id and text
count as one document; those equal in doc_id only are ordered by a hash of their text. Empty texts, and texts under
``min_words`` words, stay. Very long texts take part whole: a few arrays of their length in one task. An empty table gives
none. All columns are kept, whatever their names; ``n_chars``, where there is one, is counted anew. Lines are compared by
64-bit hashes, the words beside them by 32-bit ones, so once in four thousand million mismatches one word too many goes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, WordHasher, _odd, binary, dropped, fits_broadcast, free_names, joined_batches, mix, small_batches, stored, utf8

MIN_WORDS = 30
LINE = 10
ROWS = 2048  # places that are extended together
MOST_BITS = 27  # of the numbers of the filter's bits
_C = _odd(57, 4)


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row, by doubling."""
    out, have, power, size = None, 0, words, 1
    while True:
        if n & size:
            k = max(0, len(words) - have - size + 1)
            out = power if out is None else out[:k] * np.uint64(pow(int(_C[0]), size, 1 << 64)) + power[have:have + k]
            have += size
        if have == n:
            return mix(out)
        power = power[:max(0, len(power) - size)] * np.uint64(pow(int(_C[0]), size, 1 << 64)) + power[size:]
        size *= 2


def _slide(x: np.ndarray, n: int, least) -> np.ndarray:
    """The least (or greatest) of every n values in a row."""
    size = 1
    while 2 * size <= n:
        x = least(x[:max(0, len(x) - size)], x[size:])
        size *= 2
    return least(x[:max(0, len(x) - n + size)], x[n - size:]) if n > size else x


class Lines:
    """The lines of a batch of documents and the places of their fingerprints, without a loop over documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: WordHasher, min_words: int):
        starts, ends = hasher.spans(data, offsets)
        self.n, self.line = min_words, min(LINE, min_words)
        self.side = min_words - self.line  # words on either side of a line that a run can hold
        self.words = hasher.hashes(data, starts, ends)
        self.cut = np.searchsorted(starts, offsets)
        self.stop = np.repeat(self.cut[1:], np.diff(self.cut))
        self.hash = _runs(self.words, self.line)
        low = _slide(self.hash, self.side + 1, np.minimum)  # of every run
        whole = np.arange(len(low)) + min_words <= self.stop[:len(low)]  # within one document
        own, pad = np.where(whole, low, np.uint64(0)), np.zeros(self.side, np.uint64)
        self.at = np.flatnonzero((_slide(np.concatenate([pad, own, pad]), self.side + 1, np.maximum) == self.hash) & (self.hash > 0)) if len(own) else np.zeros(0, np.int64)

    def fingerprints(self) -> np.ndarray:
        return mix(self.hash[self.at] ^ _C[1])

    def sides(self, at: np.ndarray) -> np.ndarray:
        """The words before (nearest last) and after the lines at these places, 32 bits each, 0 beyond the document."""
        doc = np.searchsorted(self.cut, at, "right") - 1
        step = np.concatenate([np.arange(-self.side, 0), self.line + np.arange(self.side)])
        place = at[:, None] + step
        inside = (place >= self.cut[doc][:, None]) & (place < self.cut[doc + 1][:, None])
        half = (self.words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        return np.where(inside, half[np.clip(place, 0, max(0, len(half) - 1))], np.uint32(0))

    def reach(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By how many words the runs that have this place as their first least line can start before it: at least, at most."""
        doc = np.searchsorted(self.cut, at, "right") - 1
        own = self.hash[at]
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.side)
        for k in range(self.side, 0, -1):
            before, after = at - k, at + k
            lesser = (before >= self.cut[doc]) & (self.hash[np.maximum(before, 0)] <= own)
            high = np.where(lesser, k - 1, high)
            lesser = (after + self.line <= self.cut[doc + 1]) & (self.hash[np.minimum(after, len(self.hash) - 1)] < own)
            low = np.where(lesser, self.side + 1 - k, low)
        low = np.maximum(low, self.side - (self.cut[doc + 1] - at - self.line))
        high = np.minimum(high, at - self.cut[doc])
        return low, high


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").cast("string").alias("text"))


def first_and_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, tag and text of rows that are the first with their text, and of those that are not."""
    own = _tagged(docs)
    copied = stored(own.groupBy("tag").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").drop("last"), "copied")
    rows = own.join(F.broadcast(copied) if fits_broadcast(copied, 16) else copied, "tag", "left")
    first = F.col("head").isNull() | (F.col("doc_id") == F.col("head"))
    return rows.where(first).select("doc_id", "tag", "text"), rows.where(~first).select("doc_id", "tag", "text")


def shared_bits(tagged: DataFrame, min_words: int) -> tuple[np.ndarray, int]:
    """A bit for each fingerprint of two places or more, by its upper bits; and how far to shift for them."""
    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(SPACED)
        for b in batches:
            own, n = np.unique(Lines(*utf8(b.column(0)), hasher, min_words).fingerprints(), return_counts=True)
            yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(n)], names=["print", "n"])

    counted = tagged.select("text").mapInArrow(run, "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))
    shared = stored(counted.where("n > 1").select("print"), "fingerprints")
    size = min(MOST_BITS, max(15, (16 * shared.count()).bit_length()))
    place = F.shiftrightunsigned("print", 64 - size)
    rows = shared.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    bits = np.zeros((1 << size - 15, 4096), np.uint8)
    for r in rows.collect():  # a fixed size: 4096 rows of 4 kB at most
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    dropped(shared)
    return bits.reshape(-1), 64 - size


def places(heads: DataFrame, min_words: int) -> DataFrame:
    """Places of shared fingerprints, with the words on both sides and the reach of their runs."""
    bits, shift = shared_bits(heads, min_words)
    known = heads.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(SPACED)
        for b in batches:
            lines = Lines(*utf8(b.column(2)), hasher, min_words)
            key = lines.fingerprints()
            bit = (key >> np.uint64(shift)).astype(np.int64)
            own = np.flatnonzero((known.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            for k in range(0, max(1, len(own)), 8192):
                part = own[k:k + 8192]
                at = lines.at[part]
                doc = np.searchsorted(lines.cut, at, "right") - 1
                row = pa.array(doc)
                low, high = lines.reach(at)
                sides = lines.sides(at)
                sides = pa.FixedSizeBinaryArray.from_buffers(pa.binary(max(1, 8 * lines.side)), len(at), [None, pa.py_buffer(np.ascontiguousarray(sides))]) if lines.side else pa.array([b""] * len(at))
                columns = [pa.array(key[part].view(np.int64)), b.column(0).take(row), b.column(1).take(row), pa.array((at - lines.cut[doc]).astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), sides.cast(pa.binary())]
                yield pa.record_batch(columns, names=["print", "doc_id", "tag", "place", "low", "high", "sides"])

    return stored(heads.mapInArrow(run, "print long, doc_id long, tag long, place int, low int, high int, sides binary"), "places")


def extended(joined: DataFrame, min_words: int) -> DataFrame:
    """For each place joined with its first one: the match (start, end; words), and the keys of runs that it leaves open."""
    line = min(LINE, min_words)
    side = min_words - line

    def run(batches):
        import pyarrow as pa

        ahead, behind = (np.array([pow(int(c), k + 1, 1 << 64) for k in range(side)], np.uint64) for c in _C[2:4])
        step = np.arange(side + 1)

        def found(b):
            n = b.num_rows
            both = [binary(b.column(k)).view(np.uint32).reshape(n, 2 * side) for k in ("sides", "first_sides")]
            equal = (both[0] == both[1]) & (both[0] > 0)
            end = np.zeros((n, 1), bool)  # the first word that differs, or the end
            left = np.concatenate([equal[:, :side][:, ::-1], end], 1).argmin(1)
            right = np.concatenate([equal[:, side:], end], 1).argmin(1)
            place, low, high = (b.column(k).to_numpy().astype(np.int64) for k in ("place", "low", "high"))
            full = np.flatnonzero(left + line + right >= min_words)
            # runs that start j words before the line, with the line as their first least one, and go beyond the match
            open_ = (low[:, None] <= step) & (step <= high[:, None]) & ((left[:, None] < step) | (right[:, None] < side - step))
            some = np.flatnonzero(open_.any(1))
            at, j = np.nonzero(open_[some])
            words = both[0][some].astype(np.uint64)
            none = np.zeros((len(some), 1), np.uint64)
            before = np.concatenate([none, np.cumsum(mix(words[:, :side][:, ::-1] * _C[2]) * ahead, axis=1)], 1)
            after = np.concatenate([none, np.cumsum(mix(words[:, side:] * _C[3]) * behind, axis=1)], 1)
            row = some[at]
            key = mix(b.column("print").to_numpy().view(np.uint64)[row] + before[at, j] + after[at, side - j] + (j + 1).astype(np.uint64) * _C[0])
            every, start = pa.array(np.concatenate([full, row])), place[row] - j
            starts, ends = np.concatenate([(place - left)[full], start]), np.concatenate([(place + line + right)[full], start + min_words])
            keys = pa.array(np.concatenate([np.zeros(len(full), np.int64), key.view(np.int64)]), mask=np.arange(len(every)) < len(full))
            return pa.record_batch([b.column("doc_id").take(every), b.column("tag").take(every), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32)), keys], names=["doc_id", "tag", "start", "end", "key"])

        for b in joined_batches(batches, ROWS):
            yield found(b)

    return joined.mapInArrow(run, "doc_id long, tag long, start int, end int, key long")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tag (a hash of the text) and the spans (start, end; words) that repeat earlier ones, sorted and apart."""
    small_batches(docs.sparkSession)
    heads, copies = first_and_copies(docs)
    found = places(heads, min_words)
    where = F.struct("doc_id", "tag", "place")
    first = found.groupBy("print").agg(F.min(F.struct("doc_id", "tag", "place", "sides")).alias("first"), F.max(where).alias("last"))
    first = first.where(F.col("last") != F.struct("first.doc_id", "first.tag", "first.place")).select("print", F.struct("first.doc_id", "first.tag", "first.place").alias("first"), F.col("first.sides").alias("first_sides"))
    # stored, so that a join in which one fingerprint has many places can be split
    later = found.join(stored(first, "firsts"), "print").where(where != F.col("first")).drop("first")
    matches = stored(extended(later, min_words), "matches")
    open_ = matches.where("key is not null")
    source = F.struct("doc_id", "tag", "start")
    heads_of = open_.groupBy("key").agg(F.min(source).alias("first"), F.max(source).alias("last")).where("first < last").drop("last")
    again = open_.join(stored(heads_of, "run_firsts"), "key").where(source != F.col("first"))

    def whole(batches):
        import pyarrow as pa

        hasher = WordHasher(SPACED)
        for b in batches:
            data, offsets = utf8(b.column(2))
            n = np.diff(np.searchsorted(hasher.spans(data, offsets)[0], offsets))
            row = pa.array(np.flatnonzero(n >= min_words))
            yield pa.record_batch([b.column(0).take(row), b.column(1).take(row), pa.array(np.zeros(len(row), np.int32)), pa.array(n[n >= min_words].astype(np.int32))], names=["doc_id", "tag", "start", "end"])

    names = ["doc_id", "tag", "start", "end"]
    spans = matches.where("key is null").select(names).union(again.select(names)).union(copies.mapInArrow(whole, "doc_id long, tag long, start int, end int"))

    def merge(batches):
        import pyarrow as pa

        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for b in batches:
            starts, ends, edge = [], [], [0]
            for own in b.column(2):
                s, e = (own.values.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                starts.append(s[new])
                ends.append(e[np.append(new[1:] - 1, len(e) - 1)])
                edge.append(edge[-1] + len(new))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int32)]).astype(np.int32)) for x in (starts, ends)], fields=list(span))
            yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), flat)], names=["doc_id", "tag", "spans"])

    gathered = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # a document's own, each once
    return gathered.mapInArrow(merge, "doc_id long, tag long, spans array<struct<start:int,end:int>>")


def _without(text: str, spans: list, hasher: WordHasher) -> str:
    """The text without these words and what stands between each of them and the next word."""
    raw = text.encode()
    starts = np.append(hasher.spans(np.frombuffer(raw, np.uint8))[0], len(raw))
    out, at = [], 0
    for s in spans:
        out.append(raw[at:int(starts[s["start"]])])
        at = int(starts[s["end"]])
    return b"".join([*out, raw[at:]]).decode()


def kept_text(text: Column, spans: Column) -> Column:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def kept(texts, spans):
        import pandas as pd

        hasher = WordHasher(SPACED)
        return pd.Series([t if s is None else _without(t, s, hasher) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return F.when(spans.isNull(), text).otherwise(kept(text, spans))


def _marked(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a further column, of that name, of the spans that go, or null."""
    own, doc, tag, spans = free_names(docs, "own", "doc", "tag", "spans")
    found = found.toDF(doc, tag, spans)
    rows = docs.withColumn(own, F.xxhash64("text")).join(found, (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(tag)), "left")
    return rows.drop(own, doc, tag), spans


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the columns they had, later repeats of passages deleted from their texts word by word."""
    rows, spans = _marked(docs, repeated_runs(docs, min_words))
    out = rows.withColumn("text", kept_text(F.col("text"), F.col(spans))).drop(spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(docs.columns)


def deduped_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, what is left of its text, and how many code points stay and go."""
    rows, spans = _marked(docs.select("doc_id", "text"), repeated_runs(docs, min_words))
    kept = rows.select("doc_id", "text", kept_text(F.col("text"), F.col(spans)).alias("kept"))
    return kept.select("doc_id", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_kept"), (F.length("text") - F.length("kept")).cast("long").alias("n_removed"))
