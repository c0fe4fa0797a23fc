"""Importance resampling towards a target distribution of hashed word runs.

A feature is a run of consecutive words; its bucket is the CRC-32 of its bytes modulo the number of buckets. CRC-32 is affine,
so the checksum of a span is a constant of its length XOR one contribution for each byte, which depends on the byte and on
its distance from the span's end alone: a table of bytes by distances and one ``bitwise_xor.reduceat`` over all spans of a
batch give all checksums. Spans longer than the table fold block by block: a block's checksum moves to the left by a linear
map on 32 bits, four lookups for each power of two of bytes.

Counts are taken in each task, summed by bucket on Spark; the gains are one number a bucket and go out with the second pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import ALNUM, free_names, small_batches, stored, utf8

BUCKETS, SHARE, LEAST_WORDS, SALT = 10_000, 10, 20, "2024"
REACH = 32  # bytes of a span that the table covers
STEP = 1 << 20  # bytes of spans that are looked up at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- checksums of spans

@cache
def _after_byte() -> np.ndarray:
    """The state after one byte, from the state 0: the usual table, as the library has it."""
    zero = zlib.crc32(b"\0")
    own = np.array([zlib.crc32(bytes([b])) ^ zero for b in range(256)], np.uint32)
    return own


@cache
def _table() -> np.ndarray:
    """[distance from the end, byte]: what the byte adds to the checksum."""
    out = np.empty((REACH, 256), np.uint32)
    out[0] = step = _after_byte()
    for d in range(1, REACH):
        out[d] = (out[d - 1] >> np.uint32(8)) ^ step[out[d - 1] & np.uint32(255)]
    return out


@cache
def _lengths() -> np.ndarray:
    """The checksum of so many zero bytes."""
    return np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


@cache
def _shift(power: int) -> np.ndarray:
    """[byte of the state, its value]: the state that 2 ** power zero bytes later it has become."""
    if power == 0:
        step, values = _after_byte(), np.arange(256, dtype=np.uint32)
        first = step.copy()  # the lowest byte is looked up, the others move down
        return np.stack([first, *[values << np.uint32(8 * k - 8) for k in (1, 2, 3)]])
    half = _shift(power - 1)
    return np.stack([_moved(row, power - 1) for row in half])


def _moved(state: np.ndarray, power: int) -> np.ndarray:
    t = _shift(power)
    return t[0][state & np.uint32(255)] ^ t[1][(state >> np.uint32(8)) & np.uint32(255)] ^ t[2][(state >> np.uint32(16)) & np.uint32(255)] ^ t[3][state >> np.uint32(24)]


def _length_constant(n: int) -> int:
    state = np.full(1, 0xFFFFFFFF, np.uint32)
    for power in range(n.bit_length()):
        if n >> power & 1:
            state = _moved(state, power)
    return int(state[0]) ^ 0xFFFFFFFF


def _long(data: np.ndarray) -> int:
    """One span longer than the table: blocks from its end, folded in pairs."""
    blocks = 1 << (-(-len(data) // REACH) - 1).bit_length()
    reach = int(REACH).bit_length() - 1
    out = np.zeros(blocks, np.uint32)
    filled = -(-len(data) // REACH)
    head = len(data) - (filled - 1) * REACH  # bytes of the first block
    out[blocks - filled] = np.bitwise_xor.reduce(_table()[np.arange(head - 1, -1, -1), data[:head]])
    for k in range(head, len(data), STEP // REACH * REACH):
        part = data[k:k + STEP // REACH * REACH]
        at = blocks - filled + 1 + (k - head) // REACH
        both = _table()[np.tile(np.arange(REACH - 1, -1, -1), len(part) // REACH), part]
        out[at:at + len(part) // REACH] = np.bitwise_xor.reduceat(both, np.arange(0, len(part), REACH))
    power = reach
    while len(out) > 1:
        out = _moved(out[0::2], power) ^ out[1::2]
        power += 1
    return int(out[0]) ^ _length_constant(len(data))


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for every span; spans may overlap, none is empty."""
    out = np.empty(len(starts), np.uint32)
    size = ends - starts
    short = np.flatnonzero(size <= REACH)
    table, total = _table(), np.cumsum(size[short])
    i = 0
    while i < len(short):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + STEP, "right")))
        own = short[i:j]
        n = size[own]
        last = np.cumsum(n)
        back = np.repeat(last, n) - np.arange(last[-1]) - 1  # distance from the span's end
        byte = data[np.repeat(ends[own], n) - 1 - back]
        out[own] = np.bitwise_xor.reduceat(table[back, byte], last - n) ^ _lengths()[n]
        i = j
    for k in np.flatnonzero(size > REACH):
        out[k] = _long(data[starts[k]:ends[k]])
    return out


# ---------------------------------------------------------------- features of a batch of texts

def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the number of words before each text (one more than texts)."""
    word = ALNUM[data]
    edge = np.empty(len(data) + 1, bool)
    edge[:1], edge[-1:] = False, False
    if len(data):
        edge[0], edge[-1], edge[1:-1] = word[0], word[-1], word[1:] != word[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        cut = np.unique(inner[word[inner] & word[inner - 1]])  # two texts that meet within a run of word bytes
        at = np.sort(np.concatenate([np.flatnonzero(edge), cut, cut]))
    else:
        at = np.zeros(0, np.int64)
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray, sizes: range, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of run: the text that each feature is of, and its bucket."""
    data = _LOWER[data]
    starts, ends, before = word_spans(data, offsets)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    if sizes.stop > 2 and len(starts):  # words joined by one space
        n = ends - starts
        joined = np.full(int(n.sum()) + len(n), 32, np.uint8)
        new_ends = np.cumsum(n + 1) - 1
        keep = np.ones(len(joined), bool)
        keep[new_ends] = False
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        joined[keep] = data[np.cumsum(inside[:-1]) > 0]
        data, starts, ends = joined, new_ends - n, new_ends
    for k in sizes:
        m = len(starts) - k + 1
        if m <= 0:
            continue
        own = np.flatnonzero(text[:m] == text[k - 1:])
        yield text[own], span_crcs(data, starts[own], ends[own + k - 1]) % np.uint32(buckets)


def _batches(batches: Iterator[pa.RecordBatch], sizes: range, buckets: int):
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.names.index("text")))
        yield batch, data, offsets, features(data, offsets, sizes, buckets)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, words: tuple[int, int] = (1, 1)) -> DataFrame:
    """(bucket, n) over all features of all texts: one array of counts a task, then sums by bucket."""
    sizes = range(words[0], words[1] + 1)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, _, _, found in _batches(batches, sizes, buckets):
            for _, bucket in found:
                total += np.bincount(bucket, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(own, pa.int32()), "n": pa.array(total[own], pa.int64())})

    plain = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), from the counts of both."""
    spark = documents.sparkSession
    all_ = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = all_.join(documents.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = documents.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t")))  # one row each
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weighted(texts: DataFrame, gains: np.ndarray, words: tuple[int, int] = (1, 1)) -> DataFrame:
    """The table without its text, with n_words, n_features and weight (sum of gains) of each row."""
    sizes, buckets = range(words[0], words[1] + 1), len(gains)
    rest = [c for c in texts.columns if c != "text"]
    kept = {f.name: f for f in texts.schema.fields}
    schema = texts.select(*rest).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def weigh(batches):
        for batch, data, offsets, found in _batches(batches, sizes, buckets):
            n, weight = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            _, _, before = word_spans(data, offsets)
            for text, bucket in found:
                n += np.bincount(text, minlength=len(batch))
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(gains[bucket])])
                cut = np.searchsorted(text, np.arange(len(batch) + 1))
                weight += total[cut[1:]] - total[cut[:-1]]
            columns = {c: batch.column(batch.schema.names.index(c)) for c in rest}
            yield pa.record_batch(columns | {"n_words": pa.array(np.diff(before)), "n_features": pa.array(n), "weight": pa.array(weight)})

    assert kept["text"].dataType.simpleString() == "string"
    return texts.mapInArrow(weigh, schema)


def gumbel(key: Column, salt: str = SALT) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of the key's salted SHA-256: the same row gets the same noise."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, words: tuple[int, int] = (1, 1), share: int = SHARE, least_words: int = LEAST_WORDS, salt: str = SALT) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document.

    ``share`` percent (rounded down) of the documents with at least ``least_words`` words are drawn, by the highest sums of
    log importance and Gumbel noise, which is a draw without replacement in proportion to the importance; ties go to the
    smaller doc_id. Ranks come from a sort in ranges, so no task holds all rows.

    A null text has no words; a null doc_id is hashed as the empty text and stands before others in ties; rows of equal
    doc_id have equal noise and are drawn one by one; other columns are not read; an empty table gives no rows, and an
    empty target makes common words unlikely.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gains = bucket_gains(stored(bucket_counts(plain, buckets, words), "counts"), stored(bucket_counts(target, buckets, words), "target"), buckets)
    table = np.zeros(buckets, np.int64)
    for r in gains.collect():  # a number for each bucket
        table[r["bucket"]] = r["gain"]
    scored = weighted(plain, table, words).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), salt))
    row, = free_names(scored, "row")
    scored = stored(scored, "weights").withColumn(row, F.monotonically_increasing_id())  # tells equal rows apart
    fit = F.col("n_words") >= least_words
    ranked = numbered(scored.where(fit), [F.desc("score"), F.asc("doc_id"), F.asc(row)], "rank", 1)
    drawn = ranked.count() * share // 100
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(scored.where(~fit).select(*out, F.lit(None).cast("long").alias("rank")))
