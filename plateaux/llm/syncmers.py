"""Document fingerprints from closed syncmers, with positions.

A window of ``K`` code points is chosen when the smallest hash of its inner substrings of ``S`` code points stands at its
first or last place: the choice depends on the window alone, so equal passages choose equal anchors whatever surrounds
them. A fingerprint holds every anchor with its place, in the order of the text: base64 of 12 bytes each, the anchor's
64-bit and the place's 32-bit number, little-endian. The likeness of two fingerprints is the share of the anchors of both
together that both hold in the same order of places (the longest increasing run of matched places), 0 to 1; the n-th
occurrence of an anchor matches the n-th of the other text.

A text shorter than K has one anchor, the hash of the whole; an empty one has none. Two empty texts are alike (1), an
empty and another are not (0). Null texts count as empty. Rows with a null doc_id come after all others in descending
order; equal ids, repeated rows too, are ordered by text. A single document follows itself. An empty table gives no rows.
Other columns are not read. A very long text is fingerprinted whole, with a few arrays of its own length.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _odd, mix, shuffle_count, small_batches, texts

K, S = 32, 8  # K-mers and S-mers are hashed by doubling, so both are powers of two
BUCKET = 16 << 20  # bytes of text in a range of ids
_M = _odd(23, 7)

Print = tuple[np.ndarray, np.ndarray]


def anchors(text: str) -> Print:
    """All chosen anchors in the order of the text: their hashes and places."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(c) < K:
        whole = (mix(c + np.uint64(1)) * _M[5] ** np.arange(1, len(c) + 1, dtype=np.uint64)).sum(dtype=np.uint64)
        return mix(np.array([whole] if len(c) else [], np.uint64)), np.zeros(min(1, len(c)), np.int64)
    h = (c + np.uint64(1)) * _M[0]
    size, grown = 1, {}
    while size < K:
        h = h[:-size] * _M[1] ** np.uint64(size) + h[size:]
        size *= 2
        grown[size] = h
    inner = mix(grown[S])
    n = K - S + 1  # inner substrings of a window
    low, size = inner, 1
    while 2 * size <= n:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:len(c) - K + 1], low[n - size:])
    chosen = np.flatnonzero((low == inner[:len(low)]) | (low == inner[K - S:]))
    return mix(grown[K][chosen] * _M[4]), chosen


def spelled(f: Print) -> str:
    out = np.empty(len(f[0]), [("anchor", "<u8"), ("place", "<u4")])
    out["anchor"], out["place"] = f
    return base64.b64encode(out.tobytes()).decode()


def numbered(f: Print) -> Print:
    """Ascending keys that tell the occurrences of an anchor apart, and their places."""
    order = np.argsort(f[0], kind="stable")
    key, place = f[0][order], f[1][order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    nth = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    if nth.any():
        key = key + nth.astype(np.uint64) * _M[6]
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
    return key, place


def likeness(a: Print, b: Print) -> float:
    """Of two numbered fingerprints."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    shared, i, j = np.intersect1d(a[0], b[0], True, True)
    places = b[1][j][np.argsort(a[1][i], kind="stable")]
    if len(places) and (np.diff(places) > 0).all():
        run = len(places)
    else:
        tails: list[int] = []
        for place in places.tolist():
            at = bisect_left(tails, place)
            tails[at:at + 1] = [place]
        run = len(tails)
    return run / (len(a[0]) + len(b[0]) - len(shared))


def in_descending_order(docs: DataFrame) -> DataFrame:
    """Rows (bucket, follows, key, doc_id, text), sorted within tasks: each bucket holds one range of ids in descending
    order and, after them, the document that comes next (follows = 1).

    Range ends are ids that exist, so the document that follows a bucket is the one that has the end below it.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = texts(docs, "doc_id").withColumn("key", key)
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = min(20_000, max(4 * shuffle_count(spark), size // BUCKET))  # ends are read by the driver
    sample = own.select("key").agg(F.percentile_approx("key", [(i + 1) / n for i in range(n)], 20 * n).alias("ends"), F.max("key").alias("last")).first()
    ends = sorted({*(sample["ends"] or []), *([sample["last"]] if sample["last"] is not None else [])})
    shared = spark.sparkContext.broadcast(np.array(ends, np.int64))  # a fixed number for each task

    def deal(batches):
        import pyarrow as pa

        ends = shared.value
        for b in batches:
            keys = b.column("key").to_numpy()
            bucket = np.searchsorted(ends, keys)
            yield pa.record_batch([pa.array(bucket), pa.array(np.zeros(len(keys), np.int64)), b.column("key"), b.column("doc_id"), b.column("text")], names=["bucket", "follows", "key", "doc_id", "text"])
            edge = np.flatnonzero(keys == ends[bucket])
            if len(edge):
                up = (bucket[edge] + 1) % len(ends)  # after the last document comes the first
                rows = b.take(pa.array(edge))
                yield pa.record_batch([pa.array(up), pa.array(np.ones(len(edge), np.int64)), rows.column("key"), rows.column("doc_id"), rows.column("text")], names=["bucket", "follows", "key", "doc_id", "text"])

    dealt = own.select("key", "doc_id", "text").mapInArrow(deal, "bucket long, follows long, key long, doc_id long, text string")
    return dealt.repartition(max(shuffle_count(spark), n // 4), "bucket").sortWithinPartitions("bucket", "follows", F.desc("key"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint and that of its edited text, of which the last third is the next one's start."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None  # the row before, waiting for the next document
        for b in batches:
            out = {k: [] for k in names}
            for bucket, follows, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if held is not None and held[0] == bucket:
                    own, f = held[2], held[3]
                    k = len(own) // 3
                    edited = own[:len(own) - k] + text[:k]
                    g, e = anchors(text), anchors(edited)
                    one, two = numbered(f), numbered(g)
                    row = (held[1], len(own), hashlib.sha256(edited.encode()).hexdigest(), spelled(f), spelled(e), likeness(one, numbered(e)), likeness(one, two))
                    for name, v in zip(names, row, strict=True):
                        out[name].append(v)
                else:
                    g = anchors(text)
                held = None if follows else (bucket, doc, text, g)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(out[k], t) for k, t in zip(names, kinds, strict=True)], names=names)

    return in_descending_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
