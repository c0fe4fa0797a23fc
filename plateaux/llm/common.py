"""Shared helpers: shared scratch tables, partition sizing and vectorised word hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import dropped, scratch, shared_dir, stored  # noqa: F401  (used from here by the operators)

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Documents can be long: keep the Arrow batches that go to Python small, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def texts(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and the text, null read as empty; other columns are left behind."""
    return docs.select(*keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of the table has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem = "_" + stem
        taken.add(stem.lower())
        out.append(stem)
    return out


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = 16 << 20) -> bool:
    """Whether a stored table is small enough, by its counted rows, to send to every executor."""
    return df.count() * row_bytes <= limit


def semi(left: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in keys (a stored table of one long column): broadcast up to 16 MB, shuffled beyond."""
    return left.join(F.broadcast(keys) if fits_broadcast(keys, 16) else keys, key, "left_semi")


# ---------------------------------------------------------------- hashing of words

def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHasher:
    """64-bit hashes of the words of UTF-8 bytes; a word is a maximal run of bytes in ``is_word``; A-Z count as a-z.

    A word's hash is a sum of byte values times powers of an odd base, from one running sum over all bytes,
    so no Python loop runs over words. Memory is bounded: long input is cut into steps at bytes between words.
    """

    STEP = 1 << 19

    def __init__(self, is_word: np.ndarray, seed: int = 7):
        lower = np.arange(256)
        lower[65:91] += 32
        self.is_word = is_word
        self.value = _odd(seed, 256)[lower]
        self.base = int(_odd(seed + 1, 1)[0])
        self.power, self.inverse = self._powers(self.base), self._powers(pow(self.base, -1, 1 << 64))

    def _powers(self, base: int, n: int = STEP) -> np.ndarray:
        out = np.ones(n, np.uint64)
        size = 1
        while size < n:
            k = min(size, n - size)
            out[size:size + k] = out[:k] * np.uint64(pow(base, size, 1 << 64))
            size += k
        return out

    def spans(self, data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of words; ``breaks`` are starts of documents, which words do not cross."""
        w = self.is_word[data]
        before = np.empty_like(w)
        before[:1] = False
        before[1:] = w[:-1]
        after = np.empty_like(w)
        after[-1:] = False
        after[:-1] = w[1:]
        if breaks is not None and len(data):
            inner = breaks[(breaks > 0) & (breaks < len(data))]
            before[inner] = False
            after[inner - 1] = False
        return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            low = int(starts[i])
            j = int(np.searchsorted(ends, low + self.STEP, "right"))
            if j <= i:  # one word longer than a step
                out[i] = self._long(data[low:int(ends[i])])
                i += 1
                continue
            high = int(ends[j - 1])
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.value[data[low:high]] * self.power[:high - low], out=total[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (total[e] - total[s]) * self.inverse[s]
            i = j
        return mix(out)

    def _long(self, data: np.ndarray) -> np.uint64:
        total, scale = 0, 1
        for k in range(0, len(data), self.STEP):
            part = data[k:k + self.STEP]
            total = (total + scale * int((self.value[part] * self.power[:len(part)]).sum())) & MASK
            scale = scale * pow(self.base, len(part), 1 << 64) & MASK
        return np.uint64(total)


def byte_class(spec: set[int] | range | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(spec)] = True
    return out


#: Words of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z, as UTF-8 bytes.
SPACED = byte_class(set(range(256)) - {0x20, *range(9, 14)})
ALNUM = byte_class({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)})


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of an Arrow string array, without a copy of the bytes."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return data[low:high], offsets - low


def binary(column) -> np.ndarray:
    """The bytes of an Arrow binary array without nulls, one value after another, without a copy."""
    import pyarrow as pa

    wide = pa.types.is_large_binary(column.type)
    raw = column.buffers()[2]
    if not len(column) or raw is None:
        return np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return np.frombuffer(raw, np.uint8)[offsets[column.offset]:offsets[column.offset + len(column)]]


def joined_batches(batches, rows: int):
    """The rows of small Arrow batches in batches of at least so many, but for the last."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def without(docs: DataFrame, rejected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not in a stored table of keys: sent to all tasks up to 16 MB, shuffled beyond."""
    return docs.join(F.broadcast(rejected) if fits_broadcast(rejected, 16) else rejected, key, "left_anti").select(docs.columns)
