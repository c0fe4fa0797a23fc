"""Token-ID output: Arrow files of equal-length sequences with masks, read back without copies.

``write_token_files`` tokenizes documents and writes, for each range of ``doc_id``, one Arrow IPC file whose record
batches hold a fixed-size list of ids and a fixed-size list of mask bits, and beside it one Arrow file that tells where
each document lies. Sequences of one shard lie at equal distances, so the ids of sequence ``k`` are one slice of the
mapped file (``TokenShard.sequence``). ``read_token_files`` reads the files back on the executors.

Nulls: a null text counts as empty, so it has its end id alone; a null ``doc_id`` sorts first. Repeated ids keep one
place each (ties by a hash of the text, then the text). A very long text runs over as many sequences as it needs; a task
holds one text at a time. An empty table gives no files and no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch, shuffle_count, small_batches, stored, texts
from .tokens import encoder, vocabulary_path

LENGTH = 2048
ROWS = 256  # sequences in a record batch
SHARD = 128 << 20  # bytes of text


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Fills sequences of ``length`` ids one after another and writes them in batches of ``ROWS``."""

    def __init__(self, path: str, dtype: np.dtype, length: int):
        import pyarrow as pa

        self.pa, self.length, self.dtype = pa, length, dtype
        self.kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        store, where = file_system(path)
        self.sink = store.open_output_stream(where)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.waiting += len(ids)
        if self.waiting >= ROWS * self.length:
            self._write(self.waiting // (ROWS * self.length) * ROWS * self.length)

    def _write(self, n: int) -> None:
        every = np.concatenate(self.parts)
        self.parts, self.waiting = [every[n:]], len(every) - n
        for k in range(0, n, ROWS * self.length):
            self._batch(every[k:min(n, k + ROWS * self.length)])

    def _batch(self, ids: np.ndarray) -> None:
        pa, rows = self.pa, -(-len(ids) // self.length)
        full = np.zeros(rows * self.length, self.dtype)
        full[:len(ids)] = ids
        mask = np.arange(len(full)) < len(ids)
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(full), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._batch(np.concatenate(self.parts))
        self.out.close()
        self.sink.close()


class TokenShard:
    """Random access to a written shard; a local file is mapped and its ids are not copied."""

    def __init__(self, path: str):
        import pyarrow as pa

        store, where = file_system(path)
        source = pa.memory_map(where) if path.startswith("file:") else store.open_input_file(where)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = ROWS

    def _values(self, batch: int, name: str):
        column = self.reader.get_batch(batch).column(name)
        return column.values.slice(column.offset * self.length, len(column) * self.length)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence k."""
        at = k % self.rows * self.length
        ids = self._values(k // self.rows, "ids").slice(at, self.length).to_numpy()
        return ids, self._values(k // self.rows, "mask").slice(at, self.length).to_numpy(zero_copy_only=False)

    def slice(self, start: int, stop: int):
        """Parts of the ids from start to stop, as views of the record batches that hold them."""
        step = self.rows * self.length
        while start < stop:
            batch = start // step
            end = min(stop, (batch + 1) * step)
            yield self._values(batch, "ids").slice(start - batch * step, end - start).to_numpy()
            start = end


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Write shards under ``folder`` (on a store all executors share); return one row a shard, shards in doc_id order.

    Texts are dealt by ranges of doc_id first (and of a hash of the text, so that a hot doc_id is split too), about
    ``SHARD`` bytes each, and encoded once, by the task that writes the shard. A task that runs again writes a file of a
    new name, and only the names in the committed manifest count, so lost or repeated tasks leave no half-written shard in use.
    """
    spark, path = docs.sparkSession, vocabulary or vocabulary_path()
    small_batches(spark)

    def run(batches):
        import uuid

        import pyarrow as pa

        enc = encoder(path)
        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        end = np.array([end_id], enc.dtype).tobytes()
        writer, ids, starts, counts = None, [], [], []
        total = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                writer = writer or ShardWriter(f"{name}.arrow", enc.dtype, length)
                own = np.frombuffer(enc.encode(text) + end, enc.dtype)
                writer.add(own)
                ids.append(doc)
                starts.append(total)
                counts.append(len(own))
                total += len(own)
        if writer:
            writer.close()
            store, where = file_system(f"{name}.index.arrow")
            index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
            with store.open_output_stream(where) as sink, pa.ipc.new_file(sink, index.schema) as out:
                out.write_table(index, max_chunksize=65536)
            yield pa.record_batch({"shard": pa.array([shard], pa.int64()), "path": [name], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    own = texts(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(shuffle_count(spark), -(-size // SHARD))
    shards = own.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return stored(shards.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read every document back from its shard: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has one row for each shard of ``SHARD`` bytes, so one task can sum over all of it in order.
    """
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = TokenShard(f"{path}.arrow")
                store, where = file_system(f"{path}.index.arrow")
                with store.open_input_file(where) as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        index = reader.get_batch(k)
                        starts, counts = index.column(1).to_numpy(), index.column(2).to_numpy()
                        sums = []
                        for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
                            crc = 0
                            for part in shard.slice(s, s + n):
                                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        yield pa.record_batch([index.column(0), pa.array(starts + base), index.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.repartition(shuffle_count(manifest.sparkSession), "shard").select("path", "base")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return read_token_files(write_token_files(docs, scratch(spark, "tokens"), vocabulary))
