import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plateaux.llm.common import utf8
from plateaux.llm.importance import features, resample, span_crcs, weighted

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text, sizes, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % n for k in sizes for i in range(len(w) - k + 1)]


def test_checksums_of_spans_of_any_length():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 300_000, dtype=np.uint8)
    size = np.concatenate([np.arange(1, 140), r.integers(1, 5000, 300), [199_999]])
    start = r.integers(0, 100_000, len(size))
    got = span_crcs(data, start, start + size)
    assert got.tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(start, size, strict=True)]
    big = r.integers(0, 256, 2_100_001, dtype=np.uint8)
    assert span_crcs(big, np.array([0]), np.array([len(big)])).tolist() == [zlib.crc32(big.tobytes())]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 -é😀\n", max_size=40), max_size=8))
def test_features_are_runs_of_words(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    found = [[] for _ in texts]
    for text, bucket in features(data, offsets, range(1, 4), 997):
        for t, b in zip(text.tolist(), bucket.tolist(), strict=True):
            found[t].append(b)
    assert found == [buckets_of(t, (1, 2, 3), 997) for t in texts]


def brute(docs, target, n, sizes, share, least):
    own, other = Counter(b for _, t in docs for b in buckets_of(t, sizes, n)), Counter(b for t in target for b in buckets_of(t, sizes, n))
    all_own, all_other = sum(own.values()), sum(other.values())
    gain = [math.floor(1000 * math.log((other[b] + 1.0) * (all_own + n) / ((own[b] + 1.0) * (all_other + n)))) for b in range(n)]
    rows = []
    for i, t in docs:
        f = buckets_of(t, sizes, n)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(t))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[:len(fit) * share // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("sizes,buckets", [((1, 1), 10_000), ((1, 2), 61)])
def test_draw_against_brute_force(spark, sizes, buckets):
    r = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(200)] + ["é", "Bench", "x" * 100]
    docs = [(k, " ".join(r.choice(vocabulary, r.integers(0, 60)))) for k in range(300)]
    docs += [(7, docs[7][1])] * 40 + [(None, "Bench " * 30), (900, None), (901, ""), (902, "z" * 50_000), (903, "Bench-é " * 20_000)]
    target = ["bench é w1 w2 w3"] * 9 + [None, ""]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, Weight string, rank int").repartition(5)
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), buckets, sizes, 25, 10)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(docs, target, buckets, range(sizes[0], sizes[1] + 1), 25, 10)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, "b")], "doc_id long, text string")
    assert resample(docs.limit(0), docs).collect() == []
    got = {r["doc_id"]: r for r in resample(docs, docs.limit(0), share=100).collect()}
    assert got[1]["rank"] == 1 and got[2]["rank"] is None and got[1]["n_features"] == 30


def test_sums_of_gains_are_whole_across_batches(spark):
    docs = spark.createDataFrame([(k, "a b " * k) for k in range(50)], "doc_id long, text string")
    gains = np.arange(10, dtype=np.int64)
    a, b = zlib.crc32(b"a") % 10, zlib.crc32(b"b") % 10
    assert {r["doc_id"]: r["weight"] for r in weighted(docs, gains).collect()} == {k: k * (a + b) for k in range(50)}
