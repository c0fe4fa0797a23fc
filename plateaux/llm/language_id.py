"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of other characters than letters is one blank, and a blank stands at both ends, so n-grams
know where words begin and end. An n-gram of one to ``LONGEST`` characters is hashed to a bucket. Training counts (language,
bucket) in one array a task, summed on Spark over all labelled training rows; the matrix of log probabilities, one row a language and one
column a bucket, goes out once, and a text is scored by gathering the columns of its n-grams and summing them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LONGEST, BUCKETS, SMOOTHING, FOLDS = 4, 1 << 16, 0.1, 5
CELLS = 1 << 24  # bound of the matrix: 64 MB of single precision; more languages get fewer buckets
LEAST_BUCKETS = 1 << 8
STEP = 1 << 18  # characters that are hashed at once
UNKNOWN = "und"

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, single blanks between words and at both ends; empty without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate([[False], _letters()[code], [False]])
    if not letter.any():
        return np.zeros(0, np.uint32)
    padded = np.zeros(len(letter), np.uint32)
    padded[1:-1] = np.where(letter[1:-1], code, 0)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first blank after a letter stays
    out = padded[keep]
    return out if letter[1] else out[1:] if out[1] == 0 else out


def ngram_buckets(code: np.ndarray, buckets: int, longest: int = LONGEST) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text's characters, in pieces that overlap by what an n-gram needs; blanks alone are none."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    wide = code.astype(np.uint64) + np.uint64(1)
    for low in range(0, len(code), STEP):
        part = wide[low:low + STEP + longest - 1]
        hashed = np.zeros(len(part), np.uint64)
        for n in range(1, longest + 1):
            m = min(len(part) - n + 1, STEP)
            if m <= 0:
                break
            hashed = (hashed[:len(part) - n + 1] + part[n - 1:] * _ODD[n - 1]) * _ODD[-1]
            hashed ^= hashed >> np.uint64(29)
            own = hashed[:m]
            if n == 1:
                own = own[part[:m] != 1]
            yield (own * _ODD[0] >> shift).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.names.index("text")).to_pylist()]


def matrix_buckets(n_languages: int) -> int:
    """A power of two, so that the matrix keeps its bound for any number of languages up to 65,536."""
    buckets = BUCKETS
    while buckets > LEAST_BUCKETS and buckets * n_languages > CELLS:
        buckets //= 2
    if buckets * n_languages > CELLS:
        raise ValueError(f"{n_languages} languages need a matrix of more than {CELLS} cells")
    return buckets


def bucket_counts(train: DataFrame, languages: list[str], buckets: int) -> DataFrame:
    """(lang, bucket, n) of all training rows; lang is the position in ``languages``."""
    at = {name: i for i, name in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), buckets), np.int64)
        waiting: list[list[np.ndarray]] = [[] for _ in languages]

        def add(k: int) -> None:
            if waiting[k]:
                total[k] += np.bincount(np.concatenate(waiting[k]), minlength=buckets)
                waiting[k].clear()

        for batch in batches:
            langs = batch.column(batch.schema.names.index("lang")).to_pylist()
            for text, lang in zip(_texts(batch), langs, strict=True):
                k = at[lang]
                for found in ngram_buckets(characters(text), buckets):
                    waiting[k].append(found)
                    if len(found) >= STEP // 2:
                        add(k)
            for k in range(len(languages)):  # a batch is bounded in bytes
                add(k)
        lang, bucket = np.nonzero(total)
        yield pa.record_batch({"lang": pa.array(lang, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "n": pa.array(total[lang, bucket], pa.int64())})

    return train.select("lang", "text").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_probabilities(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log P(bucket | language) of a (language, bucket) array of counts."""
    smooth = counts + smoothing
    return np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)


def fit(train: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order of name, their log shares of the training rows, and the matrix. What comes to the driver are
    the languages and the matrix's cells, both bounded by CELLS."""
    rows = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(rows)
    if not languages:
        return [], np.zeros(0), np.zeros((0, LEAST_BUCKETS), np.float32)
    buckets = matrix_buckets(len(languages))
    counts = np.zeros((len(languages), buckets))
    found = bucket_counts(train, languages, buckets).toPandas()
    counts[found["lang"], found["bucket"]] = found["n"]
    share = np.array([rows[name] for name in languages], float)
    return languages, np.log(share / share.sum()), log_probabilities(counts)


def predict(docs: DataFrame, languages: list[str], prior: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """The table without its text, with lang_pred and score: the posterior probability of what is predicted, 0 for ``und``."""
    rest = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast((languages, prior, matrix))

    def score(batches):
        languages, prior, matrix = shared.value
        for batch in batches:
            names, scores = [], []
            for text in _texts(batch):
                total, n = prior.copy(), 0
                for found in ngram_buckets(characters(text), matrix.shape[1]):
                    total += matrix.take(found, 1).sum(1, dtype=np.float64)
                    n += len(found)
                if not n or not languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(total.argmax())
                names.append(languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            columns = {c: batch.column(batch.schema.names.index(c)) for c in rest}
            yield pa.record_batch(columns | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(score, schema)


def identify(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, whole texts.

    Learned from all rows with a language whose CRC-32 of the decimal doc_id is no multiple of ``folds``; those of multiples
    are held out. Texts alone decide. A null text, one without a letter, and every text when nothing could be learned, get
    ``und`` and 0. A row without a doc_id is learned from and is not held out; repeated rows count as often as they are there;
    equal scores go to the language that is first by name; columns beside doc_id, lang and text are not read; an empty
    table has no rows.
    """
    small_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    plain = docs.select("doc_id", held.alias("held_out"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    languages, prior, matrix = fit(plain.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text"))
    return predict(plain.select("doc_id", "held_out", "text"), languages, prior, matrix)


def held_out_accuracy(predicted: DataFrame, docs: DataFrame) -> DataFrame:
    """n and accuracy over held-out rows with a language."""
    both = predicted.where("held_out").join(docs.select("doc_id", F.col("lang").alias("truth")).where("truth is not null"), "doc_id")
    return both.agg(F.count("*").alias("n"), F.avg((F.col("lang_pred") == F.col("truth")).cast("double")).alias("accuracy"))
