import zlib

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from plateaux.llm import language_id as li


def test_characters_keep_words_apart():
    text = lambda s: "".join(chr(c) if c else "_" for c in li.characters(s))
    assert [text(s) for s in ("Ab", "  Ab-c9 ", "12 !", "", "Éß", "x\ud800y")] == ["_ab_", "_ab_c_", "", "", "_éß_", "_x_y_"]


def test_pieces_give_the_ngrams_of_the_whole(monkeypatch):
    code = li.characters("the quick brown fox jumps over it " * 20)
    whole = np.sort(np.concatenate(list(li.ngram_buckets(code, 1 << 12))))
    monkeypatch.setattr(li, "STEP", 7)
    assert np.array_equal(whole, np.sort(np.concatenate(list(li.ngram_buckets(code, 1 << 12)))))
    blanks = int((code == 0).sum())
    assert len(whole) == sum(len(code) - n + 1 for n in range(1, li.LONGEST + 1)) - blanks


def test_scores_against_plain_naive_bayes(spark):
    rows = [("en", "the cat and the dog"), ("en", "that hat"), ("de", "der Hund und die Katze"), ("de", "das Haus"), ("de", "die")]
    train = spark.createDataFrame(rows, "lang string, text string")
    languages, prior, matrix = li.fit(train)
    assert languages == ["de", "en"] and np.allclose(np.exp(prior), [0.6, 0.4])
    counts = {k: np.zeros(li.BUCKETS) for k in languages}
    for lang, text in rows:
        for found in li.ngram_buckets(li.characters(text), li.BUCKETS):
            np.add.at(counts[lang], found, 1)
    logs = {k: np.log((c + li.SMOOTHING) / (c + li.SMOOTHING).sum()) for k, c in counts.items()}
    texts = ["the", "die", "Hut", "a b c the Haus", "7"]
    got = li.predict(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), languages, prior, matrix).orderBy("doc_id").collect()
    for text, row in zip(texts[:-1], got, strict=False):
        found = np.concatenate(list(li.ngram_buckets(li.characters(text), li.BUCKETS)))
        s = np.array([logs[k][found].sum() + p for k, p in zip(languages, prior, strict=True)])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert row["lang_pred"] == languages[int(s.argmax())] and row["score"] == pytest.approx(p.max(), rel=1e-4)
    assert tuple(got[-1])[1:] == ("und", 0.0)


def test_odd_rows(spark):
    texts = ["der die das und", None, "", "123", "the cat sat on", "the cat " * 50_000]
    rows = [(k, texts[k % 6], "de" if k % 6 == 0 else None if k % 6 == 3 else "en", 1) for k in range(60)] + [(None, "the cat", "en", 1)] * 3 + [(4, "the cat sat on", "en", 1)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score int")
    got = li.identify(df).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        want = "en" if r["doc_id"] is None else ["de", "und", "und", "und", "en", "en"][r["doc_id"] % 6]
        assert r["held_out"] == held and r["lang_pred"] == want and (want != "und" or r["score"] == 0)
    assert li.identify(df.limit(0)).collect() == []
    unlabelled = li.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_matrix_is_bounded():
    assert li.matrix_buckets(4) == li.BUCKETS and li.matrix_buckets(5000) * 5000 <= li.CELLS
    with pytest.raises(ValueError):
        li.matrix_buckets(100_000)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    row = li.held_out_accuracy(li.identify(docs), docs).first()
    assert row["n"] > 20 and row["accuracy"] > 0.9
