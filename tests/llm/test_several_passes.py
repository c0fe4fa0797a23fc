"""A benchmark that needs several passes gives the rows of one pass, repeated rows and null ids included."""


def test_rows_do_not_depend_on_the_number_of_passes(spark, monkeypatch):
    from plateaux.llm import decontaminate as d

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i:i + 60]) for i in range(0, 340, 20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[5]), (None, None), (99, ""), (7, "other words of no item " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = [(f"i{k}", " ".join(words[k * 13:k * 13 + 25])) for k in range(25)] + [("i1", "w1"), (None, " ".join(words[5:20]))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    shown = lambda: sorted(map(str, d.contamination(docs, benchmark, with_items=True).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "longest_match", "longest_start").collect()))
    one = shown()
    assert len(one) == len(rows) and sum("n_hit=0" not in x for x in one) >= len(texts)
    monkeypatch.setattr(d, "BLOCK", 1200)
    assert shown() == one
