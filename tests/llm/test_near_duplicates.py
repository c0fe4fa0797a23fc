"""The near-duplicate stage holds five-word shingles against 0.8; op10's own parameters are others. Null and repeated ids."""

import random


def test_pairs_between_80_and_85_per_cent(spark):
    from plateaux.llm.pipeline import near_duplicates

    r = random.Random(12)
    rows, want, middle = [], set(), 0
    for k in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([60, 120, 300]))]
        other = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            other[r.randrange(len(other))] = f"v{r.randrange(10**6)}"
        a, b = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (base, other))
        middle += 80 <= 100 * len(a & b) / len(a | b) < 85
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        want |= {2 * k} | ({2 * k + 1} if 100 * len(a & b) < 80 * len(a | b) else set())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert middle >= 2 and {x["doc_id"] for x in near_duplicates(spark, docs, "").collect()} == want


def test_null_and_repeated_ids(spark):
    from plateaux.llm.jaccard import link_components

    text = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(4)]
    near = text[0] + " end"
    # document 5 stands twice, with texts of two groups, and so joins them
    rows = [(1, text[0]), (None, text[0]), (2, near), (None, near), (None, text[3]), (None, None), (5, text[1]), (5, text[2]), (6, text[1]), (7, text[2]), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in link_components(docs).collect() if r["doc_id"] is not None)
    assert got == [(1, 37, 1), (2, 38, 1), (5, 37, 5), (5, 37, 5), (6, 37, 5), (7, 37, 5), (8, 0, 8), (8, 0, 8)]
    nulls = sorted((r["n_shingles"], r["component_id"]) for r in link_components(docs).collect() if r["doc_id"] is None)
    assert nulls == [(0, None), (37, None), (37, None), (38, None)]


def test_short_texts_in_large_and_small_buckets(spark, monkeypatch):
    """Variants that all miss a hub's last shingle are linked by it, though one of them is similar to the hub and the other is not."""
    from plateaux.llm import jaccard

    r, rows = random.Random(5), []
    for k in range(30):
        base = [f"w{k}x{i}" for i in range(r.choice([9, 12, 14, 14]))]
        rows += [" ".join(base), " ".join(base[:-1])]
        rows += [" ".join(base[:-1] + [f"v{k}x{j}", f"u{k}x{j}"]) for j in range(r.choice([2, 7]))]
        rows += [" ".join(base[:-1] + [f"z{k}x{j}"]) for j in range(r.choice([1, 6]))]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    least = list(range(len(rows)))
    for _ in range(6):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for few in (1, 4):
        monkeypatch.setattr(jaccard, "FEW", few, raising=False)
        got = {x["doc_id"]: x["component_id"] for x in jaccard.link_components(docs, words=5, similarity=80).collect()}
        assert got == dict(enumerate(least))


def test_members_that_met_the_hub_by_chance_are_done(spark):
    from plateaux.llm.jaccard import open_buckets

    # 1 to 50 meet hub 0 in a bucket each; 51 and 52 share one with it, 53 to 60 another
    buckets = [(k, k, 0) for k in range(1, 51)] + [(100, 51, 0), (100, 52, 0)] + [(101, k, 0) for k in range(53, 61)]
    placed = spark.createDataFrame(buckets, "bucket long, a long, b long")
    rows = spark.createDataFrame([(k, 0, 100, 100, 60, 60, k) for _, k, _ in buckets], "a long, b long, na int, nb int, missed int, more int, group long")
    pairs, members = open_buckets(rows, placed, 80)
    assert [tuple(x) for x in pairs.collect()] == [(51, 52)] and {x["a"] for x in members.collect()} == set(range(53, 61))
