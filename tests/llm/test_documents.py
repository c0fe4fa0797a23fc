"""Each document operator against a brute-force version on small tables with nulls, empty and repeated texts, and other columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, length int, start int, key string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(r, n):
    words = ["alpha", "Beta", "gamma", "delta.", "Épsilon", "zeta,", "eta", "theta!", "iota", "kappa", "lambda", "straße"]
    return " ".join(r.choice(words) + (r.choice("abcdefgh") if r.random() < 0.5 else "") for _ in range(n))


def corpus():
    r = random.Random(5)
    shared = prose(r, 70)
    base = prose(r, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [base, base, " ".join(near), base + " one more tail", None, "", "  \n ", "one", "two words", "a b c", "x" * 5000, shared, "Before it. " + shared + " After it.", shared + "\nsecond line", prose(r, 3000), "\n".join(["again and again it says."] * 40), "tab\tand  double  spaces\n\nnew", "日本語 のテキスト é", "token = 'abcDEF123456' AKIA" + "ABCDEFGH12345678" + " and deadbeef0123456789abcdef99 end"]
    return [(i * 3, t, "en", 1, 2, "k") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]


def test_packing_is_gapless_and_tight(docs, empty):
    from plateaux.llm.packing import pack

    rows = [r.asDict() for r in pack(docs, capacity=256).collect()]
    for (doc, text, *_), ids in zip(corpus(), ids_of([c[1] for c in corpus()]), strict=True):
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and (len(own) == 1 or len(ids) > 256)
        at = 0
        for k, r in enumerate(own):
            assert r["start"] == at and (k == 0 or r["length"] == 256)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 256
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 256) + 1
    assert pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    from plateaux.llm.packing import plan_table

    r = np.random.default_rng(seed)
    lengths = r.integers(1, 65, r.integers(0, 400))
    counts = np.bincount(lengths, minlength=65)
    plan = plan_table(counts, 64)
    fill = {}
    for n, a, b, s, offset in plan.tolist():
        for k in range(b - a):
            fill.setdefault(s + k, []).append((offset, n))
    assert sum(len(v) for v in fill.values()) == len(lengths)
    for own in fill.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 64


def test_token_files_round_trip(spark, docs, empty):
    from plateaux.llm.common import scratch
    from plateaux.llm.token_files import TokenShard, read_token_files, token_output, write_token_files

    manifest = write_token_files(docs, scratch(spark, "t"), length=64)
    got = {r["doc_id"]: r for r in read_token_files(manifest).collect()}
    start = 0
    for (doc, *_), ids in zip(corpus(), ids_of([c[1] for c in corpus()]), strict=True):
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    m = manifest.orderBy("shard").first()
    shard = TokenShard(m["path"] + ".arrow")
    ids, mask = shard.sequence((m["n_tokens"] - 1) // 64)
    assert len(ids) == len(mask) == 64 and mask.sum() == (m["n_tokens"] - 1) % 64 + 1 and not ids.flags.owndata
    assert token_output(spark, empty).count() == 0


def test_secret_rules(docs, empty):
    from plateaux.llm.secrets import find_secrets

    assign = re.compile("(?:password|passwd|secret|token|api_?key)[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
    got = {r["doc_id"]: r for r in find_secrets(docs).collect()}
    for doc, text, *_ in corpus():
        t, spans = text or "", []
        spans += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert got[doc]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and said in got[doc]["spans"] + said * (not said)
    assert find_secrets(empty).count() == 0


def test_decontamination(spark, docs, empty):
    from plateaux.llm.decontaminate import contamination, decontaminate

    rows = [r[1] or "" for r in corpus()]
    items = [("i1", rows[11][30:250]), ("i2", "two words"), ("i3", None), ("i4", "never seen here at all"), (None, "double spaces"), ("i5", rows[0])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r["doc_id"]: r for r in contamination(docs, bench).collect()}
    for (doc, *_), text in zip(corpus(), rows, strict=True):
        w, hit, found = word.findall(text.translate(LOW)), set(), set()
        for item, t in items:
            v = word.findall((t or "").translate(LOW))
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == v[k:k + n]:
                        hit |= set(range(j, j + n))
                        found.add(item or "")
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r["contaminated"] == bool(hit)
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if not r["contaminated"]}
    assert contamination(empty, bench).count() == 0 and not contamination(docs, bench.limit(0)).where("contaminated").count()


def test_line_dedup_keeps_columns_of_any_name(spark, docs):
    from plateaux.llm.line_dedup import dedup_passages

    named = docs.select("doc_id", "text", F.lit(1).alias("own"), F.lit(2).alias("doc"), F.lit(3).alias("TAG"), F.lit(4).alias("spans"), F.lit(5).alias("_spans"))
    got = dedup_passages(named)
    assert got.columns == named.columns and got.select("own", "doc", "TAG", "spans", "_spans").distinct().collect() == [(1, 2, 3, 4, 5)]
    assert got.count() == named.count()


def test_every_run_holds_a_fingerprint_and_equal_runs_the_same():
    from plateaux.llm.common import SPACED, WordHasher
    from plateaux.llm.line_dedup import Lines

    r = random.Random(4)
    words = [r.choice("abc") + str(r.randrange(30)) for _ in range(400)]
    text = " ".join(words + words[100:180]).encode()
    lines = Lines(np.frombuffer(text, np.uint8), np.array([0, len(text)]), WordHasher(SPACED), 30)
    places = lines.at.tolist()
    assert all(any(i <= p <= i + 20 for p in places) for i in range(480 - 29))
    of = lambda i, j: [p - i for p in places if i <= p <= j - 10]
    assert of(120, 160) == of(420, 460)


def test_linked_groups(docs, empty):
    from plateaux.llm.jaccard import link_components

    sets = {}
    for d, t, *_ in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[d] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    group = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_components(docs).collect()}
    assert got == {d: (len(sets[d]), group[d]) for d in sets} and group[3] == group[6] == 0
    assert link_components(empty).count() == 0


def test_linked_groups_at_random(spark):
    """Sets of all sizes around the threshold, against all pairs."""
    from plateaux.llm.jaccard import link_components

    r = random.Random(11)
    texts = []
    for n in [5, 6, 7, 9, 12, 20, 40, 90, 200]:
        for _ in range(4):
            base = [f"w{r.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(w if r.random() > p else f"v{r.randrange(10**6)}" for w in base) for p in (0, 0, 0.01, 0.02, 0.03, 0.05)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k:k + 4]) for k in range(len(w) - 3)} for w in (t.split() for t in texts)]
    group = list(range(len(sets)))
    for _ in range(6):
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = {r["doc_id"]: r["component_id"] for r in link_components(docs).collect()}
    assert got == dict(enumerate(group))


def test_fingerprints(docs, empty):
    from plateaux.llm.syncmers import anchors, fingerprints, likeness, numbered

    rows = sorted(corpus(), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    for k, (d, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 3
        edited = t[:len(t) - n] + after[:n]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == likeness(numbered(anchors(t)), numbered(anchors(edited))) and r["near_next"] == likeness(numbered(anchors(t)), numbered(anchors(after)))
    assert got[0]["fingerprint"] == got[3]["fingerprint"] and got[12]["fingerprint"] == "" and got[42]["near_edited"] > 0.3
    assert fingerprints(empty).count() == 0


def test_closed_syncmers_by_definition():
    from plateaux.llm import syncmers as s

    text = prose(random.Random(2), 60)
    found = set(s.anchors(text)[1].tolist())
    code = np.array([ord(c) for c in text], np.uint64)

    def inner(i):
        h = (code[i:i + 8] + np.uint64(1)) * s._M[0]
        for k in (1, 2, 4):
            h = h[:-k] * s._M[1] ** np.uint64(k) + h[k:]
        return int(s.mix(h)[0])

    every = [i for i in range(len(text) - s.K + 1) if min(h := [inner(i + k) for k in range(s.K - s.S + 1)]) in (h[0], h[-1])]
    assert found == set(every) and len(every) > 10


def test_likeness_against_all_orders():
    """The longest run of matches in order, by trying every subset, with repeated anchors numbered."""
    from itertools import combinations

    from plateaux.llm.syncmers import likeness, numbered

    r = random.Random(6)
    for _ in range(60):
        one, two = ([(r.randrange(6), 7 * k) for k in range(r.randrange(8))] for _ in range(2))
        named = lambda own: {(h, sum(x == h for x, _ in own[:k])): p for k, (h, p) in enumerate(own)}
        a, b = named(one), named(two)
        both = sorted(a.keys() & b.keys(), key=a.get)
        run = max((n for n in range(len(both) + 1) for c in combinations(both, n) if all(b[x] < b[y] for x, y in zip(c, c[1:], strict=False))), default=0)
        want = run / len(a.keys() | b.keys()) if a and b else float(len(a) == len(b))
        f = [(np.array([h for h, _ in own], np.uint64) * np.uint64(1 << 40), np.array([p for _, p in own], np.int64)) for own in (one, two)]
        assert likeness(numbered(f[0]), numbered(f[1])) == pytest.approx(want)


def test_fingerprints_of_long_texts_share_a_passage():
    from plateaux.llm.syncmers import anchors, likeness, numbered

    r = random.Random(8)
    passage = prose(r, 300)
    one, two = (anchors(prose(random.Random(k), 9000) + " " + passage + " " + prose(random.Random(k + 9), 9000)) for k in (1, 2))
    common = np.intersect1d(one[0], two[0])
    assert len(common) > 100 and likeness(numbered(one), numbered(two)) > 0.005


def test_toxicity_learns_only_from_its_fold(spark, empty):
    from plateaux.llm.toxicity import score_documents

    r = random.Random(4)
    rows = []
    for i in range(240):
        bad = i % 3 == 0
        words = prose(r, 60).split(" ")
        if bad:
            for _ in range(4):
                words[r.randrange(60)] = r.choice(["wretchling", "scumbog", "wretchloon"])
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(1000, "", "x", 1), (1001, None, "x", 1), (None, "wretchling", "x", 1)], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in score_documents(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {d for d, x in got.items() if x["held_out"] and d is not None and d < 1000} == set(held)
    assert np.mean([got[i]["predicted"] == rows[i][2] for i in held]) > 0.9
    assert got[1000]["score"] == got[1001]["score"] and 0 <= got[1000]["score"] < 0.5
    assert score_documents(empty, labels).count() == 0
    one = score_documents(docs, labels.where("toxic = 0"))
    assert one.where("predicted = 1").count() == 0


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline

    root = str(tmp_path)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("a", corpus()[14][1][:300])], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    kept = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, root)
        assert kept.columns == docs.columns
    assert 42 not in {r["doc_id"] for r in kept.collect()}
    assert corpus_pipeline.run(spark, root).select(F.countDistinct("doc_id")).first()[0] == kept.count()


def test_linked_groups_of_many_near_copies(spark):
    """Large groups of copies of copies, most of them just too different from each other."""
    from plateaux.llm.jaccard import link_components

    r = random.Random(3)
    texts = []
    for n in (30, 60, 150):
        own = [[f"w{r.randrange(10**6)}" for _ in range(n)]]
        for _ in range(70):
            w = list(own[0] if r.random() < 0.6 else r.choice(own))
            for _ in range(r.choice([1, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = f"v{r.randrange(30) if r.random() < 0.3 else r.randrange(10**6)}"
            if r.random() < 0.2:
                del w[r.randrange(len(w)):][:2]
            own.append(w)
        texts += [" ".join(w) for w in own]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k:k + 4]) for k in range(len(w) - 3)} or {tuple(w)} for w in (t.split() for t in texts)]
    group = list(range(len(sets)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in link_components(docs).collect()}
    assert got == {i: top(i) for i in range(len(sets))} and len({top(i) for i in range(len(sets))}) < len(sets)


@pytest.mark.parametrize("name", ["op8_benchmark_decontamination", "op10_ngram_jaccard_join", "op11_importance_resampling", "op12_merkle_manifest"])
def test_registered_sql(spark, name):
    import os

    import duckdb

    from plateaux.llm.queries import ORACLE_SQL, QUERIES

    root = "/root/testdata/sf0.001"
    if not os.path.isdir(root):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    df = QUERIES[name](spark, root)
    found = con.execute(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in found.description)
    want = sorted(tuple(r) for r in found.fetchall())
    assert sorted(tuple(r) for r in df.select([d[0] for d in found.description]).collect()) == want
