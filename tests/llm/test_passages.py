"""Passages that are cut and pasted within sentences, against brute force over words."""

import random
import re


def test_passages_cut_and_pasted_within_sentences(spark):
    from plateaux.llm.line_dedup import dedup_passages, deduped_documents

    r = random.Random(8)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "delta.", "straße", "zeta,"]) + (r.choice("abcdefgh") if r.random() < 0.8 else "") + str(r.randrange(3000))
    prose = lambda n: [word() for _ in range(n)]
    long = prose(400)
    rows = [(10, long)]
    for k, n in enumerate([29, 30, 31, 37, 51, 51, 51, 51, 90, 200]):
        at = r.randrange(400 - n)
        rows.append((11 + k, prose(r.randrange(40)) + [w.upper() if w.isascii() else w for w in long[at:at + n]] + prose(r.randrange(40))))
    rows += [(30, long[:35] + long[200:240]), (31, ["so", "it", "goes"] * 30), (32, prose(12) + long[:29]), (33, long), (33, prose(9) + long[:60] + prose(9)), (34, []), (35, None), (36, long), (37, long[:20]), (38, long[:20])]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows += [(39, prose(60))]
    texts = [(d, None if w is None else "".join(x + r.choice([" ", " ", "  ", "\n"]) for x in w).rstrip()) for d, w in rows]
    texts += [(40, " " + texts[-1][1]), (41, texts[-1][1]), (42, " " + texts[-1][1]), (9, texts[0][1]), (37, texts[0][1])]
    docs = spark.createDataFrame([(d, t, "k", None if t is None else len(t)) for d, t in texts], "doc_id long, text string, tag string, n_chars long")
    found = [(d, t, [(m.start(), m.group().translate(lower)) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]) for d, t in texts]
    keys = {(x["doc_id"], x["text"]): x["h"] for x in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    found.sort(key=lambda x: (x[0], keys[x[0], x[1]]))
    seen, want = set(), []
    for d, t, w in found:
        gone = set()
        for i in range(len(w) - 29):
            key = tuple(x[1] for x in w[i:i + 30])
            if key in seen:
                gone |= set(range(i, i + 30))
            seen.add(key)
        ends = [x[0] for x in w[1:]] + [len(t or "")]
        kept = t if not w else t[:w[0][0]] + "".join(t[w[i][0]:ends[i]] for i in range(len(w)) if i not in gone)
        want.append((d, kept, None if kept is None else len(kept)))
    order = lambda rows: sorted(rows, key=lambda x: (x[0], x[1] or ""))
    got = dedup_passages(docs)
    assert got.columns == docs.columns
    assert order((x["doc_id"], x["text"], x["n_chars"]) for x in got.collect()) == order(want)
    assert order((x["doc_id"], x["text"], x["n_kept"]) for x in deduped_documents(docs).collect()) == order(want)
    assert dedup_passages(docs.limit(0)).count() == 0


def test_places_are_extended_together():
    """Small batches are joined before places are compared: as many rows as before, in few batches; also slices of arrays."""
    import numpy as np
    import pyarrow as pa

    from plateaux.llm.common import binary, joined_batches

    parts = [pa.record_batch({"x": pa.array([bytes([k, i, 7]) for i in range(5)])}) for k in range(9)]
    out = list(joined_batches([p.slice(1) for p in parts], 16))
    assert [b.num_rows for b in out] == [16, 16, 4]
    want = b"".join(bytes([k, i, 7]) for k in range(9) for i in range(1, 5))
    assert np.concatenate([binary(b.column(0)) for b in out]).tobytes() == want
    assert binary(parts[3].column(0).slice(2, 2)).tobytes() == bytes([3, 2, 7, 3, 3, 7]) and not list(joined_batches([], 16))
