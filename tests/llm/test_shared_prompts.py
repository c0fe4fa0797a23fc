"""Decontamination where many items share a window with many documents, and its longest matches against brute force."""

import time
from collections import Counter

import numpy as np
import pytest


def hashed(texts):
    from plateaux.llm.common import ALNUM, WordHasher

    h = WordHasher(ALNUM)
    return [h.hashes(data, *h.spans(data)) for data in (np.frombuffer(t.encode(), np.uint8) for t in texts)]


def judge(texts, items, window=10, with_items=True):
    from plateaux.llm.decontaminate import Items, _judge

    return list(_judge([(d, d) for d in range(len(texts))], hashed(texts), Items([i for i, _ in items], [t for _, t in items], window), with_items))


def plain(text, items, window):
    """Items found, and the longest match with the first of its places, by trying every pair of places."""
    w, found, best = text.split(), set(), (0, 0)
    for item, t in items:
        v = t.split()
        n = min(window, len(v))
        for i in range(len(w)):
            for j in range(len(v) - n + 1 if n else 0):
                if w[i:i + n] == v[j:j + n]:
                    found.add(item)
                    m = n
                    while len(v) >= window and i + m < len(w) and j + m < len(v) and w[i + m] == v[j + m]:
                        m += 1
                    best = max(best, (m, -i))
    return sorted(found), best[0], -best[1] if best[0] else None


@pytest.mark.parametrize("window", [1, 2, 4])
@pytest.mark.parametrize("seed", range(8))
def test_random_words_against_every_pair_of_places(seed, window):
    r = np.random.default_rng(seed)
    draw = lambda low, high, letters: " ".join(r.choice(list("abcdef"[:letters]), r.integers(low, high)))
    texts = [draw(0, 40, 2 + k % 4) for k in range(30)] + ["", "a", "a a a a a a a a a"]
    items = [(f"i{k % 9}", draw(0, 14, 2 + k % 4)) for k in range(12)] + [("copy", "a b a b b a"), ("copy2", "a b a b b a")]
    for row, text in zip(judge(texts, items, window), texts, strict=True):
        assert (row["items"], row["longest_match"], row["longest_start"]) == plain(text, items, window)
        assert row["n_items"] == len(row["items"])


def test_ten_thousand_items_and_documents_share_a_prompt():
    prompt = " ".join(f"p{i}" for i in range(13))
    items = [(f"i{k}", f"{prompt} own{k} question{k}") for k in range(10_000)]
    texts = [f"before{d} {prompt} after{d} {prompt} own{d % 7} end" for d in range(10_000)]
    start = time.time()
    rows = judge(texts, items, with_items=False)
    assert time.time() - start < 30
    assert Counter((r["n_items"], r["longest_match"], r["longest_start"]) for r in rows) == {(10_000, 14, 15): 10_000}
    assert len({r["items_sha256"] for r in rows}) == 1 and not any(r["items"] for r in rows)
