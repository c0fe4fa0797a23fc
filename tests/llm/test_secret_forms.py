"""Secrets outside the rules, and structured tokens that must be left alone."""

import random
import string
import uuid


def prose(r, n):
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "the", "ing", "tion", "ed", "sh", "wh", "ha"]) for _ in range(r.randrange(1, 4)))
    words = [word() if r.random() < 0.95 else str(r.randrange(10 ** r.randrange(1, 9))) for _ in range(n)]
    return " ".join(w.capitalize() if r.random() < 0.1 else w for w in words)


def test_random_values_are_found_and_structured_ones_left_alone(spark):
    from plateaux.llm.secrets import find_secrets

    r = random.Random(21)
    value = lambda letters, n=40: "".join(r.choice(letters) for _ in range(n))
    base62 = string.ascii_letters + string.digits
    long, url, plain = value(base62 + "+/", 38) + "/+", value(base62 + "-_", 38) + "-_", value(string.ascii_letters)
    cases = [("AWS_ACCESS=", long, ""), ("AUTH_VALUE=", url, ""), ("export PRIVATE=", value(base62), "=="), ("see ", plain, ""), ("files/of_", value(base62), "/x-y"), ("A=B=", value(base62), "=c")]
    cases += [("key ", value(base62, 64), "") for _ in range(6)]
    tidy = ["nothing/of_that-kind=here " + "ab1" * 30, "colour #a1b2c3 and #ffffff", str(uuid.UUID(int=r.getrandbits(128))), "2024-01-31T12:30:45+00:00/2024-02-28", "12345678901234567890123456789", "some_function_name_that_is_long_enough_to_be_seen", "src/main/java/org/example/project/SomeClassFactory", "thingtheringtheonetheshetheringthewhatheretion", "IMG_20240131_123045_0001_final_version_for_print"]
    rows = [(i, a + v + b) for i, (a, v, b) in enumerate(cases)] + [(100 + i, t) for i, t in enumerate(tidy)] + [(1000 + i, prose(r, 400)) for i in range(300)]
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, cases[0][1]), rows[0]], "doc_id long, text string")
    found = find_secrets(docs).collect()
    got = {x["doc_id"]: x for x in found}
    for i, (a, v, b) in enumerate(cases):
        end = len(a + v) + (2 if b == "==" else 0)
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[i]["spans"].split(",") if s.startswith("random")]
        assert any(s <= len(a) and e >= end for s, e in spans), (i, spans, a + v + b)
        assert got[i]["n_random"] == len(spans)
    assert all(got[100 + i]["n_random"] == 0 for i in range(len(tidy))), [t for i, t in enumerate(tidy) if got[100 + i]["n_random"]]
    assert sum(x["n_random"] for x in found if (x["doc_id"] or 0) >= 1000) == 0
    assert len(found) == docs.count() and sum(x["doc_id"] == 0 for x in found) == 2


def test_battery_by_its_definition():
    import numpy as np

    from plateaux.llm.secrets import ALPHABETS, encodings, randomness

    r = random.Random(3)
    letters = dict(ALPHABETS)
    tokens = ["".join(r.choice(letters[k]) for _ in range(r.randrange(20, 90))) for k in letters for _ in range(5)] + ["aaaabbbbcccc1111ddddeeee", "abcdefghij" * 4]
    flat, size = np.frombuffer("".join(tokens).encode(), np.uint8), np.array([len(t) for t in tokens])
    at = np.cumsum(size) - size
    got, kinds = randomness(flat, at), encodings(flat, at)
    for t, x, k in zip(tokens, got, kinds, strict=True):
        alphabet = ALPHABETS[k][1]
        code, n, base = [alphabet.index(c) for c in t], len(t), len(alphabet)
        chi = sum((code.count(v) - n / base) ** 2 / (n / base) for v in range(base))
        df = base - 1
        u = max(0, ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
        high = [c >= base / 2 for c in code]
        a, b = sum(high), n - sum(high)
        runs, mean = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False)), 1 + 2 * a * b / n
        z = (runs - mean) / (max((mean - 1) * (mean - 2) / (n - 1), 1e-9)) ** 0.5 if a * b else n**0.5
        m = sum(code) / n
        total = sum((c - m) ** 2 for c in code)
        s = (sum((p - m) * (q - m) for p, q in zip(code, code[1:], strict=False)) / total + 1 / n) * n**0.5 if total else n**0.5
        assert abs(x - (u**2 + min(z**2, 400) + min(s**2, 400))) < 1e-6 * (1 + x), t
    assert all(x > 20 for x in got[-2:])


def test_every_text_counts_in_every_band(spark):
    """Texts whose lengths agree modulo the number of bands, as any other, give strings of all the bands' lengths."""
    from plateaux.llm.secrets import BANDS, structured

    r = random.Random(5)
    rows = [(i, prose(r, 90)[:300].ljust(300, "x")) for i in range(30)] + [(50, "é short"), (51, None)]
    found = structured(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [0] * len(BANDS)
    for _, text in rows:
        plain = sum(c in string.ascii_letters + string.digits for c in text or "")
        want = [n + plain // size for n, size in zip(want, BANDS, strict=True)]
    assert [sum(x["n"] for x in found if x["band"] == k) for k in range(len(BANDS))] == want and min(want) > 0
