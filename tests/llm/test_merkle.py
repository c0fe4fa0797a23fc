import hashlib
import zlib

import pytest

from plateaux.llm.merkle import manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows, arity=2):
    """doc_id, leaf, subroot, root, proof, folded root and whether it is the root, one node after the other."""
    paths = {i: [] for i in range(len(rows))}

    def climb(nodes):
        while len(nodes) > 1:
            upper = []
            for k in range(0, len(nodes), arity):
                run = nodes[k:k + arity]
                for j, (_, own) in enumerate(run):
                    for o in own:
                        paths[o].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1:])))
                upper.append((digest("".join(h for h, _ in run)), [o for _, own in run for o in own]))
            nodes = upper
        return nodes[0]

    langs = {}
    for i, r in enumerate(rows):
        langs.setdefault(r[2], []).append(i)
    tops, subroot = [], {}
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        ids = sorted(langs[lang], key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf(rows[i])))
        top = climb([(leaf(rows[i]), [i]) for i in ids])
        tops.append(top)
        subroot |= dict.fromkeys(top[1], top[0])
    root = climb(tops)[0] if tops else None
    out = []
    for i, r in enumerate(rows):
        bent = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        folded = leaf((*r[:3], r[3] + 1, r[4]) if bent else r)
        for before, after in paths[i]:
            folded = digest(before + folded + after)
        out.append((r[0], leaf(r), subroot[i], root, digest("".join(b + a for b, a in paths[i])), folded, folded == root))
    return out


def rows_of(n):
    return [(None if i % 50 == 49 else i // 2 if i % 9 == 0 else i, None if i % 5 == 0 else "s", [None, "", "en", "é", "fr"][i * 7 % 5] if i % 3 else "en", None if i % 11 == 0 else i, None if i % 13 == 0 else f"tëxt{i}") for i in range(n)]


@pytest.mark.parametrize("arity,stride,n", [(2, 8, 0), (2, 8, 1), (2, 2, 37), (3, 2, 100), (2, 8, 700)])
def test_against_one_node_after_the_other(spark, arity, stride, n):
    rows = rows_of(n)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert sorted(map(tuple, manifest(df, arity, stride).collect()), key=str) == sorted(brute(rows, arity), key=str)


def test_repeated_rows_long_texts_and_other_columns(spark):
    rows = [(5, "s", "en", 3, "abc")] * 30 + [(6, "s", "en", 9_000_000, "x" * 3_000_000), (7, "s", "en", 2**62, "")]
    df = spark.createDataFrame([(*r, "h", "r") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, Hash string, row string")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert sorted(map(tuple, manifest(df).collect()), key=str) == sorted(brute(rows), key=str)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
