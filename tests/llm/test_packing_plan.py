"""Plans of packing: never longer than best fit alone, near the least possible on small cases, sums kept right."""

from functools import cache

import numpy as np
import pytest


def sequences(plan):
    return sum(times for _, times in plan.patterns)


@pytest.mark.parametrize("kind", ["uniform", "log_normal", "few", "middle"])
def test_not_more_than_best_fit(kind):
    from plateaux.llm.packing import Plan, best_fit, best_plan

    r = np.random.default_rng(7)
    lengths = {"uniform": r.integers(1, 2049, 5000), "log_normal": np.clip(r.lognormal(6, 1, 5000).astype(int) + 1, 1, 2048), "few": r.choice([1024, 700, 683, 341, 1365, 11], 5000), "middle": r.integers(300, 900, 5000)}[kind]
    counts = np.bincount(lengths, minlength=2049)
    alone = Plan(2048)
    best_fit(alone, counts.copy())
    assert -(-lengths.sum() // 2048) <= sequences(best_plan(counts, 2048)) <= sequences(alone)


def least(lengths, capacity):
    """The least number of sequences, by trying every place for every piece."""
    lengths = tuple(sorted(lengths, reverse=True))

    @cache
    def more(k, rooms):
        if k == len(lengths):
            return 0
        n = lengths[k]
        options = [1 + more(k + 1, tuple(sorted((*rooms, capacity - n))))]
        options += [more(k + 1, tuple(sorted((*rooms[:i], room - n, *rooms[i + 1:])))) for i, room in enumerate(rooms) if room >= n and room not in rooms[:i]]
        return min(options)

    return more(0, ())


def test_small_cases_against_every_plan():
    from plateaux.llm.packing import best_plan

    r, beyond = np.random.default_rng(3), 0
    for _ in range(60):
        lengths = r.integers(1, 17, r.integers(1, 10)).tolist()
        beyond += sequences(best_plan(np.bincount(lengths, minlength=17), 16)) - least(lengths, 16)
    assert 0 <= beyond <= 2


def test_exact_fills_of_four_are_found():
    from plateaux.llm.packing import best_plan

    counts = np.bincount([70, 13, 9, 8] * 50, minlength=101)
    assert sequences(best_plan(counts, 100)) == 50


def test_sums_follow_the_lengths_left():
    from plateaux.llm.packing import Sums

    left = np.bincount([3, 3, 5, 9, 9, 9, 14], minlength=31)
    sums = Sums(left, 30, True)
    for used in ([3, 5], [9, 9], [14, 3], [9]):
        sums.take(used)
        have = np.flatnonzero(left > 0).tolist()
        pairs = [a + b for i, a in enumerate(have) for b in have[i:]]
        triples = [a + b + c for i, a in enumerate(have) for j, b in enumerate(have[i:], i) for c in have[j:]]
        assert np.flatnonzero(sums.have).tolist() == have
        assert sums.pairs.tolist() == np.bincount(np.array(pairs, int), minlength=61).tolist()
        assert sums.triples.tolist() == np.bincount(np.array(triples, int), minlength=91).tolist()
