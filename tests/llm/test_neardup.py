"""Near duplicates among thousands of edited copies, and what signatures let through."""

import random

import numpy as np
import pytest

from reckonry.llm import op07_neardup as near


def _copies(n):
    draw = random.Random(21)
    base, others = [f"w{k}" for k in range(150)], [f"x{k}" for k in range(6)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in draw.sample(range(150), draw.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            words[at] = draw.choice(others)
        rows.append((i, " ".join(words)))
    return rows


def _reachable(rows, percent):
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    place = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(place)), np.float32)
    for r, s in enumerate(sets):
        held[r, [place[g] for g in s]] = 1
    size, both = held.sum(1), held @ held.T
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    own = np.arange(len(sets))
    while True:
        least = np.where(linked, own[None, :], len(sets)).min(1)
        if (least == own).all():
            return {rows[k][0]: rows[int(c)][0] for k, c in enumerate(own)}
        own = least


@pytest.mark.parametrize("percent", [85, 80])
def test_edited_copies_against_all_pairs(spark, percent):
    rows = _copies(2000)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near.MinHash(percent=percent)).collect()
    assert {r.doc_id: r.component_id for r in got} == _reachable(rows, percent)


def test_signatures_keep_pairs_at_the_limit():
    """The floor lies six standard deviations below what a pair at the limit agrees in."""
    spec = near.MinHash()
    draw = np.random.default_rng(2)
    shared = draw.integers(0, 1 << 63, 850, dtype=np.uint64)
    for k in range(40):
        a, b = (np.concatenate([shared, draw.integers(0, 1 << 63, 75, dtype=np.uint64)]) for _ in range(2))  # similarity 0.85
        _, bits = near._minima(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), spec)
        assert (bits[0] == bits[1]).sum() >= spec.agreeing
    c, d = (draw.integers(0, 1 << 63, 900, dtype=np.uint64) for _ in range(2))
    _, bits = near._minima(np.concatenate([c, d]), np.array([0, 900, 1800]), spec)
    assert (bits[0] == bits[1]).sum() < spec.agreeing
