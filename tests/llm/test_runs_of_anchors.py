"""A shard's stretches are sorted by runs of anchors, however many they are, so that no sort of names goes deeper."""

import random

import numpy as np

from lexspark.llm import induced, repeats, substrings


def test_runs_hold_whole_anchors_and_all_of_them():
    anchors, sizes = np.repeat([4, 7, 8, 9, 11], [3, 1, 5, 1, 2]), np.full(12, 10)
    assert list(substrings.runs_of_anchors(anchors, sizes, 1000)) == [(0, 12)]
    assert list(substrings.runs_of_anchors(anchors, sizes, 40)) == [(0, 4), (4, 9), (9, 12)]
    assert list(substrings.runs_of_anchors(anchors, sizes, 1)) == [(0, 3), (3, 4), (4, 9), (9, 10), (10, 12)]


def test_a_long_shard_is_not_sorted_in_one_go(monkeypatch):
    rng = random.Random(3)
    anchors, bodies = [], []
    for anchor in range(40):
        core = bytes(rng.choices(b"abcd", k=52))
        for _ in range(20):
            anchors.append(anchor)
            bodies.append(bytes(rng.choices(b"abcd", k=rng.randrange(14))) + core + bytes(rng.choices(b"abcd", k=rng.randrange(14))))
    n = np.array([len(b) - 49 for b in bodies])
    ids = np.array(rng.sample(range(len(bodies)), len(bodies)))
    made = []

    class Disk(induced.Disk):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(induced, "Disk", Disk)
    zeros = np.zeros(len(ids), dtype=np.int64)
    found = {base: substrings._find(repeats.BYTES, 100_000, base)(repeats.Stretches(np.array(anchors), ids, zeros, zeros, n, bodies)) for base in (1_000_000, 2_000)}
    assert len(made) > 10 and all(d.depth == 1 for d in made)
    as_set = lambda r: set(zip(*(x.tolist() for x in r), strict=True))
    assert as_set(found[2_000]) == as_set(found[1_000_000]) and len(found[2_000][0]) > 500
