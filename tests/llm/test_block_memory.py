"""Bounds on what a task holds, as multiples of its input."""

import tracemalloc

import numpy as np
import pytest

from panelspark.llm import chosen_path


def peak(run, *args):
    tracemalloc.start()
    try:
        out = run(*args)
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("sizes", [[1], [3, 1, 2], [50] * 20])
def test_united_sets_are_those_of_brute_force(sizes):
    rnd = np.random.Generator(np.random.PCG64(len(sizes)))
    sets = [np.unique(rnd.integers(0, 60, n).astype(np.uint64)) for n in sizes]
    label = chosen_path.unite(sets, [bytes([i]) for i in range(len(sets))], 30, np.full(len(sets), -1))
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 100 * len(np.intersect1d(a, b)) >= 30 * len(np.union1d(a, b)):
                want = [want[i] if x == want[j] else x for x in want]
    assert [label.tolist().index(x) for x in label] == [want.index(x) for x in want]


def test_blocks_of_sets_hold_few_bytes_a_shingle():
    rnd = np.random.Generator(np.random.PCG64(2))
    sets = [np.unique(rnd.integers(0, 1 << 63, 2000, dtype=np.uint64)) for _ in range(150)]
    _, most = peak(chosen_path.unite, sets, [bytes([i]) for i in range(150)], 80, np.full(150, -1))
    assert most < 45 * sum(map(len, sets))
