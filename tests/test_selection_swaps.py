"""Swaps of the selection against trying every swap, and what it refuses."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from dpspark.errors import GenerationError
from dpspark.plans.selection import Family, refine, select_to_release


def distance(found, taken):
    return sum(float((w * np.abs(np.bincount(f.of[f.of >= 0], taken[f.of >= 0], len(f.target)) - f.target)).sum()) for f, w in found)


@pytest.mark.parametrize("seed", range(6))
def test_best_swap_each_time(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 6, 12)
    taken = np.array([rng.integers(0, s + 1) for s in size])
    n = taken.sum()
    found = []
    for _ in range(3):
        f = Family(rng.integers(0, 4, 12), rng.dirichlet(np.ones(4)) * n)
        found.append((f, rng.choice([1.0, 3.0], 4)))
    t = pd.DataFrame({"_n": size})
    for step in range(1, 8):
        out, before = refine(t, found, taken, step), refine(t, found, taken, step - 1)
        tried = [before]
        for i in range(12):
            for j in range(12):
                if i != j and before[i] > 0 and before[j] < size[j]:
                    other = before.copy()
                    other[i], other[j] = other[i] - 1, other[j] + 1
                    tried.append(other)
        assert out.sum() == n and (out <= size).all() and (out >= 0).all()
        assert distance(found, out) == pytest.approx(min(distance(found, x) for x in tried))


def test_refusals(spark):
    pool = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(GenerationError, match="sub_bin"):
        select_to_release(None, None, pool, 1, "id", sub_bin="other")
    with pytest.raises(GenerationError, match="fewer than the 2"):
        select_to_release(None, None, pool, 2, "id")
