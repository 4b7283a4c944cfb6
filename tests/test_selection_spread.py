"""Selection with its tuples in Spark against the same on the driver, and the swap lists against all pairs."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dpspark import fixtures
from dpspark.catalogue import TAKEN, small_release
from dpspark.fixtures import F5
from dpspark.plans import selection, spread, swaps
from dpspark.plans.selection import Family, refine


@pytest.fixture(scope="module")
def pool(spark, sf_dir):
    return fixtures.f5(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderpriority", "y")


def test_raking_in_spark(spark, pool, monkeypatch):
    by = selection.keys(F5)
    small = selection.inclusion_weights(F5, small_release(), F5.coerce(pool), TAKEN, 12).toPandas()
    monkeypatch.setattr(selection, "MOST_TUPLES", 10)
    large = selection.inclusion_weights(F5, small_release(), F5.coerce(pool), TAKEN, 12).toPandas()
    both = small.merge(large, on=by, suffixes=("", "_s"))
    assert len(both) == len(small) == len(large) > 10
    assert (both["_n"] == both["_n_s"]).all() and (both["_w"] - both["_w_s"]).abs().max() < 1e-9


def test_sums_of_all_before(spark):
    rng = np.random.default_rng(1)
    t = pd.DataFrame({"a": rng.choice(["x", "y", "z"], 400), "b": rng.random(400) < 0.5, "c": rng.integers(-1, 6, 400), "d": rng.integers(0, 9, 400)}).drop_duplicates()
    t["m"] = rng.random(len(t))
    want = t.sort_values(["a", "b", "c", "d"], ignore_index=True)
    want["before"] = want["m"].cumsum() - want["m"]
    df = spread.ahead(spark.createDataFrame(t).repartition(7), ["a", "b", "c", "d"], F.col("m"), "before")
    got = df.toPandas().sort_values(["a", "b", "c", "d"], ignore_index=True)
    assert np.allclose(got["before"], want["before"], atol=1e-12) and (got["m"] == want["m"]).all()
    assert spread.ahead(spark.createDataFrame(t).where("false"), ["a", "b", "c", "d"], F.col("m"), "before").count() == 0


@pytest.mark.parametrize("refined", [False, True])
def test_the_same_rows_either_way(pool, monkeypatch, refined):
    """Lists of four tuples are drawn anew again and again, and still give the best swap each time."""
    take = lambda: sorted(tuple(r) for r in selection.select_to_release(F5, small_release(), pool, TAKEN, "o_orderkey", rounds=5, seed=7, refined=refined).collect())
    small = take()
    monkeypatch.setattr(selection, "MOST_TUPLES", 10)
    monkeypatch.setattr(swaps, "LISTED", 16)
    assert take() == small and len(small) == TAKEN


def random_case(seed: int, tuples: int, bins: int = 5, families: int = 4):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 6, tuples)
    taken = np.array([rng.integers(0, s + 1) for s in size])
    found = []
    for _ in range(families):
        f = Family(rng.integers(-1, bins, tuples), rng.dirichlet(np.ones(bins)) * taken.sum())
        f.target[rng.random(bins) < 0.1] = np.nan
        found.append((f, rng.choice([1.0, 3.0, 30.0], bins)))
    found[0] = (Family(rng.integers(0, 2, tuples), np.array([0.5, 0.5]) * taken.sum()), np.ones(2))
    return pd.DataFrame({"_n": size}), found, taken


def worth(found, taken):
    return sum(float(np.nansum(w * np.abs(np.bincount(f.of[f.of >= 0], taken[f.of >= 0], len(f.target)) - f.target))) for f, w in found)


@pytest.mark.parametrize("seed", range(8))
def test_short_lists_change_nothing(monkeypatch, seed):
    t, found, taken = random_case(seed, 60)
    whole = refine(t, found, taken)
    monkeypatch.setattr(swaps, "LISTED", 2)
    assert (refine(t, found, taken) == whole).all() and worth(found, whole) < worth(found, taken)
    # no single swap is left that gains
    for i in np.flatnonzero(whole > 0):
        for j in np.flatnonzero(whole < t["_n"].to_numpy()):
            if i != j:
                other = whole.copy()
                other[i], other[j] = other[i] - 1, other[j] + 1
                assert worth(found, other) >= worth(found, whole) - 1e-8


@pytest.mark.parametrize("off", [-7, 5])
def test_a_missed_number_of_rows_is_mended(off):
    """The best rows come or go first, so that n rows are taken in the end."""
    t, found, taken = random_case(3, 40)
    n = int(taken.sum()) - off
    out = refine(t, found, taken, 0, n)
    assert out.sum() == n and (out >= 0).all() and (out <= t["_n"]).all()
    step = taken.copy()
    for _ in range(abs(off)):
        sign = -1 if off > 0 else 1
        tried = [k for k in range(40) if (step[k] > 0 if sign < 0 else step[k] < t["_n"][k])]
        step[min(tried, key=lambda k: (round(worth(found, step + sign * (np.arange(40) == k)), 9), k))] += sign
    assert worth(found, step) == pytest.approx(worth(found, out))


def test_swaps_look_at_lists_only(monkeypatch):
    """200,000 tuples: the lists are drawn a few times for hundreds of swaps, and a swap takes no longer than with 20,000."""
    def run(tuples: int) -> tuple[float, int]:
        t, found, taken = random_case(5, tuples, bins=20, families=6)
        drawn = []
        monkeypatch.setattr(swaps.Held, "listed", lambda self, *a, f=listed: drawn.append(1) or f(self, *a))
        began = time.time()
        refine(t, found, taken, 300)
        return time.time() - began, len(drawn)

    listed = swaps.Held.listed
    (_, few), (took, many) = run(20_000), run(200_000)
    assert many <= few + 5 <= 40 and took < 30


def test_an_empty_room_ends(spark):
    t, found, _ = random_case(2, 10)
    full = t["_n"].to_numpy().copy()
    assert (refine(t, found, full) == full).all()
    assert refine(t, found, full, n=int(full.sum()) + 4).sum() == full.sum()
    none = np.zeros(10, int)
    assert refine(t, found, none).sum() == 0
