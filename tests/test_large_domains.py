"""What has to hold for any number of cells, partitions, rows and scores: sparse levels, lineages, samples, AUC."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dpspark import domains, fixtures, ledger
from dpspark.catalogue import WIDE
from dpspark.errors import DomainTooLargeError
from dpspark.functions import binning
from dpspark.functions.draw import uniform
from dpspark.noise import Noise
from dpspark.operators import counts, sampling, students
from dpspark.plans import release


def dense(exact: dict, size: int, n_min: int, scale: float, noise: Noise) -> dict:
    out = {at: exact.get(at, 0) + noise.laplace(scale) for at in range(size)}
    return {at: release.published(v, n_min) for at, v in out.items() if v >= n_min}


def test_sparse_cells_are_released_like_dense_ones():
    """How often each cell is released, and with which support, over 20,000 releases by either mechanism."""
    exact, size, n_min, scale, rounds = {3: 40, 7: 55, 11: 50, 12: 1}, 30, 50, 20.0, 20_000
    seen = []
    for mechanism in (lambda n: dense(exact, size, n_min, scale, n), lambda n: release.gated(exact, size, n_min, scale, True, n)):
        noise, often, support, number = Noise(5), np.zeros(size), np.zeros(size), np.zeros(size + 1)
        for _ in range(rounds):
            out = mechanism(noise)
            number[len(out)] += 1
            for at, n in out.items():
                often[at] += 1
                support[at] += n
        seen.append((often / rounds, support / np.maximum(often, 1), number / rounds))
    (p, s, k), (q, t, m) = seen
    empty = [at for at in range(size) if at not in exact]
    assert np.abs(p - q).max() < 5 * math.sqrt(0.25 / rounds) and np.abs(k - m).max() < 5 * math.sqrt(0.25 / rounds)
    assert abs(p[empty].mean() - math.exp(-n_min / scale) / 2) < 0.002 and abs(q[empty].mean() - p[empty].mean()) < 0.002
    assert abs(s[empty].mean() - t[empty].mean()) < 1.0 and np.abs(s - t)[list(exact)].max() < 3.0


def test_places_are_skipped_to():
    noise = Noise(1)
    found = [at for _ in range(400) for at in noise.places(1000, 40.0, 10.0)]
    chance = math.exp(-4.0) / 2
    assert abs(len(found) / 400_000 - chance) < 0.0008 and abs(np.mean(found) - 499.5) < 20
    assert list(noise.places(10**12, 50_000.0, 10.0)) == [] and list(noise.places(0, 1.0, 1.0)) == []
    # a chance of a half, and one that is 0 in floating point
    assert abs(sum(1 for _ in noise.places(4000, 0.0, 1.0)) - 2000) < 250 and list(noise.places(10, 1e6, 1.0)) == []


def test_a_level_of_ten_million_cells(spark, sf_dir):
    level = WIDE.conditional[0]
    size = domains.level_size(WIDE, level)
    assert size == 49 * 130 * 10 * 8 * 7 * 3 and size > 10**7
    lines = fixtures.f1(spark, sf_dir).where("l_orderkey % 20 = 0")
    many = lines.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(220))))
    r = release.release_statistics(WIDE, many, epsilon_total=8.0, seed=3)
    (found,) = r.conditional_levels
    exact = {domains.cell_name(WIDE, level, x["at"]): x["n"] for x in counts.occupied(WIDE, WIDE.coerce(many), level).collect()}
    assert found["cells"] and all(abs(exact.get(c, 0) - x["support"]) < 200 for c, x in found["cells"].items())
    entries = [q for q in r.audit["queries"] if q["group"] == "published_counts_cells_L0"]
    assert len(entries) == 1 and str(size) in entries[0]["name"] and r.audit["epsilon_accounted"] <= 8.0 + 1e-9
    # the names are those of the rows' own cells
    named = {x["c"] for x in WIDE.coerce(lines).select(domains.cell_key(WIDE, level).alias("c")).distinct().collect()}
    assert set(exact) == named


def test_too_many_empty_cells_are_refused():
    with pytest.raises(DomainTooLargeError, match="would be released"):
        release.gated({}, 10**12, 50, 20.0, True, Noise(1))
    assert release.gated({5: 60}, 10**12, 50, 1e-3, False, Noise(1)) == {5: 60}


def test_sparse_and_dense_levels_agree_on_counts(spark, sf_dir):
    from dpspark.fixtures import F2

    data = F2.coerce(fixtures.f2(spark, sf_dir))
    listed = {(r["level"], r["cell"]): (r["n"], r["n_pos"]) for r in counts.level_counts(F2, data).collect() if r["n"]}
    for i, level in enumerate(F2.conditional):
        found = {(i, domains.cell_name(F2, level, r["at"])): (r["n"], r["n_pos"]) for r in counts.occupied(F2, data, level).collect()}
        assert found == {k: v for k, v in listed.items() if k[0] == i}
        assert sorted(domains.cell_name(F2, level, k) for k in range(domains.level_size(F2, level))) == domains.cells(F2, level)
    strange = data.withColumn("l_returnflag", F.lit("?"))
    assert counts.occupied(F2, strange, ("l_returnflag",)).isEmpty()


def test_lineages_are_the_ledgers(spark):
    rng = random.Random(2)
    book, rows = ledger.PrivacyLedger(1e6), []
    for i in range(300):
        group, path = rng.choice("abc"), tuple(rng.choice(["x", "y", "xy"]) for _ in range(rng.randint(0, 4)))
        kind, epsilon = rng.choice([ledger.SEQUENTIAL, ledger.PARALLEL, ledger.PARALLEL]), rng.random()
        book.spend(f"q{i}", "count", epsilon, 1.0, kind, path, group)
    frame = book.frame(spark)
    assert ledger.ledger_total(frame).first()[0] == pytest.approx(book.total())
    audit = book.audit()["groups"]
    for r in ledger.audit_rollup(frame).collect():
        own = audit[r["grp"]]
        assert all(r[k] == pytest.approx(own[k]) for k in ("sequential_sum", "parallel_cost", "group_total", "n_partitions", "n_queries"))
    plan = ledger.lineages(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "parent" in plan and "startswith" not in plan.lower()
    assert ledger.ledger_total(frame.where("false")).first()[0] == 0.0


@pytest.mark.parametrize("n", [0, 1, 37, 5000, 9999, 10_000, 20_000])
def test_exact_samples(spark, monkeypatch, n):
    """By one range, and, with ranges of at most two rows in order, by two steps down to equal draws."""
    df = spark.range(10_000).withColumn("key", F.col("id") % 4000)
    want = df.select("id", uniform(F.col("key"), 3).alias("u"), "key").toPandas().sort_values(["u", "key"])
    for rows in (50_000, 2):
        monkeypatch.setattr(sampling, "GROUP_ROWS", rows)
        got = sampling.simple_sample(df, "key", n, 3).toPandas()
        assert len(got) == min(n, 10_000) and got["id"].is_unique
        assert sorted(got["key"]) == sorted(want["key"].head(n))
    assert sampling.simple_sample(df.where("false"), "key", n, 3).count() == 0


def brute_auc(s: np.ndarray, p: np.ndarray) -> float:
    return float(((s[p][:, None] > s[~p]) + 0.5 * (s[p][:, None] == s[~p])).mean())


def test_auc_of_ties_and_hot_scores(spark):
    rng = np.random.default_rng(4)
    for s in (rng.random(3000), rng.integers(0, 7, 3000) * 1.0, np.where(rng.random(3000) < 0.4, 0.5, rng.normal(size=3000)), np.full(3000, 2.0)):
        p = rng.random(3000) < 1 / (1 + np.exp(-s))
        df = spark.createDataFrame(pd.DataFrame({"score": s, "positive": p})).repartition(9)
        assert students.auc(df).first()[0] == pytest.approx(brute_auc(s, p))
    assert students.auc(df.where("positive")).first()[0] is None and students.auc(df.where("false")).first()[0] is None
    odd = spark.createDataFrame([(None, True), (None, False), (float("-inf"), False), (1.0, True), (0.5, None)], "score double, positive boolean")
    low = np.array([-np.inf, -np.inf, -np.inf, 1.0, 0.5])
    assert students.auc(odd).first()[0] == pytest.approx(brute_auc(low, np.array([True, False, False, True, False])))


def test_many_edges_are_searched_once(spark):
    """Places among many edges are those of comparisons with each, and a row's bins are found once, not in a filter as well."""
    edges = [900.0 + 801 * i for i in range(130)] + [105000.0]
    values = [None, math.nan, math.inf, -math.inf, 0.0, 1e9, *edges, *(e - 1e-6 for e in edges), *(e + 1e-6 for e in edges)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (33, 64, 65, 131):
        cut = edges[:n]
        found = rows.select("v", binning.cell(F.col("v"), cut), binning.interval(F.col("v"), cut)).collect()
        for v, cell, interval in found:
            number = v is not None and not math.isnan(v)
            assert cell == (sum(v >= e for e in cut[1:-1]) if number else n - 2)
            assert interval == (sum(v > e for e in cut[1:-1]) if number and cut[0] <= v <= cut[-1] else -1)
    columns = [*WIDE.numerical, *WIDE.categorical, WIDE.target]
    table = spark.createDataFrame([(1.0, 900.0, 0.0, 0.0, 1.0, "A", "O")], ", ".join(f"{c} {'double' if c in WIDE.numerical else 'string'}" for c in columns))
    plan = counts.occupied(WIDE, WIDE.coerce(table), WIDE.conditional[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "(filter(" not in plan and plan.count("104229.0") == 1
