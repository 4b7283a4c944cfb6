"""Parts that other tests only pass through: saved models, sizes, levels, readings, warnings and what an audit says of itself."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from dpspark import domains, fixtures
from dpspark.catalogue import small_release, table_release
from dpspark.errors import BoundError
from dpspark.fixtures import F2, F5
from dpspark.ledger import PrivacyLedger
from dpspark.operators import quota, students
from dpspark.plans import bound, evaluate, release


def test_a_saved_model_predicts_alike(spark, sf_dir, tmp_path):
    data = students.labelled(F5, fixtures.f5(spark, sf_dir))
    model = students.pipeline(F5, students.students(0)["LR"]).fit(data)
    students.save(model, str(tmp_path / "model"))
    students.save(model, str(tmp_path / "model"))
    again = students.load(str(tmp_path / "model"))
    a, b = (students.predicted(m, data).select("o_totalprice", "o_orderpriority", "score").distinct() for m in (model, again))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_domain_sizes():
    assert domains.domain_size(F5) == 2 * 4 * 5 and domains.domain_size(F2) == 2 * 4 * 5 * 3 * 2
    assert [domains.level_size(F2, level) for level in F2.conditional] == [1, 3, 6]
    assert domains.cell_name(F2, (), 0) == domains.EVERY


def test_levels_are_picked():
    r = small_release()
    r.conditional_levels.append({"level": 3, "columns": ["o_orderpriority", "o_totalprice"], "cells": {"x": {"rate": 0.5, "support": 150}}})
    assert bound.pick_level(r, None)["level"] == 3 and bound.pick_level(r, 0)["level"] == 0
    with pytest.raises(BoundError, match="level 7"):
        bound.pick_level(r, 7)
    r.conditional_levels = []
    with pytest.raises(BoundError, match="no conditional level"):
        bound.pick_level(r, None)


def test_readings():
    real, low = {"mean": 0.8, "min": 0.75, "max": 0.85}, {"mean": 0.5, "min": 0.45, "max": 0.55}
    references = {"real": {"LR": real, "RF": real, "GBM": real, "X": real}, "permuted": {"LR": low, "RF": low, "GBM": low, "X": real}}
    found = evaluate.panel({"LR": 0.8, "RF": 0.9, "GBM": 0.6, "X": math.nan}, references)
    assert [found[m]["reading"] for m in ("LR", "RF", "GBM", "X")] == ["within", "better", "worse", "no reading"]
    assert found["LR"]["share"] == pytest.approx(1.0) and found["GBM"]["gap"] == pytest.approx(-0.2) and found["GBM"]["share"] == pytest.approx(1 / 3)
    assert found["X"]["share"] is None
    assert evaluate.spread([1.0, math.nan, 3.0]) == {"mean": 2.0, "min": 1.0, "max": 3.0}
    assert all(math.isnan(v) for v in evaluate.spread([math.nan]).values())


def test_shares_over_all_cohorts(spark, sf_dir):
    mixed = quota.mixture(F5, table_release(spark, sf_dir))
    n = fixtures.f5(spark, sf_dir).count()
    own = {r["o_orderpriority"]: r["count"] / n for r in fixtures.f5(spark, sf_dir).groupBy("o_orderpriority").count().collect()}
    assert {k: pytest.approx(v) for k, v in own.items()} == {k: v for k, v in mixed["o_orderpriority"].items() if v}
    assert all(sum(x.values()) == pytest.approx(1.0) for x in mixed.values())


def test_diagnostics():
    budget = release.Budget(0.1, 0.1, 0.4, 0.2)
    ledger = PrivacyLedger(1.0)
    level = lambda *rates, support=200: {"level": 1, "cells": {str(i): {"rate": r, "support": support} for i, r in enumerate(rates)}}
    said = release._diagnostics(F5, [level(0.30, 0.31)], budget, ledger)
    assert said[0] == "part of the budget was not spent" and "as large as the spread" in said[1]
    ledger.spend("all", "count", 0.99)
    assert release._diagnostics(F5, [level(0.1, 0.9)], budget, ledger) == []
    assert release._diagnostics(F5, [level(0.5)], budget, ledger) == []


def test_an_audit_says_what_it_is(spark, sf_dir):
    r = release.release_statistics(F5, fixtures.f5(spark, sf_dir), epsilon_total=6.0, seed=2, n_min=50)
    audit = r.audit
    assert audit["guarantee_void"] and "noise came from a seed: the guarantee is void" in audit["warnings"]
    assert audit["_what_this_is"] and audit["caveats"] and audit["epsilon_accounted"] <= audit["epsilon_budget"] == 6.0
    assert audit["groups"]["marginals"]["n_queries"] == sum(q["group"] == "marginals" for q in audit["queries"])
    again = release.Release.from_json(r.to_json())
    assert again == r
    found = {x["cohort"]: x["size"] for x in again.frames(spark)["release_cohort"].select("cohort", F.col("size")).collect()}
    assert found == {c["cohort_name"]: c["cohort_size"] for c in r.cohorts}
