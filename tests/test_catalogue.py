from __future__ import annotations

import pytest

from dpspark import catalogue
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf_dir, duck, name):
    assert same(catalogue.queries()[name](spark, sf_dir).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df())


def test_only_a_fitted_student_has_no_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"tstr_lr"}


def test_student(spark, sf_dir):
    """Its AUC is held against ranks by hand, and beats a guess."""
    from dpspark import fixtures
    from dpspark.fixtures import F5
    from dpspark.operators import sampling, students

    (row,) = catalogue.queries()["tstr_lr"](spark, sf_dir).collect()
    train, test = sampling.split(fixtures.f5(spark, sf_dir), "o_orderkey", 0.8, 1)
    model = students.pipeline(F5, students.students(0)["LR"]).fit(students.labelled(F5, train))
    found = students.predicted(model, students.labelled(F5, test)).select("score", "_y").toPandas()
    rank, p = found["score"].rank(), found["_y"] == 1
    assert row["auc"] == pytest.approx((rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())) and row["auc"] > 0.6


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 56
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
