"""Cross-validated scores, and all reference draws together against one at a time."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from dpspark import fixtures
from dpspark.fixtures import F5
from dpspark.operators import counts, sampling, students
from dpspark.plans import evaluate
from dpspark.plans.selection import marginal_gap


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    return fixtures.f5(spark, sf_dir).select("o_orderkey", *F5.columns)


def test_folds_are_even_in_every_stratum(orders):
    out = students.folds(orders, "o_orderkey", "y", 5, 3)
    size = {(r["y"], r["_fold"]): r["count"] for r in out.groupBy("y", "_fold").count().collect()}
    assert out.count() == orders.count() and len(size) == 10
    for y in ("YES", "NO"):
        own = [n for (v, _), n in size.items() if v == y]
        assert max(own) - min(own) <= 1
    again = students.folds(orders.repartition(7), "o_orderkey", "y", 5, 3)
    assert out.exceptAll(again.select(out.columns)).isEmpty()


def test_no_row_is_scored_by_a_model_that_saw_it(spark, orders, monkeypatch):
    """One fit for each fold; what only one fold shows is not known to the model that scores that fold."""
    fits = []
    real = students.pipeline

    def watched(schema, student):
        made = real(schema, student)
        fit = made.fit
        made.fit = lambda df: fits.append({r["_fold"] for r in df.select("_fold").distinct().collect()}) or fit(df)
        return made

    monkeypatch.setattr(students, "pipeline", watched)
    # the target is plain in fold 2 only: urgent orders are positive there, and nowhere else does anything tell it
    dealt = students.folds(orders.withColumn("_y", F5.is_positive().cast("double")), "o_orderkey", "_y", 4, 1)
    signal = F.when(F.col("_fold") == 2, F.when(F.col("y") == "YES", "1-URGENT").otherwise("5-LOW")).otherwise("3-MEDIUM")
    df = dealt.withColumns({"o_orderpriority": signal, "o_totalprice": F.lit(5000.0)}).select("o_orderkey", *F5.columns)
    found = students.out_of_fold(F5, df, "o_orderkey", 1, 4, "LR")
    assert fits == [{1, 2, 3}, {0, 2, 3}, {0, 1, 3}, {0, 1, 2}]
    assert found.count() == df.count() and found.select("o_orderkey").distinct().count() == df.count()
    own = found.join(dealt.where("_fold = 2").select("o_orderkey"), "o_orderkey")
    quality = students.auc(own.select(F.col("_score").alias("score"), (F.col("_y") == 1).alias("positive"))).first()[0]
    assert quality == 0.5
    # a model of all rows would know it
    model = real(F5, students.students(1)["LR"]).fit(students.labelled(F5, df))
    seen = students.predicted(model, students.labelled(F5, df.join(own.select("o_orderkey"), "o_orderkey")))
    assert students.auc(seen.select("score", (F.col("_y") == 1).alias("positive"))).first()[0] > 0.9


def test_scores_that_tell_nothing_are_none(spark, orders):
    flat = orders.limit(200).withColumns({"o_orderpriority": F.lit("5-LOW"), "o_totalprice": F.lit(5000.0)})
    assert students.ranking_scores(F5, flat.where("y = 'YES'"), "o_orderkey", 1) is None
    few = flat.where("y = 'YES'").limit(2).unionByName(flat.where("y = 'NO'"))
    assert students.ranking_scores(F5, few, "o_orderkey", 1) is None


def test_samples_of_many_seeds(spark, monkeypatch):
    df = spark.range(3000).withColumn("key", F.col("id") % 900)
    for rows in (50_000, 1):
        monkeypatch.setattr(sampling, "GROUP_ROWS", rows)
        for n in (1, 250, 3000, 9000):
            both = sampling.samples(df, "key", n, [4, 9, 11])
            for s in (4, 9, 11):
                own = sorted(r["key"] for r in both.where(F.col(sampling.DRAW) == s).collect())
                assert own == sorted(r["key"] for r in df.orderBy(sampling.uniform(F.col("key"), s), "key").limit(n).collect())
    assert sampling.samples(df, "key", 0, [1]).isEmpty() and sampling.samples(df, "key", 5, []).isEmpty()
    assert sampling.samples(df, "key", 5, [1]).columns == [sampling.DRAW, "id", "key"]


def test_draws_together_are_the_single_ones(orders):
    train, holdout = orders.where("o_orderkey % 3 <> 0"), F5.coerce(orders.where("o_orderkey % 3 = 0"))
    drawn = sampling.samples(train, "o_orderkey", 300, [7, 8])
    mixed = sampling.permuted(drawn, "o_orderkey", "y", 0, sampling.DRAW)
    for data, permute in ((drawn, False), (mixed, True)):
        gaps = evaluate.draw_gaps(F5, data, holdout)
        for s in (7, 8):
            one = sampling.simple_sample(train, "o_orderkey", 300, s)
            one = sampling.permuted(one, "o_orderkey", "y", s) if permute else one
            assert gaps[s] == pytest.approx(marginal_gap(F5, F5.coerce(one), holdout))
            own = data.where(F.col(sampling.DRAW) == s).drop(sampling.DRAW)
            assert own.exceptAll(one.select(own.columns)).isEmpty() and own.count() == 300


def test_gaps_where_tables_lack_a_column(spark, orders):
    some = F5.coerce(orders.limit(50).withColumn("d", F.lit(1)), ["d"])
    none = F5.coerce(orders.where("false"))
    for q in (none, F5.coerce(orders.limit(20))):
        apart = {r["col"]: r["tv"] for r in counts.marginal_tv(F5, some.drop("d"), q).collect()}
        assert {r["col"]: pytest.approx(r["tv"]) for r in counts.marginal_tv(F5, some, q, ["d"]).collect()} == apart


def test_evaluate_reads_its_draws(orders):
    found = evaluate.evaluate(F5, {"half": orders.where("o_orderkey % 2 = 0")}, orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 3 = 0"), "o_orderkey", 200, reference_draws=2, only=("LR",))
    real, low = found["references"]["real"], found["references"]["permuted"]
    assert real["LR"]["mean"] > low["LR"]["mean"] and real["tv"]["min"] <= real["tv"]["mean"] <= real["tv"]["max"]
    assert not math.isnan(found["panel"]["half"]["LR"]["share"])
