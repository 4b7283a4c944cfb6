from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dpspark import domains, noise
from dpspark.errors import AccountingError, CorrectionError, DataValidationError, DomainTooLargeError, GenerationError, ReleaseError, SchemaError
from dpspark.fixtures import F5
from dpspark.functions import binning
from dpspark.ledger import PARALLEL, SEQUENTIAL, PrivacyLedger
from dpspark.operators import counts, parsing, quota, sampling
from dpspark.plans import bound, generate, hybrid, selection
from dpspark.plans.release import Release, release_statistics
from dpspark.schema import Band, PublicSchema

EDGES = [18, 30, 45, 60, 90]
VALUES = [17.0, 18.0, 29.9, 30.0, 60.0, 90.0, 91.0, float("nan")]
BINS = {
    "cell": [0, 0, 0, 1, 3, 3, 3, 3],
    "histogram": [-1, 0, 0, 1, 3, 3, -1, -1],
    "interval": [-1, 0, 0, 0, 2, 3, -1, -1],
    "pool": [0, 0, 0, 1, 3, 3, 3, 0],
    "band": [-1, 0, 0, 1, 3, 3, -1, -1],
}


def demo(**more) -> PublicSchema:
    parts = {"numerical": {"age": (18, 90)}, "categorical": {"edu": ["HS", "College", "Grad"], "result": ["None", "High"]}, "target": "y", "positive": "YES", "negative": "NO", "bins": {"age": EDGES}, "stratify": ["edu"], "conditional": [("edu",), ("edu", "result")]}
    return PublicSchema("demo", **(parts | more))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 3000
    edu = rng.choice(["HS", "College", "Grad"], n)
    df = pd.DataFrame({"id": np.arange(n), "age": rng.uniform(18, 90, n).round(1), "edu": edu, "result": rng.choice(["None", "High"], n), "y": np.where(rng.random(n) < np.where(edu == "Grad", 0.6, 0.2), "YES", "NO")})
    return spark.createDataFrame(df).cache()


@pytest.mark.parametrize("name", BINS)
def test_binning_matrix(spark, name):
    rows = spark.createDataFrame(list(enumerate(VALUES)), "i int, v double")
    found = rows.select("i", getattr(binning, name)(F.col("v"), EDGES).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in found] == BINS[name]


@pytest.mark.parametrize(
    "more",
    [
        {"target": "age"}, {"negative": "YES"}, {"numerical": {"age": (90, 18)}, "bins": {}}, {"categorical": {"edu": []}}, {"categorical": {"edu": ["a", "a"], "result": ["x"]}},
        {"bins": {"age": [18, 18, 90]}}, {"bins": {"age": [20, 90]}}, {"stratify": ["nothing"]}, {"stratify": ["age"], "bands": {"age": [Band("a", 18, 40), Band("b", 50, 90)]}},
        {"conditional": [("nothing",)]}, {"coarsen": {"edu": {"PhD": "g"}}}, {"coarsen": {"age": {"1": "g"}}},
    ],
)
def test_schema_refuses(more):
    with pytest.raises(SchemaError):
        demo(**more)


def test_schema_round_trip_and_domain():
    assert PublicSchema.from_json(demo().to_json()) == demo()
    assert domains.domain_size(demo()) == 4 * 3 * 2 * 2
    assert domains.cells(demo(), ()) == ["*"]
    assert "edu=Grad & result=None" in domains.cells(demo(), ("edu", "result"))


def test_coerce_and_validate(spark):
    rows = [("17", "HS", " None ", "YES"), ("x", "HS", "None", "NO"), (None, "HS", "None", "NO"), ("NaN", "HS", "None", "NO"), ("30", None, "High", "NO")]
    df = spark.createDataFrame(rows, "age string, edu string, result string, y string")
    out = demo().coerce(df).collect()
    assert sorted(r["age"] for r in out) == [18.0, 30.0]
    assert {r["result"] for r in out} == {"None", "High"} and any(r["edu"] not in demo().levels("edu") for r in out)
    with pytest.raises(DataValidationError, match="missing columns.*"):
        demo().validate(df.drop("edu"))
    with pytest.raises(DataValidationError):
        demo().validate(df.where("false"))
    assert demo().validate(df)["warnings"]


def test_empty_cohorts_are_counted(spark, table):
    few = table.where("edu <> 'Grad'")
    assert {r["cohort"]: r["n"] for r in counts.cohort_counts(demo(), few).collect()}["Grad"] == 0
    assert counts.level_counts(demo(), few).where("n = 0").count() > 0


def test_ledger_algebra():
    led = PrivacyLedger(1.0)
    assert led.spend("a", "count", 0.1, 1.0) == pytest.approx(10)
    for key in (("x",), ("y",)):
        led.spend("h", "histogram", 0.2, 1.0, PARALLEL, key, "m")
    led.spend("h", "histogram", 0.15, 1.0, PARALLEL, ("x", "1"), "m")
    assert led.total() == pytest.approx(0.45)
    with pytest.raises(AccountingError):
        led.spend("b", "count", 0.6, 1.0, SEQUENTIAL)
    assert led.total() == pytest.approx(0.45)
    led.seal()
    with pytest.raises(AccountingError):
        led.spend("c", "count", 0.01)
    assert next(iter(led.audit())) == "_what_this_is"
    for bad in ({"epsilon": 0}, {"epsilon": 1, "delta": 0.1}, {"epsilon": 1, "max_rows_per_person": 0}):
        with pytest.raises(AccountingError):
            PrivacyLedger(**bad)


def test_laplace():
    draws = [noise.Noise(3).laplace(2.0) for _ in range(3)]
    assert len(set(draws)) == 1 and noise.laplace(1.0, 0.0) == 0
    n = noise.Noise(5)
    many = np.array([n.laplace(2.0) for _ in range(20000)])
    assert abs(many.mean()) < 0.1 and abs(np.abs(many).mean() - 2) < 0.1
    whole = np.array([n.discrete_laplace(2.0) for _ in range(20000)])
    assert abs(whole.mean()) < 0.1 and set(whole % 1) == {0}


def test_release_closes_its_budget(spark, table):
    r = release_statistics(demo(), table, seed=4)
    assert r.audit["epsilon_accounted"] == pytest.approx(2.0, abs=1e-9)
    assert r.audit["guarantee_void"] and all(c["cohort_size"] >= 150 for c in r.cohorts)
    for c in r.cohorts:
        for block in (c, *c.get("by_class", {}).values()):
            assert sum(block["numerical"]["age"]["proportions"]) == pytest.approx(1, abs=1e-3)
    assert Release.from_json(r.to_json()) == r
    assert r.effective_schema(demo(stratify=[])).stratify == ["edu"]
    assert r.frames(spark)["release_cell"].count() == sum(len(x["cells"]) for x in r.conditional_levels)
    scales = {q["scale"] for q in r.audit["queries"]}
    assert len(scales) >= 4


def test_every_number_is_noised(table):
    found = [release_statistics(demo(), table, seed=s) for s in (1, 2, 3)]
    for pick in (lambda r: r.cohorts[0]["cohort_size"], lambda r: r.cohorts[0]["class_balance"]["YES"], lambda r: r.conditional_levels[0]["cells"]["edu=Grad"]["rate"]):
        assert len({pick(r) for r in found}) > 1


def test_release_refuses(table):
    for more in ({"n_min": 10}, {"conditional_fraction": 0}, {"epsilon_total": 0}):
        with pytest.raises(ReleaseError):
            release_statistics(demo(), table, **more)
    with pytest.raises(AccountingError):
        release_statistics(demo(), table, max_rows_per_person=40)
    with pytest.raises(ReleaseError):
        release_statistics(demo(), table.limit(60))


def test_autoconfig(table):
    r = release_statistics(demo(stratify=[], conditional=[]), table, epsilon_total=4.0, n_records=3000, seed=2)
    assert r.audit["derived"]["chosen"][0] == "edu"
    assert r.audit["epsilon_accounted"] <= 4.0 + 1e-9


def test_apportion_and_quotas():
    rng = random.Random(1)
    for n in (1, 7, 25):
        assert sum(quota.apportion([0.3, 0.3, 0.4], n, rng)) == n
    assert quota.apportion([0, 0], 3) == [2, 1]
    mean = sum(quota.positives(0.3, 1, random.Random(i).random()) for i in range(4000)) / 4000
    assert abs(mean - 0.3) < 0.03


def test_statistical_decoder_keeps_counts(spark, table):
    r = release_statistics(demo(), table, seed=4)
    rows = generate.statistical(spark, demo(), r, 300, seed=1).cache()
    assert rows.count() == 300 and rows.select("row_id").distinct().count() == 300
    sizes = {x["_cohort"]: x["count"] for x in rows.groupBy("_cohort").count().collect()}
    assert sizes == quota.allocate_rows(r, 300)
    assert rows.where("age < 18 OR age > 90").isEmpty()


def test_model_answers(spark, table):
    r = release_statistics(demo(), table, seed=4)

    def decoder(text: str) -> str:
        return "```csv\nage,edu,result,y\n" + "\n".join(f"{20 + i},Grad,None,{'YES' if i % 2 else 'NO'}" for i in range(25)) + "\nbad\n```"

    rows, stats = generate.generate(spark, demo(), r, 100, decoder)
    assert rows.count() == stats.rows_kept >= 100
    with pytest.raises(GenerationError):
        generate.generate(spark, demo(), r, 100, lambda text: "sorry")


def test_quoted_fields(spark):
    one = spark.createDataFrame([(1, 'x,"a ""b"", c"\nage,edu,result,y\n30,"HS",None,"NO"')], "response_id int, response string")
    (row,) = parsing.parsed(one, demo()).collect()
    assert (row["age"], row["edu"], row["y"]) == ("30", "HS", "NO")


def test_answers_of_every_kind(spark):
    """Fences, a bad line, a whole float, an empty cell first, in the middle and last, an unknown category, a number out of bounds, no table."""
    from dpspark.fixtures import F7

    more = [(4, "y,o_totalprice,o_orderpriority\n,2000,1-URGENT\nYES,,5-LOW\nNO,3000,\n,,")]
    answers = spark.createDataFrame([*F7, *more], "response_id int, response string")
    got = sorted(tuple(r) for r in parsing.parsed(answers, F5).drop("line").fillna("").collect())
    assert got == sorted([
        (1, "2000", "1-URGENT", "YES"), (1, "3000.5", "5-LOW", "NO"), (2, "900", "2-HIGH", "YES"), (2, "5000", "9-NONE", "NO"), (2, "7000", "3-MEDIUM", ""), (2, "x", "4-NOT SPECIFIED", "NO"), (2, "450000", "5-LOW", "NO"),
        (4, "2000", "1-URGENT", ""), (4, "", "5-LOW", "YES"), (4, "3000", "", "NO"), (4, "", "", ""),
    ])
    reasons = sorted(r["reason"] or "" for r in parsing.validated(parsing.parsed(answers, F5), F5).collect())
    assert reasons == sorted(["", "", "bounds", "category", "label", "number", "", "label", "number", "category", "label"])


def test_rake_is_the_sequential_rule():
    """Batched by family and compressed to tuples, against one constraint after the other over rows."""
    from dpspark.catalogue import small_release

    rng = np.random.default_rng(0)
    n = 2000
    rows = pd.DataFrame({"_cohort": rng.choice(["small", "large", "other"], n), "_pos": rng.random(n) < 0.5, "_b_o_totalprice": rng.integers(0, 4, n), "_b_o_orderpriority": rng.integers(-1, 5, n)})
    by = list(rows.columns)
    t = rows.groupby(by).size().rename("_n").reset_index()
    found = selection.families(F5, small_release(), t, 300)
    size = t["_n"].to_numpy(float)
    start = np.where(found[0].of >= 0, 300 / n, 0.0)
    fast = selection.rake(start, size, found, 300)
    w = rows.merge(t.assign(_i=np.arange(len(t))), on=by)["_i"].to_numpy()
    slow = start[w]
    for _ in range(selection.ROUNDS):
        for f in found:
            for k, target in enumerate(f.target):
                mask = f.of[w] == k
                if not np.isnan(target) and slow[mask].sum() > 0:
                    slow[mask] *= target / slow[mask].sum()
        slow = np.clip(slow, 0, 1)
        slow = np.clip(slow * 300 / slow.sum(), 0, 1)
    assert np.abs(fast[w] - slow).max() < 1e-9
    assert (fast[t["_b_o_orderpriority"].to_numpy() == -1] == 0).all() and (fast[t["_cohort"].to_numpy() == "other"] == 0).all()


def test_selection_halves_the_gap(spark, table):
    r = release_statistics(demo(), table, epsilon_total=20.0, seed=4)
    pool = table.withColumn("age", F.least(F.col("age") * 1.25, F.lit(90.0)))
    taken = selection.select_to_release(demo(), r, pool, 300, "id", seed=3).cache()
    assert 285 <= taken.count() <= 300 and taken.select("id").distinct().count() == taken.count()
    gap = [selection.marginal_gap(demo(), demo().coerce(d), demo().coerce(table)) for d in (pool, taken)]
    assert gap[1] < gap[0] / 2
    with pytest.raises(GenerationError):
        selection.select_to_release(demo(), r, pool.limit(50), 300, "id")


def test_bound_with_controls(spark, table):
    first, second = sampling.split(table, "id", 0.6, 1)
    r = release_statistics(demo(), first, epsilon_total=8.0, n_min=50, seed=4)
    report = bound.bound_with_controls(demo(), r, first, second, second, "id", epsilon=4.0, level=0, noise=noise.Noise(2))
    assert report.verdict in ("within bound", None) and report.ceiling.worst < report.floor.worst
    half = bound.halfwidth(50, 4.0, 3, 0.05)
    assert half == pytest.approx(math.log(60) / 200)
    assert all(q["scale"] == pytest.approx(1 / 50 / 4) for q in report.accounting["queries"])
    assert report.to_json().startswith('{\n "_what_this_is"')
    with pytest.raises(bound.BoundError):
        bound.bound_with_controls(demo(), r, first, second, second.where("false"), "id")


def test_correction(spark, table):
    flat = table.withColumn("y", F.when(F.col("id") % 2 == 0, "YES").otherwise("NO"))
    out, released, gain = hybrid.correct(demo(), table, flat, ("edu",), 8.0, "id", seed=1)
    assert gain["worth_it"] and gain["error_after"] < 0.01 and gain["feature_shift"] == 0
    same = out.drop("y").exceptAll(flat.drop("y")).count()
    assert same == 0 and released.audit["epsilon_accounted"] == pytest.approx(8.0)
    with pytest.raises(CorrectionError):
        hybrid.release_conditional_table(demo(), table.limit(90), ("edu", "result"), 1.0)
    wide = PublicSchema("wide", {f"n{i}": (0, 1) for i in range(18)}, {}, "y", "1", "0")
    with pytest.raises(DomainTooLargeError):
        hybrid.check_feasible(wide, 100)


def test_permutation_keeps_values(table):
    out = sampling.permuted(table, "id", "y", 3)
    assert out.groupBy("y").count().exceptAll(table.groupBy("y").count()).isEmpty()
    assert out.join(table.select("id", F.col("y").alias("old")), "id").where("y <> old").count() > 100
