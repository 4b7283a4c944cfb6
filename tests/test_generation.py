"""The generation loop over decoders of known behaviour, ranks within groups, and whose release is whose."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dpspark.errors import ContextTruncationError, FatalAPIError, GenerationError, ModelCapabilityError, ReleaseError
from dpspark.models import INSUFFICIENT, VALIDATED, ModelTable
from dpspark.operators import quota, sampling
from dpspark.plans.generate import Answer, Service, generate, generate_by_cell, generate_selected
from dpspark.plans.release import release_statistics
from tests.test_engine import demo, table  # noqa: F401


def numbers(text: str) -> tuple[int, int]:
    """Rows asked for and positives among them."""
    size = int(re.search(r"Write (\d+) rows", text)[1])
    found = re.search(r"(?:outcome: .*?YES x (\d+))|(?:exactly (\d+) x YES)", text)
    return size, int(found[1] or found[2])


def csv(size: int, positives: int) -> str:
    return "age,edu,result,y\n" + "\n".join(f"{20 + i % 60},Grad,None,{'YES' if i < positives else 'NO'}" for i in range(size))


def obedient(text: str) -> str:
    return csv(*numbers(text))


def half(text: str) -> str:
    size, positives = numbers(text)
    return csv(-(-size // 2), -(-positives // 2))


@pytest.fixture(scope="module")
def release(spark, table):  # noqa: F811
    return release_statistics(demo(), table, seed=4)


def test_counts_are_owed_until_they_are_met(spark, release):
    for decoder in (obedient, half):
        rows, stats = generate(spark, demo(), release, 120, decoder, rows_per_call=10, seed=1)
        assert rows.count() == stats.rows_kept == 120 and rows.select("row_id").distinct().count() == 120
        sizes = {r["_cohort"]: r["count"] for r in rows.groupBy("_cohort").count().collect()}
        assert sizes == {k: v for k, v in quota.allocate_rows(release, 120).items() if v}
        have = {r["_cohort"]: r["p"] for r in rows.groupBy("_cohort").agg(F.count_if(F.col("y") == "YES").alias("p")).collect()}
        for c in release.cohorts:
            if n := sizes.get(c["cohort_name"]):
                # every batch rounds what is owed
                assert abs(have[c["cohort_name"]] - c["class_balance"]["YES"] * n) <= (1 if decoder is obedient else 3)
        assert (stats.rows_asked == 120) == (decoder is obedient)


def test_what_ends_a_run(spark, release):
    def broken(text: str) -> str:
        raise FatalAPIError("no credit")

    def flaky(text: str) -> str:
        raise OSError("reset")

    with pytest.raises(FatalAPIError, match="no credit"):
        generate(spark, demo(), release, 100, broken)
    with pytest.raises(GenerationError, match="0 of 2 calls"):
        generate(spark, demo(), release, 100, flaky)
    with pytest.raises(ContextTruncationError):
        generate(spark, demo(), release, 100, obedient, service=Service(context=4000))
    models = ModelTable()
    models.register("weak", INSUFFICIENT)
    models.register("good", VALIDATED, 1000.0, 1000.0)
    for name in ("weak-1", "unheard-of"):
        with pytest.raises(ModelCapabilityError):
            generate(spark, demo(), release, 100, obedient, service=Service(name, models))


def test_a_budget_keeps_what_it_paid_for(spark, release):
    models = ModelTable()
    models.register("good", VALIDATED, 0.0, 10_000.0)

    def priced(text: str) -> Answer:
        return Answer(obedient(text), 1, 100, 0)  # a dollar a call

    service = Service("good-1", models, output_tokens=100, budget_usd=6.5, reasoning=True)
    rows, stats = generate(spark, demo(), release, 200, priced, rows_per_call=10, service=service)
    assert stats.budget_capped and stats.calls in (6, 7) and rows.count() == stats.rows_kept < 200
    assert stats.without_reasoning == stats.calls and len(stats.warnings) == 2
    rows, stats = generate_selected(spark, demo(), release, 180, priced, service=service)
    assert rows.count() == stats.rows_kept < 180


def test_rows_by_cell(spark, release):
    rows, stats = generate_by_cell(spark, demo(), release, 200, obedient, allow_low_coverage=True)
    assert rows.count() == 200 and stats.positives_made == stats.positives_asked and not stats.positives_missed
    cells = release.conditional_levels[0]["cells"]
    want = dict(zip(cells, quota.apportion([c["support"] for c in cells.values()], 200), strict=True))
    assert {r["_cell"]: r["count"] for r in rows.groupBy("_cell").count().collect()} == {k: v for k, v in want.items() if v}
    _, stats = generate_by_cell(spark, demo(), release, 200, lambda text: csv(numbers(text)[0], 0), allow_low_coverage=True)
    assert stats.positives_made == 0 and stats.positives_missed and stats.warnings


def test_a_pool_to_choose_from(spark, release):
    rows, _ = generate_selected(spark, demo(), release, 60, seed=3)
    assert rows.count() == 60
    for bad in ({"pool_factor": 0}, {"sub_bin": "other"}):
        with pytest.raises(GenerationError):
            generate_selected(spark, demo(), release, 60, **bad)


def test_a_release_belongs_to_its_schema(spark, release):
    release.belongs_to(demo())
    for other in (replace(demo(), name="another"), replace(demo(), positive=demo().negative, negative=demo().positive)):
        with pytest.raises(ReleaseError):
            generate(spark, other, release, 10, obedient)
    replace(release, schema_digest="").belongs_to(demo())


@pytest.mark.parametrize("groups", [1, 7, None])
def test_ranks_within_groups(spark, groups):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101 / 100.0).alias("u"))
    rows = sampling.numbered(df, F.col("u"), "rank", ["g"], ["id"], groups, total="n").toPandas()
    assert len(rows) == 500
    for _, part in rows.groupby("g", dropna=False):
        assert list(part.sort_values(["u", "id"])["rank"]) == list(range(1, len(part) + 1)) and set(part["n"]) == {len(part)}


def test_a_stratified_part_is_exact(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 100, "a").when(F.col("id") < 999, "b").alias("y"))
    first, rest = sampling.stratified_split(df, "id", 0.8, F.col("y"), 1)
    assert {r["y"]: r["count"] for r in first.groupBy("y").count().collect()} == {"a": 80, "b": 719, None: 1}
    assert first.join(rest, "id").isEmpty() and rest.count() == 200


def test_a_round_ends_while_it_runs(spark, tmp_path):
    """A decoder that turns bad at call 100 of a round of 1,000 is not asked 150 times, and what was paid for is there."""
    import os
    import time

    from dpspark.plans.generate import answered, usable

    log = str(tmp_path / "calls")

    def decoder(text: str) -> str:
        with open(log, "a") as f:
            f.write("x")
        time.sleep(0.02)
        return csv(2, 1) if int(text) < 100 else "I would rather not"

    calls = spark.createDataFrame([(i, "all", str(i)) for i in range(1000)], "response_id long, _group string, prompt string")
    answers, ended = answered(calls, decoder, usable(demo()))
    got = {r["response_id"] for r in answers.collect()}
    assert ended and 100 < os.path.getsize(log) < 150 and set(range(100)) <= got and len(got) <= os.path.getsize(log)
    # a good decoder is asked all of them
    answers, ended = answered(calls.where("response_id < 64"), lambda text: csv(2, 1), usable(demo()))
    assert not ended and answers.count() == 64


def test_usable_answers():
    from dpspark.plans.generate import usable

    look = usable(demo())
    assert look(csv(1, 1)) and look("Here:\n```csv\nage,edu,result,y\n\"30\",Grad,None, NO \n```")
    assert not any(map(look, ["", "sorry", "age,edu,result,y", "age,edu,result,y\n30,Grad,None,MAYBE", "30,Grad,None,YES", "age,edu,result,y\n30,Grad,YES"]))


def test_errors_name_what_was_paid_for(spark, release):
    def refuses(text: str) -> str:
        raise FatalAPIError("no credit")

    with pytest.raises(FatalAPIError) as e:
        generate(spark, demo(), release, 200, refuses, rows_per_call=10)
    assert len(e.value.paid) == 1 and e.value.paid[0] in str(e.value)
    made = spark.read.parquet(e.value.paid[0])
    assert made.columns[:2] == ["row_id", "response_id"] and made.isEmpty()
    # rows of the rounds before an end that comes later
    with pytest.raises(GenerationError) as e:
        generate(spark, demo(), release, 400, lambda text: csv(10, 5) if "YES x 5" in text else "sorry", rows_per_call=10)
    assert e.value.paid and all(p in str(e.value) for p in e.value.paid)
