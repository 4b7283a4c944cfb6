"""``python -m dpspark release|generate|bound|evaluate|correct|run``: the stages over tables in files."""

from __future__ import annotations

import argparse
import importlib
import json
import runpy
import sys
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpspark import report
from dpspark.errors import GenerationError
from dpspark.models import ModelTable
from dpspark.operators import sampling
from dpspark.plans.bound import bound_with_controls
from dpspark.plans.evaluate import evaluate
from dpspark.plans.generate import POOL_FACTOR, ROWS_PER_CALL, Answer, GenerationStats, Service, generate, generate_by_cell, generate_selected
from dpspark.plans.hybrid import correct
from dpspark.plans.release import Release, release_statistics
from dpspark.plans.selection import SUB_BINS
from dpspark.schema import PublicSchema
from dpspark.sources.tables import read_table, write_table

KEY = "_row"


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="dpspark", description=__doc__)
    p.add_argument("stage", choices=("release", "generate", "bound", "evaluate", "correct", "run"))
    p.add_argument("--schema", required=True, help="JSON, or a Python file with SCHEMA")
    p.add_argument("--private", help="the private table")
    p.add_argument("--holdout", help="real rows that the release did not see; without it a fifth of the private table")
    p.add_argument("--synthetic", help="a generated table")
    p.add_argument("--release", dest="release_path", help="a release to use instead of a new one")
    p.add_argument("--out", required=True)
    p.add_argument("--rows", type=int, default=1000)
    p.add_argument("--columns", default="", help="of the conditional table, by commas")
    p.add_argument("--epsilon", type=float, default=2.0)
    p.add_argument("--epsilon-bound", type=float, default=0.5)
    p.add_argument("--conditional-fraction", type=float, default=0.2)
    p.add_argument("--n-min", type=int, default=150)
    p.add_argument("--n-records", type=int, default=1000)
    p.add_argument("--seed", type=int, help="for tests: voids the guarantee")
    p.add_argument("--max-rows-per-person", type=int)
    p.add_argument("--acknowledge-vacuous-privacy-unit", action="store_true")
    p.add_argument("--no-autoconfig", action="store_true")
    p.add_argument("--no-class-conditional", action="store_true")
    p.add_argument("--exact-gate", action="store_true", help="gate on exact counts, uncharged")
    p.add_argument("--level", type=int)
    p.add_argument("--decoder", help="module:function or file.py:function that turns a prompt into CSV text or an Answer; without it rows are statistical")
    p.add_argument("--how", choices=("selected", "cohort", "cell"), default="selected", help="choose from a pool, or take the rows of cohorts or of cells as they come")
    p.add_argument("--pool-factor", type=int, default=POOL_FACTOR)
    p.add_argument("--sub-bin", choices=SUB_BINS, default="release")
    p.add_argument("--allow-low-coverage", action="store_true")
    p.add_argument("--rows-per-call", type=int, default=ROWS_PER_CALL)
    p.add_argument("--model", default="", help="of the decoder, as the table of models names it")
    p.add_argument("--models", help="JSON: prefix of a name to [tier, dollars a million tokens in, out]")
    p.add_argument("--allow", default="VALIDATED,ADEQUATE", help="tiers that may be asked")
    p.add_argument("--budget-usd", type=float)
    p.add_argument("--context", type=int)
    p.add_argument("--output-tokens", type=int, default=4096)
    p.add_argument("--reasoning", action="store_true", help="answers should report reasoning")
    p.add_argument("--preserve-ranking", action="store_true", help="relabel in the order of cross-validated scores")
    p.add_argument("--reference-draws", type=int, default=5)
    p.add_argument("--students", default="LR,RF,GBM")
    return p.parse_args(argv)


def _keyed(df: DataFrame) -> DataFrame:
    """With a key by content: rows that are all alike share it, and are told apart by nothing."""
    return df.withColumn(KEY, F.xxhash64(*df.columns))


def decoder_of(name: str) -> Callable[[str], str | Answer]:
    """The function behind ``module:function`` or ``file.py:function``."""
    place, _, function = name.rpartition(":")
    if not place or not function:
        raise GenerationError("a decoder is named module:function or file.py:function")
    try:
        found = runpy.run_path(place).get(function) if place.endswith(".py") else getattr(importlib.import_module(place), function, None)
    except (ImportError, OSError) as e:
        raise GenerationError(f"the decoder can't be loaded: {e}") from None
    if not callable(found):
        raise GenerationError(f"{place} has no function {function}")
    return found


def service_of(a: argparse.Namespace) -> Service:
    """The model behind the decoder, and what may be spent on it."""
    table = None
    if a.models:
        table = ModelTable()
        for prefix, (tier, *usd) in json.loads(Path(a.models).read_text(encoding="utf-8")).items():
            table.register(prefix, tier, *usd)
    if a.budget_usd is not None and table is None:
        raise GenerationError("a budget needs the prices of --models")
    return Service(a.model, table, tuple(a.allow.split(",")), a.context, a.output_tokens, a.budget_usd, a.reasoning)


def generated(a: argparse.Namespace, spark: SparkSession, schema: PublicSchema, release: Release) -> tuple[DataFrame, GenerationStats]:
    decoder, service, seed = decoder_of(a.decoder) if a.decoder else None, service_of(a), a.seed or 0
    if a.how == "selected":
        return generate_selected(spark, schema, release, a.rows, decoder, a.pool_factor, seed, a.sub_bin, service)
    if decoder is None:
        raise GenerationError(f"rows by {a.how} are a model's: name a --decoder")
    if a.how == "cell":
        return generate_by_cell(spark, schema, release, a.rows, decoder, a.level or 0, a.allow_low_coverage, a.rows_per_call, seed, service)
    return generate(spark, schema, release, a.rows, decoder, a.rows_per_call, seed, service)


def work(a: argparse.Namespace, spark: SparkSession) -> None:
    schema, out = PublicSchema.load(a.schema), Path(a.out)
    out.mkdir(parents=True, exist_ok=True)
    stages = ("release", "generate", "bound", "evaluate") if a.stage == "run" else (a.stage,)
    table = lambda path: _keyed(read_table(spark, path, schema.columns))
    private = table(a.private) if a.private else None
    holdout = table(a.holdout) if a.holdout else None
    if private is not None and holdout is None and stages != ("correct",):
        private, holdout = sampling.stratified_split(private, KEY, 0.8, F.col(schema.target), 0)
    release = Release.from_json(Path(a.release_path)) if a.release_path else None
    if release is not None:
        release.belongs_to(schema)
    synthetic = table(a.synthetic) if a.synthetic else None
    if "release" in stages and release is None:
        release = release_statistics(schema, private, a.epsilon, a.conditional_fraction, a.n_min, not a.exact_gate, a.seed, a.max_rows_per_person, a.acknowledge_vacuous_privacy_unit, not a.no_autoconfig, a.n_records, not a.no_class_conditional)
        release.to_json(out / "release.json")
        report.of_release(release).write(out)
    if "generate" in stages:
        rows, stats = generated(a, spark, schema, release)
        (out / "generation.json").write_text(json.dumps(asdict(stats), indent=1), encoding="utf-8")
        write_table(rows.select(*schema.columns), str(out / "synthetic.csv"))
        synthetic = table(str(out / "synthetic.csv"))
    if "bound" in stages and release.conditional_levels:
        found = bound_with_controls(schema, release, private, holdout, synthetic, KEY, a.epsilon_bound, level=a.level, max_rows_per_person=a.max_rows_per_person)
        found.to_json(out / "bound_report.json")
        report.of_bound(found).write(out)
    if "evaluate" in stages:
        result = evaluate(schema, {"synthetic": synthetic}, private, holdout, KEY, reference_draws=a.reference_draws, only=tuple(a.students.split(",")))
        report.of_evaluation(result).write(out)
    if "correct" in stages:
        done, released, gain = correct(schema, private, synthetic, tuple(a.columns.split(",")), a.epsilon, KEY, a.n_min, a.seed, a.max_rows_per_person, a.acknowledge_vacuous_privacy_unit, a.preserve_ranking)
        write_table(done.select(*schema.columns), str(out / "corrected.csv"))
        report.of_correction(released, gain).write(out)


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("dpspark").getOrCreate()
    return report.guard(lambda: work(a, spark))


if __name__ == "__main__":
    sys.exit(main())
