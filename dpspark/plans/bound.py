"""How far a table's conditional rates are from the private ones, against one noisy draw."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpspark import domains
from dpspark.errors import BoundError
from dpspark.ledger import PARALLEL, VACUOUS, WHAT_THIS_IS, PrivacyLedger
from dpspark.noise import Noise
from dpspark.operators import counts, sampling
from dpspark.plans.release import Release
from dpspark.schema import PublicSchema
from dpspark.sources.tables import kept

THIN = 20
LABEL = "stage_c_transmission_bound"


@dataclass
class CellBound:
    cell: str
    support: int
    p_hat: float
    rate: float | None
    halfwidth: float
    bound: float
    rows: int


@dataclass
class BoundResult:
    condition: str
    level: int
    columns: list[str]
    cells: list[CellBound]

    @property
    def worst(self) -> float:
        return max(c.bound for c in self.cells)

    @property
    def mean(self) -> float:
        return sum(c.bound for c in self.cells) / len(self.cells)

    @property
    def thin(self) -> int:
        return sum(0 < c.rows < THIN for c in self.cells)

    def rollup(self) -> dict:
        covered = sum(c.rows > 0 for c in self.cells)
        return {"n_cells": len(self.cells), "n_cells_covered": covered, "n_cells_uncovered": len(self.cells) - covered, "n_cells_thin": self.thin, "worst_case_bound": self.worst, "mean_bound": self.mean}


@dataclass
class BoundReport:
    synthetic: BoundResult
    ceiling: BoundResult
    floor: BoundResult
    tolerance: float
    verdict: str | None
    reason: str
    claim: dict
    accounting: dict

    def to_json(self, path: str | Path | None = None) -> str:
        body = {"_what_this_is": WHAT_THIS_IS} | asdict(self)
        for k in ("synthetic", "ceiling", "floor"):
            body[k] |= getattr(self, k).rollup()
        text = json.dumps(body, indent=1)
        if path:
            Path(path).write_text(text, encoding="utf-8")
        return text


def pick_level(release: Release, level: int | None) -> dict:
    if not release.conditional_levels:
        raise BoundError("the release has no conditional level")
    if level is None:
        return max(release.conditional_levels, key=lambda x: (len(x["columns"]), x["level"]))
    found = [x for x in release.conditional_levels if x["level"] == level]
    if not found:
        raise BoundError(f"level {level} was not released")
    return found[0]


def halfwidth(n_min: int, epsilon: float, cells: int, alpha: float) -> float:
    """Of all cells at once, with probability 1 - alpha."""
    return 1.0 / n_min / epsilon * math.log(cells / alpha)


def tolerance(release: Release, level: dict, positive: str, half: float) -> float:
    """The half-width and half of what tells the cells apart."""
    total = sum(c["cohort_size"] for c in release.cohorts)
    base = sum(c["cohort_size"] * c["class_balance"][positive] for c in release.cohorts) / total
    return half + 0.5 * max(abs(c["rate"] - base) for c in level["cells"].values())


def scored(rates: DataFrame, p_hat: DataFrame, half: float) -> DataFrame:
    """(cell, p_hat, rate, n, bound) of rates (cell, n, rate) against noisy private ones (cell, p_hat); without rows the bound is 1."""
    rate = F.when(F.col("n") > 0, F.col("rate"))
    met = p_hat.join(rates, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return met.select("cell", "p_hat", rate.alias("rate"), "n", F.when(F.col("n") > 0, F.abs(F.col("p_hat") - rate) + half).otherwise(F.lit(1.0)).alias("bound"))


CONDITION = "condition"


def conditions(schema: PublicSchema, tables: dict[str, DataFrame], columns: tuple[str, ...], cells: DataFrame) -> DataFrame:
    """(condition, cell, n, rate) of several tables in one aggregate over their tagged union; only of ``cells`` (cell)."""
    tagged = [schema.coerce(d.withColumn(CONDITION, F.lit(k)), [CONDITION]) for k, d in tables.items()]
    return counts.rates_of(schema, reduce(DataFrame.unionByName, tagged), columns, cells, [CONDITION])


def _rates(schema: PublicSchema, tables: dict[str, DataFrame], level: dict) -> dict[str, dict[str, tuple[int, float]]]:
    spark = next(iter(tables.values())).sparkSession
    asked = domains.frame(spark, [(c,) for c in level["cells"]], "cell string")
    out: dict = {k: {} for k in tables}
    for r in conditions(schema, tables, tuple(level["columns"]), asked).collect():
        out[r[CONDITION]][r["cell"]] = r["n"], r["rate"]
    return out


def _result(condition: str, level: dict, p_hat: dict[str, float], found: dict, half: float) -> BoundResult:
    cells = []
    for cell, p in p_hat.items():
        n, rate = found.get(cell, (0, None))
        cells.append(CellBound(cell, level["cells"][cell]["support"], p, rate if n else None, half, abs(p - rate) + half if n else 1.0, n))
    return BoundResult(condition, level["level"], level["columns"], cells)


def _private(schema: PublicSchema, release: Release, private: DataFrame, level: dict, epsilon: float, ledger: PrivacyLedger, noise: Noise) -> dict[str, float]:
    """The noisy private rate of every released cell: one draw each, over max(rows, n_min), so one row moves it by 1 / n_min at most."""
    found = _rates(schema, {"private": private}, level)["private"]
    scale = ledger.spend_all([(f"stage_c_rate[{c}]", (c,)) for c in level["cells"]], "rate", epsilon, 1.0 / release.n_min, PARALLEL, LABEL)
    out = {}
    for cell in level["cells"]:
        n, rate = found.get(cell, (0, None))
        true = (rate or 0.0) * n / max(n, release.n_min)
        out[cell] = min(1.0, max(0.0, true + noise.laplace(scale)))
    return out


def _ready(schema: PublicSchema, release: Release, level: int | None, epsilon: float, alpha: float) -> tuple[PublicSchema, dict]:
    if epsilon <= 0 or not 0 < alpha < 1:
        raise BoundError("epsilon has to be positive and alpha between 0 and 1")
    chosen = pick_level(release, level)
    if not chosen["cells"]:
        raise BoundError("the chosen level has no cell")
    return release.effective_schema(schema), chosen


def transmission_bound(schema: PublicSchema, release: Release, private: DataFrame, synthetic: DataFrame, epsilon: float = 0.5, alpha: float = 0.05, level: int | None = None, ledger: PrivacyLedger | None = None, noise: Noise | None = None) -> BoundResult:
    effective, chosen = _ready(schema, release, level, epsilon, alpha)
    p_hat = _private(effective, release, private, chosen, epsilon, ledger or PrivacyLedger(epsilon), noise or Noise())
    return _result("synthetic", chosen, p_hat, _rates(effective, {"synthetic": synthetic}, chosen)["synthetic"], halfwidth(release.n_min, epsilon, len(p_hat), alpha))


def bound_with_controls(schema: PublicSchema, release: Release, private: DataFrame, holdout: DataFrame, synthetic: DataFrame, key: str, epsilon: float = 0.5, alpha: float = 0.05, tolerance_: float | str = "auto", level: int | None = None, max_rows_per_person: int | None = None, seed: int = 0, noise: Noise | None = None) -> BoundReport:
    """The synthetic table, a real sample of its size (ceiling) and that sample with permuted targets (floor), against one draw.

    All that can be refused without the private table is refused before it is
    read. ``key`` names the hold-out's rows; ``seed`` never touches the noise.
    """
    effective, chosen = _ready(schema, release, level, epsilon, alpha)
    n_syn, n_hold = synthetic.count(), holdout.count()
    if not n_syn or not n_hold:
        raise BoundError("an empty table can't be bounded")
    if max_rows_per_person is not None and max_rows_per_person < 1:
        raise BoundError("max_rows_per_person has to be 1 or more")
    half = halfwidth(release.n_min, epsilon, len(chosen["cells"]), alpha)
    limit = tolerance(release, chosen, str(schema.positive), half) if tolerance_ == "auto" else float(tolerance_)
    ledger, noise = PrivacyLedger(epsilon, max_rows_per_person=max_rows_per_person), noise or Noise()
    p_hat = _private(effective, release, private, chosen, epsilon, ledger, noise)
    ledger.seal()
    sample = kept(sampling.simple_sample(holdout, key, min(n_syn, n_hold), seed))
    tables = {"synthetic": synthetic, "ceiling": sample, "floor": sampling.permuted(sample, key, schema.target, seed)}
    results = {k: _result(k, chosen, p_hat, found, half) for k, found in _rates(effective, tables, chosen).items()}
    syn, top, low = results.values()
    if syn.thin:
        verdict, reason = None, f"a cell has fewer than {THIN} synthetic rows"
    elif top.worst > limit or low.worst <= limit:
        verdict, reason = None, "the tolerance does not tell a real sample from a permuted one"
    else:
        verdict, reason = ("within bound" if syn.worst <= limit else "outside tolerance"), ""
    total = release.epsilon_total + epsilon
    claim = {"epsilon_release": release.epsilon_total, "epsilon_bound": epsilon, "epsilon_per_row": total, "epsilon_per_person": None if max_rows_per_person is None else max_rows_per_person * total, "vacuous": bool(max_rows_per_person and max_rows_per_person * total > VACUOUS)}
    return BoundReport(syn, top, low, limit, verdict, reason, claim, ledger.audit())
