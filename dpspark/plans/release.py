"""A differentially private release: cohort sizes, histograms and conditional rates.

Two jobs read the table: one counts every cohort, class, feature and bin, one
every conditional cell. Their results, as large as the public domain, come to
the driver, where all noise is drawn, once, at scales that the ledger issues.
"""

from __future__ import annotations

import json
import math
import statistics
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from dpspark import domains
from dpspark.errors import DomainTooLargeError, ReleaseError
from dpspark.functions import binning
from dpspark.ledger import PARALLEL, PrivacyLedger, per_person
from dpspark.noise import Noise
from dpspark.operators import counts
from dpspark.schema import Band, PublicSchema

# Shares of the budget and floors that a release is defined by.
N_MIN, N_MIN_FLOOR = 150, 50
COUNTS_SHARE, SUPPRESSION_SHARE, SUPPRESSION_MOST = 0.05, 0.05, 0.25
UNSPENT, DIGITS = 0.02, 5
UNIFORM_SD = math.sqrt(2.0)
#: Cells with rows of one level that the driver draws noise for.
MOST_OCCUPIED = 5_000_000


@dataclass
class Release:
    schema_name: str
    epsilon_total: float
    n_min: int
    cohorts: list[dict]
    conditional_levels: list[dict]
    coarsen: dict[str, dict[str, str]] = field(default_factory=dict)
    stratify: list = field(default_factory=list)
    audit: dict = field(default_factory=dict)
    schema_digest: str = ""
    created: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    def to_json(self, path: str | Path | None = None) -> str:
        text = json.dumps(asdict(self), indent=1)
        if path:
            Path(path).write_text(text, encoding="utf-8")
        return text

    @classmethod
    def from_json(cls, source: str | Path) -> Release:
        text = str(source)
        return cls(**json.loads(text if text.lstrip().startswith("{") else Path(source).read_text(encoding="utf-8")))

    def belongs_to(self, schema: PublicSchema) -> None:
        """Refuses another schema than the one that the release was made from; releases without a digest go by the name alone."""
        if self.schema_name != schema.name:
            raise ReleaseError(f"the release is of schema {self.schema_name}, not {schema.name}")
        if self.schema_digest and self.schema_digest != schema.digest():
            raise ReleaseError(f"the release was made from another version of schema {schema.name}: a release belongs to its schema")

    def effective_schema(self, schema: PublicSchema) -> PublicSchema:
        """``schema`` with the hierarchy that the release used, whether declared or derived."""
        stratify, bands = [], {}
        for column, found in self.stratify:
            stratify.append(column)
            if found:
                bands[column] = [Band(**b) for b in found]
        return replace(schema, stratify=stratify, bands=bands, coarsen=self.coarsen, conditional=[tuple(x["columns"]) for x in self.conditional_levels] or schema.conditional)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The release as flat tables."""
        size, hist, cell = [], [], []
        for c in self.cohorts:
            shares = list(c["class_balance"].values())
            size.append((c["cohort_id"], c["cohort_name"], c["cohort_size"], shares[0], shares[1], "by_class" in c))
            for cls, block in [(None, c), *c.get("by_class", {}).items()]:
                for col, h in block["numerical"].items():
                    hist += [(c["cohort_id"], cls, col, "numeric", i, binning.quota_label(h["bin_edges"], i), float(p)) for i, p in enumerate(h["proportions"])]
                for col, h in block["categorical"].items():
                    hist += [(c["cohort_id"], cls, col, "categorical", i, v, float(p)) for i, (v, p) in enumerate(h.items())]
        for level in self.conditional_levels:
            cell += [(level["level"], level["columns"], k, x["rate"], x["support"]) for k, x in level["cells"].items()]
        return {
            "release_cohort": domains.frame(spark, size, "cohort_id int, cohort string, size long, pos_share double, neg_share double, has_blocks boolean"),
            "release_histogram": domains.frame(spark, hist, "cohort_id int, cls string, col string, kind string, bin int, label string, share double"),
            "release_cell": domains.frame(spark, cell, "level int, columns array<string>, cell string, rate double, support long"),
        }


def moments(shares: list[float], edges: list[float]) -> tuple[float, float]:
    """Mean and population deviation of a histogram, at bin centres."""
    centres = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    mean = sum(p * x for p, x in zip(shares, centres, strict=True))
    return round(mean, 3), round(math.sqrt(max(0.0, sum(p * (x - mean) ** 2 for p, x in zip(shares, centres, strict=True)))), 3)


def numeric_block(shares: list[float], edges: list[float], bounds: tuple[float, float]) -> dict:
    mean, std = moments(shares, edges)
    return {"bin_edges": list(edges), "proportions": [round(p, DIGITS) for p in shares], "mean": mean, "std": std, "bounds": list(bounds)}


def noised(exact: list[float], scale: float, noise: Noise) -> list[float]:
    return [max(n + noise.laplace(scale), 0.0) for n in exact]


def shares(counts_: list[float]) -> list[float]:
    total = sum(counts_)
    return [c / total for c in counts_] if total > 0 else [1.0 / len(counts_)] * len(counts_)


def published(noisy: float, n_min: int) -> int:
    return int(max(n_min, round(noisy)))


@dataclass(frozen=True)
class Budget:
    """How epsilon is split; what a derived hierarchy cost is taken off first."""

    cohorts: float
    cells: float
    conditional: float
    query: float

    @classmethod
    def of(cls, epsilon: float, fraction: float, features: int, charge: bool) -> Budget:
        conditional, counted = fraction * epsilon, COUNTS_SHARE * epsilon
        marginals = epsilon - conditional - counted
        if charge:
            more = min(SUPPRESSION_SHARE * epsilon, SUPPRESSION_MOST * marginals)
            marginals, counted = marginals - more, counted + more
        return cls(counted / 2, counted / 2, conditional, marginals / (features + 1))


def _check(epsilon: float, fraction: float, n_min: int) -> None:
    if n_min < N_MIN_FLOOR:
        raise ReleaseError(f"n_min has to be {N_MIN_FLOOR} at least")
    if not 0 < fraction < 1:
        raise ReleaseError("conditional_fraction has to be between 0 and 1")
    if not epsilon > 0:
        raise ReleaseError("epsilon has to be positive")


def _class_blocks(schema: PublicSchema, part: dict, partition: tuple[str, ...], budget: Budget, ledger: PrivacyLedger, noise: Noise) -> dict:
    """One noised histogram of every feature over the counts of ``part``: (col, bin) to n."""
    block: dict = {"numerical": {}, "categorical": {}}
    for col in schema.features:
        name = f"hist[{'/'.join(partition)}][{col}]"
        scale = ledger.spend(name, "histogram", budget.query, 1.0, PARALLEL, partition, "marginals")
        if col in schema.numerical:
            edges = schema.edges(col)
            exact = [part.get((col, i), 0) for i in range(len(edges) - 1)]
            block["numerical"][col] = numeric_block(shares(noised(exact, scale, noise)), edges, schema.numerical[col])
        else:
            values = schema.levels(col)
            found = shares(noised([part.get((col, i), 0) for i in range(len(values))], scale, noise))
            block["categorical"][col] = {v: round(p, DIGITS) for v, p in zip(values, found, strict=True)}
    return block


def mixture(schema: PublicSchema, weight: float, pos: dict, neg: dict) -> dict:
    """The pooled block of two class blocks: no query, and none is charged."""
    block: dict = {"numerical": {}, "categorical": {}}
    for col in schema.numerical:
        mixed = [weight * a + (1 - weight) * b for a, b in zip(pos["numerical"][col]["proportions"], neg["numerical"][col]["proportions"], strict=True)]
        total = sum(mixed)
        block["numerical"][col] = numeric_block([m / total for m in mixed] if total > 0 else mixed, schema.edges(col), schema.numerical[col])
    for col in schema.categorical:
        block["categorical"][col] = {v: round(weight * p + (1 - weight) * neg["categorical"][col][v], DIGITS) for v, p in pos["categorical"][col].items()}
    return block


def release_statistics(
    schema: PublicSchema,
    df: DataFrame,
    epsilon_total: float = 2.0,
    conditional_fraction: float = 0.2,
    n_min: int = N_MIN,
    charge_suppression: bool = True,
    seed: int | None = None,
    max_rows_per_person: int | None = None,
    acknowledge_vacuous_privacy_unit: bool = False,
    autoconfig: bool = True,
    n_records: int = 1000,
    class_conditional: bool = True,
) -> Release:
    """The private table's release. The budget is closed exactly where the hierarchy is declared and every level has a cell."""
    _check(epsilon_total, conditional_fraction, n_min)
    warnings, digest = [], schema.digest()
    if max_rows_per_person and (said := per_person(max_rows_per_person, epsilon_total, acknowledge_vacuous_privacy_unit)):
        warnings.append(said)
    noise, ledger = Noise(seed), PrivacyLedger(epsilon_total, max_rows_per_person=max_rows_per_person)
    schema.validate(df)
    data = schema.coerce(df)
    derived = None
    if not schema.conditional and autoconfig:
        from dpspark.plans.autoconfig import derive

        derived = derive(schema, data, epsilon_total, n_records, n_min=n_min, ledger=ledger, noise=noise)
        schema = derived.schema
    budget = Budget.of(epsilon_total - ledger.total(), conditional_fraction, len(schema.features), charge_suppression)

    sizes = {r["cohort"]: (r["n"], r["n_pos"]) for r in counts.cohort_counts(schema, data).collect()}
    by_class: dict[tuple[str, str], dict] = {}
    for r in counts.histograms(schema, data).collect():
        by_class.setdefault((r["cohort"], r["cls"]), {})[r["col"], r["bin"]] = r["n"]
    cohorts = []
    for i, name in enumerate(domains.cohorts(schema)):
        n, n_pos = sizes[name]
        noisy = n + noise.laplace(ledger.spend(f"count[cohort][{name}]", "count", budget.cohorts, 1.0, PARALLEL, (name,), "published_counts_cohorts"))
        if (noisy if charge_suppression else n) < n_min:
            continue
        scale = ledger.spend(f"class_balance[{name}]", "histogram", budget.query, 1.0, PARALLEL, (name,), "marginals")
        balance = noised([n_pos, n - n_pos], scale, noise)
        total = sum(balance) or 1.0
        labels = (str(schema.positive), str(schema.negative))
        entry = {"cohort_id": i, "cohort_name": name, "cohort_size": published(noisy, n_min), "class_balance": {v: round(b / total, DIGITS) for v, b in zip(labels, balance, strict=True)}}
        parts = by_class[name, counts.POSITIVE], by_class[name, counts.NEGATIVE]
        if class_conditional and min(balance if charge_suppression else (n_pos, n - n_pos)) >= n_min:
            blocks = [_class_blocks(schema, p, (name, v), budget, ledger, noise) for p, v in zip(parts, labels, strict=True)]
            entry |= mixture(schema, balance[0] / total, *blocks) | {"by_class": dict(zip(labels, blocks, strict=True))}
        else:
            both = {k: parts[0][k] + parts[1][k] for k in parts[0]}
            entry |= _class_blocks(schema, both, (name,), budget, ledger, noise)
        cohorts.append(entry)
    if not cohorts:
        raise ReleaseError("no cohort is large enough to be released; n_min, epsilon or the stratification have to change")

    levels = _conditional(schema, data, budget, n_min, charge_suppression, ledger, noise) if schema.conditional else []
    if schema.conditional and not levels:
        warnings.append("no conditional cell is large enough to be released")
    warnings += _diagnostics(schema, levels, budget, ledger)
    if noise.void:
        warnings.append("noise came from a seed: the guarantee is void")
    ledger.assert_within_budget()
    ledger.seal()
    audit = ledger.audit()
    audit["warnings"] += warnings
    audit |= {"guarantee_void": noise.void, "n_min": n_min, "charge_suppression": charge_suppression, "derived": None if derived is None else derived.record()}
    stratify = [[c, [asdict(b) for b in schema.bands[c]] if c in schema.numerical else None] for c in schema.stratify]
    return Release(schema.name, epsilon_total, n_min, cohorts, levels, schema.coarsen, stratify, audit, digest)


def gated(exact: dict[int, int], size: int, n_min: int, scale: float, charge: bool, noise: Noise) -> dict[int, int]:
    """Published counts of a level's cells by their number, as noise on every one of ``size`` cells would give them.

    Noise is drawn for the occupied cells of ``exact``. An empty cell is released
    if its noise alone reaches the gate: which ones do is drawn by skipping from
    one to the next, so what is held are occupied and released cells.
    """
    out = {}
    for at, n in exact.items():
        noisy = n + noise.laplace(scale)
        if (noisy if charge else n) >= n_min:
            out[at] = published(noisy, n_min)
    if charge:
        if size * math.exp(-n_min / scale) / 2 > domains.MOST_CELLS:
            raise DomainTooLargeError(f"of {size} cells more than {domains.MOST_CELLS} empty ones would be released; coarsen a column or raise n_min")
        for at in noise.places(size, n_min, scale):
            if at not in exact:
                out[at] = published(noise.above(n_min, scale), n_min)
    return out


def _sparse(schema: PublicSchema, data: DataFrame, i: int, epsilon: float, n_min: int, charge: bool, ledger: PrivacyLedger, noise: Noise) -> tuple[dict[str, tuple[int, int]], dict[str, int]]:
    """Of a level that is too large to list: exact counts of the released cells, and their published ones."""
    level = schema.conditional[i]
    size = domains.level_size(schema, level)
    found = counts.occupied(schema, data, level).limit(MOST_OCCUPIED + 1).toPandas()
    if len(found) > MOST_OCCUPIED:
        raise DomainTooLargeError(f"level {i}: more than {MOST_OCCUPIED} cells have rows; coarsen a column")
    # disjoint cells in parallel: one entry says that every one of them was asked for
    scale = ledger.spend(f"count[cell][L{i}][each of {size}]", "count", epsilon, 1.0, PARALLEL, (f"L{i}",), f"published_counts_cells_L{i}")
    exact = dict(zip(found["at"].tolist(), found["n"].tolist(), strict=True))
    kept = gated(exact, size, n_min, scale, charge, noise)
    positive = dict(zip(found["at"].tolist(), found["n_pos"].tolist(), strict=True))
    names = {at: domains.cell_name(schema, level, at) for at in sorted(kept)}
    return {names[at]: (exact.get(at, 0), positive.get(at, 0)) for at in names}, {names[at]: kept[at] for at in names}


def _conditional(schema: PublicSchema, data: DataFrame, budget: Budget, n_min: int, charge: bool, ledger: PrivacyLedger, noise: Noise) -> list[dict]:
    exact: dict[int, dict[str, tuple[int, int]]] = {}
    listed = [i for i, level in enumerate(schema.conditional) if domains.level_size(schema, level) <= domains.MOST_CELLS]
    if listed:
        for r in counts.level_counts(replace(schema, conditional=[schema.conditional[i] for i in listed]), data).collect():
            exact.setdefault(listed[r["level"]], {})[r["cell"]] = r["n"], r["n_pos"]
    kept: list[dict[str, int]] = []
    for i in range(len(schema.conditional)):
        epsilon = budget.cells / len(schema.conditional)
        if i not in listed:
            exact[i], found = _sparse(schema, data, i, epsilon, n_min, charge, ledger, noise)
            kept.append(found)
            continue
        cells = sorted(exact[i])
        scale = ledger.spend_all([(f"count[cell][L{i}][{c}]", (c,)) for c in cells], "count", epsilon, 1.0, PARALLEL, f"published_counts_cells_L{i}")
        noisy = {c: exact[i][c][0] + noise.laplace(scale) for c in cells}
        kept.append({c: published(v, n_min) for c, v in noisy.items() if (v if charge else exact[i][c][0]) >= n_min})
    viable = max(1, sum(bool(k) for k in kept))
    levels = []
    for i, (columns, cells) in enumerate(zip(schema.conditional, kept, strict=True)):
        if cells:
            scale = ledger.spend_all([(f"cond[L{i}][{c}]", (c,)) for c in cells], "count", budget.conditional / viable, 1.0, PARALLEL, f"conditional_L{i}")
            rate = {c: min(1.0, max(0.0, exact[i][c][1] + noise.laplace(scale)) / max(n, n_min)) for c, n in cells.items()}
            levels.append({"level": i, "columns": list(columns), "cells": {c: {"rate": round(rate[c], DIGITS), "support": n} for c, n in cells.items()}})
    return levels


def _diagnostics(schema: PublicSchema, levels: list[dict], budget: Budget, ledger: PrivacyLedger) -> list[str]:
    said = []
    if ledger.epsilon - ledger.total() > UNSPENT * ledger.epsilon:
        said.append("part of the budget was not spent")
    viable = max(1, len(levels))
    for level in levels:
        rates = [c["rate"] for c in level["cells"].values()]
        if len(rates) > 1:
            typical = UNIFORM_SD / statistics.median(c["support"] for c in level["cells"].values()) / (budget.conditional / viable)
            if typical >= max(rates) - min(rates):
                said.append(f"level {level['level']}: the noise is as large as the spread of the rates")
    return said
