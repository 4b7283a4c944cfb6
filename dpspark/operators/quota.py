"""How many rows of each kind to make: whole numbers that keep to a release's shares."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark.functions import binning
from dpspark.operators.sampling import largest_remainder
from dpspark.plans.release import Release
from dpspark.schema import PublicSchema

COVERAGE, LEAST_PER_CELL = 0.90, 8


def apportion(shares: Sequence[float], n: int, rng: random.Random | None = None) -> list[int]:
    """Largest remainders; ties go by place, or at random with ``rng``."""
    total = sum(shares)
    exact = [n * s / total for s in shares] if total > 0 else [n / len(shares)] * len(shares)
    out = [int(x) for x in exact]
    order = sorted(range(len(exact)), key=lambda i: (out[i] - exact[i], rng.random() if rng else i))
    for i in order[: n - sum(out)]:
        out[i] += 1
    return out


def allocate_rows(release: Release, n: int) -> dict[str, int]:
    """Rows of each cohort, in proportion to their sizes."""
    return dict(zip((c["cohort_name"] for c in release.cohorts), apportion([c["cohort_size"] for c in release.cohorts], n), strict=True))


def _shares(block: dict, schema: PublicSchema) -> dict[str, dict[str, float]]:
    out = {c: {binning.quota_label(h["bin_edges"], i): p for i, p in enumerate(h["proportions"])} for c, h in block["numerical"].items()}
    return out | {c: {v: float(p) for v, p in h.items()} for c, h in block["categorical"].items()}


def batch_quotas(schema: PublicSchema, cohort: dict, n: int, rng: random.Random | None = None, by_class: bool = True) -> dict:
    """Of ``n`` rows: how many of each label, and for each class (or "all") and column how many of each bin or value."""
    labels = list(cohort["class_balance"])
    outcome = dict(zip(labels, apportion(list(cohort["class_balance"].values()), n, rng), strict=True))
    parts = {v: (cohort["by_class"][v], outcome[v]) for v in labels} if by_class and cohort.get("by_class") else {"all": (cohort, n)}
    columns = {k: {c: dict(zip(s, apportion(list(s.values()), size, rng), strict=True)) for c, s in _shares(block, schema).items()} for k, (block, size) in parts.items()}
    return {"outcome": outcome, "columns": columns}


def _each(a: dict, b: dict, of) -> dict:
    return {k: _each(v, b.get(k, {}), of) if isinstance(v, dict) else of(v, b.get(k, 0)) for k, v in a.items()}


def absorb(done: dict, emitted: dict) -> dict:
    """Running totals."""
    keys = done.keys() | emitted.keys()
    return {k: absorb(done.get(k, {}), emitted.get(k, {})) if isinstance(done.get(k, emitted.get(k)), dict) else done.get(k, 0) + emitted.get(k, 0) for k in keys}


def remaining_quotas(target: dict, done: dict, n: int, rng: random.Random | None = None) -> dict:
    """What is still owed, scaled to the next ``n`` rows."""
    owed = _each(target, done, lambda want, have: max(0, want - have))

    def scaled(counts: dict, size: int) -> dict:
        return dict(zip(counts, apportion([float(v) for v in counts.values()], size, rng), strict=True))

    outcome = scaled(owed["outcome"], n)
    return {"outcome": outcome, "columns": {k: {c: scaled(v, outcome.get(k, n)) for c, v in x.items()} for k, x in owed["columns"].items()}}


def positives(rate: float, n: int, u: float) -> int:
    """``rate * n`` rounded at random, without bias; ``u`` is uniform."""
    exact = rate * n
    return min(n, max(0, int(exact) + (u < exact - int(exact))))


def allocated(sizes: DataFrame, n: int) -> DataFrame:
    """(cohort, rows) of (cohort, size): the same apportionment as a window."""
    share = sizes.withColumn("exact", F.lit(float(n)) * F.col("size") / F.sum("size").over(_all()))
    return largest_remainder(share.withColumn("_one", F.lit(1)), ["_one"], "exact", F.lit(n), F.col("cohort"), "rows").select("cohort", "rows")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def quotas(shares: DataFrame, by: list[str], total: Column, ties: Column) -> DataFrame:
    """``shares`` (by, share) with ``quota``: whole numbers that sum to ``total`` in each group."""
    return largest_remainder(shares.withColumn("_exact", F.col("share") * total), by, "_exact", total, ties, "quota").drop("_exact")


def band_coverage(schema: PublicSchema, release: Release, level: int = 0) -> dict[str, float]:
    """Of each conditioning column: the share of its released mass that some released cell names."""
    chosen = release.conditional_levels[level]
    total = sum(c["cohort_size"] for c in release.cohorts) or 1
    out = {}
    for i, col in enumerate(chosen["columns"]):
        named = {cell.split(" & ")[i] for cell in chosen["cells"]}
        mass = 0.0
        for c in release.cohorts:
            if col in schema.numerical:
                h = c["numerical"][col]
                parts = {binning.cell_label(col, h["bin_edges"], k): p for k, p in enumerate(h["proportions"])}
            else:
                parts = {}
                for v, p in c["categorical"][col].items():
                    name = f"{col}={release.coarsen.get(col, {}).get(v, v)}"
                    parts[name] = parts.get(name, 0.0) + float(p)
            mass += c["cohort_size"] * sum(p for k, p in parts.items() if k in named) / (sum(parts.values()) or 1.0)
        out[col] = mass / total
    return out


def mixture(schema: PublicSchema, release: Release) -> dict[str, dict[str, float]]:
    """Each column's released shares over all cohorts, by their sizes."""
    total, out = sum(c["cohort_size"] for c in release.cohorts) or 1, {}
    for c in release.cohorts:
        for col, shares in _shares(c, schema).items():
            for k, p in shares.items():
                out.setdefault(col, {})[k] = out.get(col, {}).get(k, 0.0) + c["cohort_size"] / total * p
    return out
