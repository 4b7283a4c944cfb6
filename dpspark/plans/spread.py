"""Weights of any number of tuples as written tables.

A tuple is a cohort, a class and the bins of every column, with the number of
rows that have them. There may be too many for the driver; what a release says
of them is bounded by the release. So sums by constraint come to the driver, and
the factors go out again as literals that every row looks up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dpspark import domains
from dpspark.sources.tables import kept

#: Rounds whose factors are put into one expression before weights are written; a round that moves no sum by more than this ends the loop.
WRITTEN_EVERY, STILL = 4, 1e-13


def table_of(values: Sequence[float], at: Column) -> Column:
    """The entry of a list of numbers at a place; null where there is none. The list is one literal of the plan."""
    return F.get(F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>"), at)


def placed(cells: DataFrame, names: Sequence[str], blocks: Sequence[bool]) -> DataFrame:
    """``cells`` with the number of their cohort (``_at``, -1: not released) and the class that their histograms are of (``_row``)."""
    known = domains.frame(cells.sparkSession, [(n, i, b) for i, (n, b) in enumerate(zip(names, blocks, strict=True))], "_name string, _at int, _own boolean")
    rows = cells.join(F.broadcast(known), F.col("_cohort") == F.col("_name"), "left")
    side = F.when(F.col("_pos"), 0).otherwise(1)
    return rows.withColumns({"_at": F.coalesce("_at", F.lit(-1)), "_row": F.when(F.col("_own"), side).otherwise(0)}).drop("_name", "_own")


def sums(rows: DataFrame, by: Column, amount: Column, size: int) -> np.ndarray:
    """Sums by a whole number from 0 to ``size``; others are left out."""
    found = rows.groupBy(by.alias("k")).agg(F.sum(amount).alias("s")).where(F.col("k") >= 0).collect()
    out = np.zeros(size)
    for r in found:
        out[r["k"]] = r["s"]
    return out


def raked(rows: DataFrame, of: Sequence[Column], targets: Sequence[np.ndarray], n: int, rounds: int) -> DataFrame:
    """``rows`` with ``_w``: weights in [0, 1] by iterative proportional fitting, one job for a family in each round.

    of: each family's constraint of a row (-1: none); a row of which the first
    family has no constraint weighs nothing. Ends when no sum moves any more.
    """
    size, known = F.col("_n").cast("double"), of[0] >= 0
    whole = rows.agg(F.sum(size)).first()[0] or 0.0
    state = kept(rows.withColumn("_w", F.when(known, F.lit(min(1.0, n / max(whole, 1.0)))).otherwise(0.0)))
    w = F.col("_w")
    clipped = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    for k in range(1, rounds + 1):
        moved = 0.0
        for at, target in zip(of, targets, strict=True):
            have, factor = sums(state, at, w * size, len(target)), np.ones(len(target))
            held = ~np.isnan(target) & (have > 0)
            factor[held] = target[held] / have[held]
            moved = max(moved, float(np.abs(factor - 1).max(initial=0.0)))
            w = w * F.coalesce(table_of(factor, at), F.lit(1.0))
        w = clipped(w)
        total = state.agg(F.sum(w * size)).first()[0] or 0.0
        w = clipped(w * (n / total)) if total > 0 else w
        if k % WRITTEN_EVERY == 0 or k == rounds or moved < STILL:
            state, w = kept(state.withColumn("_w", w)), F.col("_w")
        if moved < STILL:
            break
    return state


def ahead(rows: DataFrame, by: Sequence[str], mass: Column, name: str) -> DataFrame:
    """``rows``, one for each value of ``by``, with the sum of ``mass`` over all that come before in the order of ``by``.

    Sums go up a tree, of which a column is a level: a row's is that of its
    elder siblings and of those of its parents. No window is longer than a
    column has values below one parent, whatever the number of rows.
    """
    level, lower = rows.select(*by, mass.cast("double").alias("_mass")), None
    older = []
    for depth in range(len(by), 0, -1):
        siblings = Window.partitionBy(*by[: depth - 1]).orderBy(by[depth - 1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        older.append(level.select(*by[:depth], (F.sum("_mass").over(siblings) - F.col("_mass")).alias("_older")))
        level = level.groupBy(*by[: depth - 1]).agg(F.sum("_mass").alias("_mass"))
    for depth, own in zip(range(1, len(by) + 1), reversed(older), strict=True):
        if lower is None:
            lower = own.withColumnRenamed("_older", name)
        else:
            lower = own.join(lower, list(by[: depth - 1])).select(*by[:depth], (F.col(name) + F.col("_older")).alias(name))
    return rows.join(lower, list(by))
