"""Choosing rows of a pool so that their marginals match a release.

A row's constraints depend on its cohort, its class and its bins only, so
weights are raked over the distinct tuples of these with their multiplicities.
A family of constraints (cohorts; classes; one column's bins) is disjoint: each
round updates a family at a time. Up to ``MOST_TUPLES`` tuples are raked as
vectors on the driver; more stay in Spark (``spread``), by the same rule.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark import domains
from dpspark.errors import GenerationError
from dpspark.functions import binning
from dpspark.functions.draw import uniform
from dpspark.operators import counts
from dpspark.operators.sampling import GROUP_ROWS, numbered
from dpspark.plans import spread, swaps
from dpspark.plans.release import Release
from dpspark.schema import PublicSchema
from dpspark.sources.tables import kept

# Fixed values of the selection.
ROUNDS, LEAST_EXPECTED, POOLED_WEIGHT, SUPPRESSED_WEIGHT, LEAST_COVER = 40, 1.0, 3.0, 30.0, 1.1
#: Tuples that the driver may hold, and that are broadcast.
MOST_TUPLES, BROADCAST_TUPLES = 1_000_000, 100_000
SUB_BINS = ("release", "generator")


def pool_cells(schema: PublicSchema, pool: DataFrame) -> DataFrame:
    """``pool`` with its cohort, class and bins, as columns ``_cohort``, ``_pos`` and ``_b_<column>``."""
    parts = {f"_b_{c}": binning.pool(F.col(c), schema.edges(c)) for c in schema.numerical}
    for c in schema.categorical:
        place = F.array_position(F.array(*(F.lit(v) for v in schema.levels(c))), F.col(c)) - 1
        parts[f"_b_{c}"] = F.coalesce(place.cast("int"), F.lit(-1))
    return pool.withColumns({"_cohort": domains.cohort_key(schema), "_pos": schema.is_positive()} | parts)


def keys(schema: PublicSchema) -> list[str]:
    """The columns of a tuple, in order."""
    return ["_cohort", "_pos", *(f"_b_{c}" for c in schema.features)]


def tuples(schema: PublicSchema, cells: DataFrame) -> pd.DataFrame | None:
    """The distinct tuples of a pool and how many rows each has; None if there are too many for the driver."""
    by = keys(schema)
    found = cells.groupBy(*by).agg(F.count("*").alias("_n")).orderBy(*by).limit(MOST_TUPLES + 1).toPandas()
    return None if len(found) > MOST_TUPLES else found


@dataclass
class Family:
    """Disjoint constraints: for each tuple the one that it meets (-1: none), and their targets."""

    of: np.ndarray
    target: np.ndarray


def bins_of(schema: PublicSchema, column: str) -> int:
    """Places of a column in a tuple; the last one of a category is for values that are not released."""
    return len(schema.edges(column)) - 1 if column in schema.numerical else len(schema.levels(column)) + 1


def targets(schema: PublicSchema, release: Release, n: int, least: float) -> list[np.ndarray]:
    """What the release asks of the sums of weights, by family: cohorts, classes, each column's bins. NaN: nothing."""
    total = sum(c["cohort_size"] for c in release.cohorts) or 1.0
    mass = np.array([n * c["cohort_size"] / total for c in release.cohorts])
    labels = (str(schema.positive), str(schema.negative))
    share = np.array([[c["class_balance"].get(v, 0.5) for v in labels] for c in release.cohorts])
    out = [mass, (mass[:, None] * share).reshape(-1)]
    for col in schema.features:
        asked = np.full((len(release.cohorts), 2, bins_of(schema, col)), np.nan)
        for i, c in enumerate(release.cohorts):
            for k, v in enumerate(labels):
                h = shares_of(schema, c.get("by_class", {}).get(v, c), col)
                if c.get("by_class"):
                    asked[i, k] = mass[i] * share[i, k] * h
                elif k == 0:
                    asked[i, 0] = mass[i] * h
        out.append(asked.reshape(-1))
    return [np.where((t == 0) | (t >= least), t, np.nan) for t in out]


def shares_of(schema: PublicSchema, block: dict, column: str) -> np.ndarray:
    if column in schema.numerical:
        h = np.asarray(block["numerical"][column]["proportions"], float)
    else:
        h = np.array([*(float(block["categorical"][column].get(x, 0.0)) for x in schema.levels(column)), 0.0])
    return h / max(h.sum(), 1e-12)


def blocks_of(release: Release) -> list[bool]:
    return [bool(c.get("by_class")) for c in release.cohorts]


def families(schema: PublicSchema, release: Release, t: pd.DataFrame, n: int, least: float = LEAST_EXPECTED) -> list[Family]:
    """Constraints of the release on the sums of weights, in the order in which a row meets them."""
    place = {c["cohort_name"]: i for i, c in enumerate(release.cohorts)}
    at = np.array([place.get(c, -1) for c in t["_cohort"]], int)
    side = np.where(t["_pos"].to_numpy(bool), 0, 1)
    row = np.where(np.array(blocks_of(release))[at], side, 0)
    of = [at, np.where(at >= 0, at * 2 + side, -1)]
    for col in schema.features:
        bins = bins_of(schema, col)
        of.append(np.where(at >= 0, (at * 2 + row) * bins + t[f"_b_{col}"].to_numpy() % bins, -1))
    return [Family(a, target) for a, target in zip(of, targets(schema, release, n, least), strict=True)]


def places(schema: PublicSchema) -> list[Column]:
    """The same as columns of ``spread.placed`` tuples."""
    at, row, side = F.col("_at"), F.col("_row"), F.when(F.col("_pos"), 0).otherwise(1)
    of = [at, F.when(at >= 0, at * 2 + side).otherwise(-1)]
    for col in schema.features:
        bins = bins_of(schema, col)
        of.append(F.when(at >= 0, (at * 2 + row) * bins + F.pmod(F.col(f"_b_{col}"), F.lit(bins))).otherwise(-1))
    return of


def rake(weights: np.ndarray, size: np.ndarray, found: list[Family], n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights in [0, 1] by iterative proportional fitting; the sum over rows is ``n``."""
    w = weights.astype(float).copy()
    for _ in range(rounds):
        for f in found:
            inside = f.of >= 0
            sums = np.bincount(f.of[inside], (w * size)[inside], len(f.target))
            factor = np.ones(len(f.target))
            held = ~np.isnan(f.target) & (sums > 0)
            factor[held] = f.target[held] / sums[held]
            w[inside] *= factor[f.of[inside]]
        w = np.clip(w, 0.0, 1.0)
        total = float((w * size).sum())
        if total > 0:
            w = np.clip(w * (n / total), 0.0, 1.0)
    return w


def inclusion_weights(schema: PublicSchema, release: Release, pool: DataFrame, n: int, rounds: int = ROUNDS, least: float = LEAST_EXPECTED) -> DataFrame:
    """The tuples of ``pool`` with their rows (``_n``) and weight (``_w``); tuples of a cohort that was not released get none."""
    weighed = _weighed(schema, release, pool_cells(schema, pool), n, rounds, least)
    return weighed.select(*keys(schema), "_n", "_w") if isinstance(weighed, DataFrame) else pool.sparkSession.createDataFrame(weighed)


def _weighed(schema: PublicSchema, release: Release, cells: DataFrame, n: int, rounds: int, least: float = LEAST_EXPECTED) -> pd.DataFrame | DataFrame:
    if n <= 0:
        raise GenerationError("the number of rows has to be positive")
    t = tuples(schema, cells)
    if t is None:
        rows = spread.placed(cells.groupBy(*keys(schema)).agg(F.count("*").alias("_n")), [c["cohort_name"] for c in release.cohorts], blocks_of(release))
        return spread.raked(rows, places(schema), targets(schema, release, n, least), n, rounds)
    size = t["_n"].to_numpy(float)
    found = families(schema, release, t, n, least)
    start = np.where(found[0].of >= 0, min(1.0, n / max(size.sum(), 1.0)), 0.0)
    return t.assign(_w=rake(start, size, found, n, rounds))


def _with_tuples(cells: DataFrame, small: DataFrame, by: list[str], number: int) -> DataFrame:
    return cells.join(F.broadcast(small) if number <= BROADCAST_TUPLES else small, by)


def systematic(cells: DataFrame, weighed: pd.DataFrame | DataFrame, n: int, key: str, start: float, seed: int, groups: int | None = None) -> DataFrame:
    """Rows that a systematic sample takes: one wherever the running sum of weights passes another whole number.

    Rows of one tuple follow one another, so only the tuples' prefix sums are
    global; a row's place within its tuple is by a hash of ``key``.
    """
    if isinstance(weighed, DataFrame):
        by = [c for c in weighed.columns if c not in ("_n", "_w", "_at", "_row")]
        # clipped weights don't add up to n any more
        whole = weighed.agg(F.sum(F.col("_w") * F.col("_n"))).first()[0] or 0.0
        scaled = weighed.select(*by, "_n", (F.col("_w") * (n / whole if whole > 0 else 1.0)).alias("_w"))
        rows = cells.join(spread.ahead(scaled, by, F.col("_w") * F.col("_n"), "_ahead").drop("_n"), by)
    else:
        by = [c for c in weighed.columns if c not in ("_n", "_w")]
        whole = float((weighed["_w"] * weighed["_n"]).sum())
        weighed = weighed.assign(_w=weighed["_w"] * (n / whole if whole > 0 else 1.0))
        ahead = weighed.assign(_ahead=(weighed["_w"] * weighed["_n"]).cumsum() - weighed["_w"] * weighed["_n"])
        rows = _with_tuples(cells, cells.sparkSession.createDataFrame(ahead[[*by, "_w", "_ahead"]]), by, len(ahead))
    upto = F.col("_ahead") + F.col("_rank") * F.col("_w") - start
    ranked = numbered(rows.withColumnRenamed("_ahead", "_before"), uniform(F.col(key), seed), "_rank", by, [key], groups).withColumnRenamed("_before", "_ahead")
    return ranked.withColumn("_upto", upto).where(F.floor("_upto") > F.floor(F.col("_upto") - F.col("_w"))).drop("_upto", "_w", "_ahead", "_rank")


def pooled_targets(schema: PublicSchema, release: Release, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(target, weight) of each column's bins over all cohorts, which the release implies."""
    out, total = [], sum(c["cohort_size"] for c in release.cohorts) or 1.0
    for col in schema.features:
        target = n * sum(c["cohort_size"] / total * shares_of(schema, c, col) for c in release.cohorts)
        weight = np.full(len(target), POOLED_WEIGHT)
        if col in schema.categorical:
            weight[target == 0] = SUPPRESSED_WEIGHT
        out.append((target, weight))
    return out


def objective(schema: PublicSchema, release: Release, t: pd.DataFrame, n: int) -> list[tuple[Family, np.ndarray]]:
    """What ``refine`` lowers the distance to: the cells of each cohort and class, and, weighing more, the marginals over all cohorts that they imply."""
    out = [(f, np.ones(len(f.target))) for f in families(schema, release, t, n, 0.0)]
    for col, (target, weight) in zip(schema.features, pooled_targets(schema, release, n), strict=True):
        out.append((Family(t[f"_b_{col}"].to_numpy() % len(target), target), weight))
    return out


def refine(weighed: pd.DataFrame, found: list[tuple[Family, np.ndarray]], taken: np.ndarray, most: int | None = None, n: int | None = None) -> np.ndarray:
    """Rows taken of each tuple after single rows were swapped, the best swap of all each time, while the weighted distance from ``found`` falls.

    Where ``taken`` has more or fewer than ``n`` rows, the best rows go or come first.
    """
    of = np.stack([f.of for f, _ in found])
    pool = swaps.Held(of, weighed["_n"].to_numpy(), taken, found[0][0].of >= 0)
    have = [np.bincount(f.of[f.of >= 0], taken[f.of >= 0], len(f.target)) for f, _ in found]
    swaps.refine(pool, [(f.target, w) for f, w in found], have, 0 if n is None else n - int(taken.sum()), ROUNDS * int(taken.sum()) if most is None else most)
    return pool.taken


def refined_tuples(schema: PublicSchema, release: Release, weighed: DataFrame, taken: DataFrame, n: int) -> DataFrame:
    """The tuples of ``weighed`` with the rows that are taken of each (``_taken``), by the same rule, without bringing them to the driver."""
    by = keys(schema)
    rows = kept(weighed.join(taken.groupBy(*by).agg(F.count("*").cast("int").alias("_taken")), by, "left").fillna(0, ["_taken"]).drop("_w"))
    pooled = pooled_targets(schema, release, n)
    of = [*places(schema), *(F.pmod(F.col(f"_b_{c}"), F.lit(len(t))) for c, (t, _) in zip(schema.features, pooled, strict=True))]
    found = [*((t, np.ones(len(t))) for t in targets(schema, release, n, 0.0)), *pooled]
    have = [spread.sums(rows, at, F.col("_taken"), len(t)) for at, (t, _) in zip(of, found, strict=True)]
    total = int(rows.agg(F.sum("_taken")).first()[0] or 0)
    pool = swaps.Spread(rows, by, of, F.col("_at") >= 0)
    swaps.refine(pool, found, have, n - total, ROUNDS * n)
    return pool.current()


def pool_coverage(release: Release, schema: PublicSchema, pool: DataFrame, n: int) -> DataFrame:
    """(cohort, owed, have, ratio) of every released cohort."""
    total = sum(c["cohort_size"] for c in release.cohorts) or 1
    owed = domains.frame(pool.sparkSession, [(c["cohort_name"], round(n * c["cohort_size"] / total, 1)) for c in release.cohorts], "cohort string, owed double")
    seen = pool.groupBy(domains.cohort_key(schema).alias("cohort")).agg(F.count("*").alias("have"))
    have = F.coalesce("have", F.lit(0).cast("long"))
    return owed.join(seen, "cohort", "left").select("cohort", "owed", have.alias("have"), (have / F.col("owed")).alias("ratio"))


def sub_bin_redraw(schema: PublicSchema, release: Release, df: DataFrame, key: str, seed: int) -> DataFrame:
    """Numbers drawn anew within their bin (and band) in cohorts with class blocks: no value of the generator's own is left.

    Bin counts and cohorts stay. A column whose numbers are all whole gets whole ones.
    """
    blocks = [c["cohort_name"] for c in release.cohorts if c.get("by_class")]
    if not blocks or not schema.numerical:
        return df
    whole = df.agg(*(F.coalesce(F.bool_and(F.col(c) % 1 == 0), F.lit(False)).alias(c) for c in schema.numerical)).first()
    cohort = domains.cohort_key(schema)
    new = {}
    for c, (_, top) in schema.numerical.items():
        edges = schema.edges(c)
        at = binning.pool(F.col(c), edges)
        lo, hi = F.get(F.array(*map(F.lit, edges[:-1])), at), F.get(F.array(*map(F.lit, edges[1:])), at)
        if c in schema.stratify:
            cut = [schema.bands[c][0].lo, *(b.hi for b in schema.bands[c])]
            band = binning.band(F.col(c), cut)
            lo = F.when(band >= 0, F.greatest(lo, F.get(F.array(*(F.lit(float(x)) for x in cut[:-1])), band))).otherwise(lo)
            hi = F.when(band >= 0, F.least(hi, F.get(F.array(*(F.lit(float(x)) for x in cut[1:])), band))).otherwise(hi)
        u = uniform(F.col(key), f"{seed} {c}")
        if whole[c]:
            first, last = F.ceil(lo), F.when(hi >= float(top), F.floor(hi)).otherwise(F.ceil(hi) - 1)
            drawn = F.when(last >= first, first + F.floor(u * (last - first + 1))).otherwise(F.col(c)).cast("double")
        else:
            drawn = lo + u * (hi - lo)
        new[c] = F.when(cohort.isin(blocks) & F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= edges[0]) & (F.col(c) <= edges[-1]), drawn).otherwise(F.col(c))
    return df.withColumns(new)


def select_to_release(schema: PublicSchema, release: Release, pool: DataFrame, n: int, key: str, rounds: int = ROUNDS, refined: bool = True, least_cover: float = LEAST_COVER, allow_short_pool: bool = False, sub_bin: str = "release", seed: int = 0) -> DataFrame:
    """``n`` rows of ``pool`` whose marginals match the release; ``key`` names its rows.

    A pool of fewer than ``n`` rows is refused; one with too few rows for some
    cohort too, unless ``allow_short_pool`` makes that a warning. ``sub_bin`` is
    "release" (numbers are drawn anew within their bins) or "generator".
    """
    if sub_bin not in SUB_BINS:
        raise GenerationError(f"sub_bin must be one of {', '.join(SUB_BINS)}")
    if (held := pool.count()) < n:
        raise GenerationError(f"the pool has {held} rows, fewer than the {n} asked for")
    effective = release.effective_schema(schema)
    short = pool_coverage(release, effective, pool, n).where(f"owed >= 1 AND ratio < {least_cover}")
    if named := [f"{r['cohort']} ({r['have']} rows for {r['owed']:.0f})" for r in short.orderBy("cohort").collect()]:
        said = f"the pool has too few rows for some cohorts: {', '.join(named)}"
        if not allow_short_pool:
            raise GenerationError(f"{said}; generate more or allow a short pool")
        warnings.warn(said, stacklevel=2)
    cells = pool_cells(effective, pool)
    weighed = _weighed(effective, release, cells, n, rounds)
    start = ((seed * 0x9E3779B9 + 1) % (1 << 32) + 0.5) / (1 << 32)
    groups, by = max(1, held // GROUP_ROWS), keys(effective)
    taken = systematic(cells, weighed, n, key, start, seed, groups)
    if refined:
        if isinstance(weighed, DataFrame):
            rows = cells.join(refined_tuples(effective, release, weighed, taken, n).where("_taken > 0").select(*by, "_taken"), by)
        else:
            drawn = taken.groupBy(*by).agg(F.count("*").alias("_taken")).toPandas()
            number = weighed.merge(drawn, on=by, how="left")["_taken"].fillna(0).to_numpy(int)
            t = weighed.assign(_taken=refine(weighed, objective(effective, release, weighed, n), number, n=n))
            small = pool.sparkSession.createDataFrame(t.loc[t["_taken"] > 0, [*by, "_taken"]])
            rows = _with_tuples(cells, small, by, len(t))
        taken = numbered(rows, uniform(F.col(key), seed), "_rank", by, [key], groups).where("_rank <= _taken").drop("_rank", "_taken")
    out = taken.select(pool.columns)
    return sub_bin_redraw(effective, release, out, key, seed) if sub_bin == "release" else out


def marginal_gap(schema: PublicSchema, a: DataFrame, b: DataFrame) -> float:
    """The mean total variation over all columns."""
    return counts.marginal_tv(schema, a, b).agg(F.avg("tv")).first()[0]
