"""A table's marginals and use for training, beside real samples and permuted ones of its size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpspark.operators import counts, sampling
from dpspark.operators.students import tstr
from dpspark.plans.selection import marginal_gap
from dpspark.schema import PublicSchema
from dpspark.sources.tables import kept


def spread(values: list[float]) -> dict[str, float]:
    """Mean, least and most of the draws that gave a number."""
    good = [v for v in values if not math.isnan(v)]
    return {"mean": sum(good) / len(good), "min": min(good), "max": max(good)} if good else dict.fromkeys(("mean", "min", "max"), float("nan"))


def draw_gaps(schema: PublicSchema, draws: DataFrame, holdout: DataFrame) -> dict[int, float]:
    """The mean total variation of every draw (``_draw``) from ``holdout``: one aggregate over all draws."""
    data = schema.coerce(draws, [sampling.DRAW])
    return {r[sampling.DRAW]: r["tv"] for r in counts.marginal_tv(schema, data, holdout, [sampling.DRAW]).groupBy(sampling.DRAW).agg(F.avg("tv").alias("tv")).collect()}


def evaluate(schema: PublicSchema, tables: dict[str, DataFrame], train: DataFrame, holdout: DataFrame, key: str, n: int | None = None, seed: int = 1000, reference_draws: int = 5, only: tuple[str, ...] = ("LR", "RF", "GBM")) -> dict:
    """Of each table: total variation from ``holdout``, absent categories, students' AUCs; and the same of references.

    ``key`` names the rows of ``train``, from which real samples of ``n`` rows
    are drawn, and again with their targets permuted.
    """
    holdout = schema.coerce(holdout).cache()
    n = n or min(d.count() for d in tables.values())
    out: dict = {"n": n, "tables": {}, "references": {}}
    for name, d in tables.items():
        data = schema.coerce(d)
        absent = [tuple(r) for r in counts.absent_categories(schema, data).collect()]
        out["tables"][name] = {"tv": marginal_gap(schema, data, holdout), "absent": absent, "auc": tstr(schema, data, holdout, seed, only)}
    drawn = kept(sampling.samples(train, key, n, [seed + i for i in range(reference_draws)]))
    for kind, data in (("real", drawn), ("permuted", kept(sampling.permuted(drawn, key, schema.target, 0, sampling.DRAW)))):
        gaps = draw_gaps(schema, data, holdout)
        draws = []
        for i in range(reference_draws):
            own = schema.coerce(data.where(F.col(sampling.DRAW) == seed + i).drop(sampling.DRAW))
            draws.append({"tv": gaps.get(seed + i, math.nan)} | tstr(schema, own, holdout, seed + i, only))
        out["references"][kind] = {m: spread([d[m] for d in draws]) for m in ("tv", *only)}
    holdout.unpersist()
    out["panel"] = {name: panel(t["auc"], out["references"]) for name, t in out["tables"].items()}
    return out


def panel(found: dict[str, float], references: dict) -> dict[str, dict]:
    """How each student reads beside the real samples, and which share of their advantage over permuted ones is there."""
    out = {}
    for m, value in found.items():
        real, low = references["real"][m], references["permuted"][m]
        gap = real["mean"] - low["mean"]
        if math.isnan(value) or math.isnan(real["mean"]):
            reading = "no reading"
        else:
            reading = "within" if real["min"] <= value <= real["max"] else "better" if value > real["max"] else "worse"
        out[m] = {"auc": value, "reading": reading, "gap": value - real["mean"], "share": (value - low["mean"]) / gap if gap > 0 else None}
    return out
