"""Ranks, samples and permutations that repeat exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dpspark.functions.draw import uniform

#: Rows of a group within which ranks are taken, and the most groups.
GROUP_ROWS, GROUPS_MOST = 50_000, 1 << 20


def groups_of(df: DataFrame) -> int:
    return max(1, min(GROUPS_MOST, df.count() // GROUP_ROWS))


def numbered(df: DataFrame, order: Column, name: str, by: Sequence[str] = (), ties: Sequence[str | Column] | None = None, groups: int | None = None, total: str | None = None) -> DataFrame:
    """``df`` with its rank by ``order`` from 1, within each value of ``by``, without bringing all of its rows into one task.

    ``order`` is a number in [0, 1]: it is cut into ``groups`` (by default as
    many as the number of rows asks for), ranks are taken within these, and only
    the groups' sizes are summed up in one place. Equal numbers go by ``ties``, or
    by all columns. ``total``, if named, is the number of rows of the same ``by``.
    """
    groups = groups or groups_of(df)
    ties = df.columns if ties is None else ties
    if groups == 1:
        whole = Window.partitionBy(*by)
        ranked = df.withColumn("_order", order)
        out = {name: F.row_number().over(whole.orderBy("_order", *ties))} | ({total: F.count("*").over(whole)} if total else {})
        return ranked.withColumns(out).select(*(c for c in df.columns if c not in out), *out)
    place = F.greatest(F.lit(0), F.least(F.lit(groups - 1), F.floor(F.col("_order") * groups))).cast("int")
    grouped = df.withColumn("_order", order).withColumn("_group", place)
    sizes = grouped.groupBy(*by, "_group").agg(F.count("*").alias("_size"))
    whole = Window.partitionBy(*by)
    ahead = sizes.select("_group", *(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), (F.sum("_size").over(whole.orderBy("_group")) - F.col("_size")).alias("_ahead"), F.sum("_size").over(whole).alias("_total"))
    own = F.row_number().over(Window.partitionBy(*by, "_group").orderBy("_order", *ties))
    ranked = grouped.withColumn("_own", own).withColumnRenamed("_group", "_at")
    met = F.col("_at") == F.col("_group")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    out = {name: F.col("_own") + F.col("_ahead")} | ({total: F.col("_total")} if total else {})
    return ranked.join(ahead, met).withColumns(out).select(*(c for c in df.columns if c not in out), *out)


#: Ranges that a draw, which has 32 bits, is counted by at a time: its upper half, then the lower half within one range.
HALF = 1 << 16
DRAW = "_draw"


def samples(df: DataFrame, key: str, n: int, seeds: Sequence[int]) -> DataFrame:
    """For each seed (``_draw``) exactly ``n`` rows of ``df`` (or all), the smallest by a hash of ``key``: all samples together.

    Draws are counted by ranges, for all seeds in one scan. The rows below the
    range in which the n-th row lies are taken by a filter, and only rows of
    that range are put in order. Where a range has more than ``GROUP_ROWS``
    rows, its narrower ranges are counted in a second scan.
    """
    if n <= 0 or not seeds:
        return df.select(F.lit(0).alias(DRAW), "*").where("false")
    u = {s: uniform(F.col(key), s) for s in seeds}
    low, width, left, open_ = dict.fromkeys(seeds, 0.0), dict.fromkeys(seeds, 1.0), dict.fromkeys(seeds, n), list(dict.fromkeys(seeds))
    whole = []
    for _ in range(2):
        step = {s: width[s] / HALF for s in open_}
        at = F.array(*(F.struct(F.lit(s).alias("s"), F.when((u[s] >= low[s]) & (u[s] < low[s] + width[s]), F.floor((u[s] - low[s]) / step[s]).cast("int")).alias("k")) for s in open_))
        sizes: dict[int, list[tuple[int, int]]] = {s: [] for s in open_}
        for r in df.select(F.explode(at).alias("x")).select("x.*").where("k IS NOT NULL").groupBy("s", "k").count().collect():
            sizes[r["s"]].append((r["k"], r["count"]))
        again = []
        for s in open_:
            width[s] = step[s]
            for k, size in sorted(sizes[s]):
                if left[s] <= size:
                    low[s] += k * width[s]
                    if size > GROUP_ROWS:
                        again.append(s)
                    break
                left[s] -= size
            else:
                whole.append(s)
        open_ = again
        if not open_:
            break
    below = {s: F.lit(True) if s in whole else u[s] < low[s] for s in low}
    inside = {s: F.lit(False) if s in whole else (u[s] >= low[s]) & (u[s] < low[s] + width[s]) for s in low}
    met = F.array_compact(F.array(*(F.when(below[s] | inside[s], F.struct(F.lit(s).alias("s"), below[s].alias("sure"), u[s].alias("u"))) for s in low)))
    rows = df.withColumn("_met", F.explode(met)).select("*", F.col("_met.s").alias(DRAW), F.col("_met.sure").alias("_sure"), F.col("_met.u").alias("_u")).drop("_met")
    rank = F.row_number().over(Window.partitionBy(DRAW).orderBy("_u", key))
    room = F.create_map(*(x for s in low for x in (F.lit(s), F.lit(0 if s in whole else left[s]))))
    last = rows.where("NOT _sure").withColumn("_rank", rank).where(F.col("_rank") <= room[F.col(DRAW)])
    return rows.where("_sure").select(DRAW, *df.columns).unionByName(last.select(DRAW, *df.columns))


def simple_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (or all), the smallest by a hash of ``key``."""
    return samples(df, key, n, [seed]).drop(DRAW)


def permuted(df: DataFrame, key: str, column: str, seed: int, by: str | None = None) -> DataFrame:
    """``df`` with one column's values dealt out anew; with ``by``, a whole number, within each of its values, by ``seed`` plus that number."""
    groups, parts = groups_of(df), [] if by is None else [by]
    text = F.lit(str(seed)) if by is None else (F.col(by) + seed).cast("string")
    rows = numbered(df, uniform(F.col(key), F.concat(text, F.lit(" rows"))), "_rank", parts, df.columns, groups)
    values = numbered(df.select(key, column, *parts), uniform(F.col(key), F.concat(text, F.lit(" values"))), "_rank", parts, [key, column], groups).select("_rank", *parts, F.col(column).alias("_value"))
    return rows.drop(column).join(values, ["_rank", *parts]).withColumnRenamed("_value", column).select(df.columns)


def largest_remainder(df: DataFrame, by: list[str], exact: str, total: Column, ties: Column, name: str) -> DataFrame:
    """Whole numbers that sum to ``total`` in each group of ``by``: the floors, and one more for the largest remainders."""
    base, group = F.floor(F.col(exact)), Window.partitionBy(*by)
    rank = F.row_number().over(group.orderBy(F.desc(F.col(exact) - base), ties))
    return df.withColumn(name, (base + F.when(rank <= total - F.sum(base).over(group), 1).otherwise(0)).cast("long"))


def split(df: DataFrame, key: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts, the first of about ``share`` of the rows, by a hash of ``key``."""
    first = uniform(F.col(key), seed) < share
    return df.where(first), df.where(~first)


def stratified_split(df: DataFrame, key: str, share: float, stratum: Column, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts; of every stratum the first has exactly its share, rounded to whole rows. Which rows is by a hash of ``key``."""
    ranked = numbered(df.withColumn("_stratum", stratum), uniform(F.col(key), seed), "_rank", ["_stratum"], total="_total")
    first = F.col("_rank") <= F.round(F.lit(share) * F.col("_total"))
    return ranked.where(first).select(df.columns), ranked.where(~first).select(df.columns)
