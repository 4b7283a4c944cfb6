"""From raw tables to one table of a schema: joins by a key, value maps, cut labels, ranges and bounds. All of it is one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark.errors import SchemaError


def joined(tables: Sequence[DataFrame], keys: Sequence[str | Sequence[str]]) -> DataFrame:
    """Inner joins of the first table with the others in turn, each by its key. A null key meets nothing."""
    if len(tables) != len(keys) + 1:
        raise SchemaError("every table but the first is joined by one key")
    return reduce(lambda a, b: a.join(b[0], [b[1]] if isinstance(b[1], str) else list(b[1])), zip(tables[1:], keys, strict=True), tables[0])


def number(column: str | Column) -> Column:
    """A value as a number, or null where it is none."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(value), value)


def value_map(column: str | Column, values: Mapping) -> Column:
    """The label of a code; null for codes without one."""
    value = F.col(column) if isinstance(column, str) else column
    if not values:
        return F.lit(None).cast("string")
    out = None
    for code, label in values.items():
        out = F.when(value == F.lit(code), F.lit(label)) if out is None else out.when(value == F.lit(code), F.lit(label))
    return out


def cut(column: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the interval (a, b] that a number is in; null outside of all of them."""
    if len(edges) != len(labels) + 1 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise SchemaError("intervals need ascending edges, one more than labels")
    value = number(column)
    out = F.when(value <= float(edges[0]), F.lit(None).cast("string"))
    for b, label in zip(edges[1:], labels, strict=True):
        out = out.when(value <= float(b), F.lit(label))
    return out


def pulled_up(raw: DataFrame, columns: Mapping[str, Column], within: Mapping[str, tuple[float, float]] | None = None, bounds: Mapping[str, tuple[float, float]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``columns`` of ``raw``, after ``keep``: rows outside ``within`` go, numbers are clipped to ``bounds``, rows with a null go."""
    rows = raw.select(*keep, *(c.alias(name) for name, c in columns.items()))
    for name, (lo, hi) in (within or {}).items():
        rows = rows.where(F.col(name).between(lo, hi))
    clipped = {name: F.when(F.col(name).isNotNull(), F.least(F.greatest(F.col(name), F.lit(float(lo))), F.lit(float(hi)))) for name, (lo, hi) in (bounds or {}).items()}
    return rows.withColumns(clipped).dropna(subset=list(columns)) if clipped else rows.dropna(subset=list(columns))
