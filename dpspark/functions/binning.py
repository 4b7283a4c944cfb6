"""The five ways in which a number is put in a bin; each caller needs its own.

    name      interval            below       at the top  above       not a number
    cell      [a, b)              first       last        last        last
    histogram [a, b), top closed  none        last        none        none
    interval  (a, b], low closed  none        last        none        none
    pool      [a, b)              first       last        last        first
    band      [a, b), top closed  none        last        none        none

Bins are counted from 0; none is -1. All are sums of comparisons, so they stay
in generated code; of many edges only a logarithm is compared with. A NaN is
above everything to Spark: hence the guards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTSIDE = -1
#: Edges beyond which a value's place is found by halving their array: a sum of all comparisons would be too long for one method.
MANY = 32


def _steps(value: Column, edges: Sequence[float], above) -> Column:
    if len(edges) > MANY:
        ordered = F.array(*(F.lit(e) for e in sorted(map(float, edges))))
        halves = F.array(*(F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))))
        # beyond the last edge ``get`` is null, and so is the comparison
        return F.aggregate(halves, F.lit(0), lambda n, half: F.when(above(value, F.get(ordered, n + half - 1)), n + half).otherwise(n))
    total = F.lit(0)
    for e in edges:
        total = total + above(value, F.lit(float(e))).cast("int")
    return total


def _reached(v: Column, e: Column) -> Column:
    return v >= e


def _passed(v: Column, e: Column) -> Column:
    return v > e


def _no_number(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def _inside(value: Column, edges: Sequence[float], bins: Column) -> Column:
    within = ~_no_number(value) & (value >= float(edges[0])) & (value <= float(edges[-1]))
    return F.when(within, bins).otherwise(F.lit(OUTSIDE))


def cell(value: Column, edges: Sequence[float]) -> Column:
    return F.when(_no_number(value), F.lit(len(edges) - 2)).otherwise(_steps(value, edges[1:-1], _reached))


def histogram(value: Column, edges: Sequence[float]) -> Column:
    return _inside(value, edges, _steps(value, edges[1:-1], _reached))


def interval(value: Column, edges: Sequence[float]) -> Column:
    return _inside(value, edges, _steps(value, edges[1:-1], _passed))


def pool(value: Column, edges: Sequence[float]) -> Column:
    return F.when(_no_number(value), F.lit(0)).otherwise(_steps(value, edges[1:-1], _reached))


def band(value: Column, edges: Sequence[float]) -> Column:
    return histogram(value, edges)


def cell_label(column: str, edges: Sequence[float], i: int) -> str:
    """Rendered on the driver: the JVM writes %g another way."""
    return f"{column}[{edges[i]:g},{edges[i + 1]:g})"


def quota_label(edges: Sequence[float], i: int) -> str:
    return f"{edges[i]:g}-{edges[i + 1]:g}"
