"""Public domains: every cohort and cell that is asked about, whether or not a row falls in it."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dpspark.errors import DomainTooLargeError
from dpspark.functions import binning
from dpspark.schema import PublicSchema

#: Cells of a level that are listed; of a larger one only the occupied and the released ones are.
MOST_CELLS = 1_000_000
ALL, JOIN, EVERY = "all", " & ", "*"


def _refuse_large(n: int, what: str) -> None:
    if n > MOST_CELLS:
        raise DomainTooLargeError(f"{what}: {n} combinations are more than {MOST_CELLS}; coarsen a column")


def _cohort_parts(schema: PublicSchema, column: str) -> list[str]:
    return [b.name for b in schema.bands[column]] if column in schema.numerical else schema.levels(column)


def cohorts(schema: PublicSchema) -> list[str]:
    """Names of the cohorts, in order."""
    if not schema.stratify:
        return [ALL]
    parts = [_cohort_parts(schema, c) for c in schema.stratify]
    n = 1
    for p in parts:
        n *= len(p)
    _refuse_large(n, "cohorts")
    return sorted(JOIN.join(x) for x in product(*parts))


def cohort_key(schema: PublicSchema) -> Column:
    """A row's cohort; outside all bands its part is ``oob``."""
    if not schema.stratify:
        return F.lit(ALL)
    parts = []
    for c in schema.stratify:
        if c in schema.numerical:
            bands = schema.bands[c]
            at = binning.band(F.col(c), [bands[0].lo, *(b.hi for b in bands)])
            part = F.lit("oob")
            for i, b in enumerate(bands):
                part = F.when(at == i, F.lit(b.name)).otherwise(part)
        else:
            part = F.col(c)
        parts.append(part)
    return F.concat_ws(JOIN, *parts)


def cell_parts(schema: PublicSchema, column: str) -> list[str]:
    """Labels of a column's bins or groups in conditional cells."""
    if column in schema.numerical:
        edges = schema.edges(column)
        return [binning.cell_label(column, edges, i) for i in range(len(edges) - 1)]
    return [f"{column}={v}" for v in schema.levels(column, coarse=True)]


def cells(schema: PublicSchema, level: tuple[str, ...]) -> list[str]:
    """Names of a level's cells, in order; the empty level has one."""
    if not level:
        return [EVERY]
    parts = [cell_parts(schema, c) for c in level]
    n = 1
    for p in parts:
        n *= len(p)
    _refuse_large(n, "cells")
    return sorted(JOIN.join(x) for x in product(*parts))


def level_size(schema: PublicSchema, level: tuple[str, ...]) -> int:
    """Cells of a level."""
    n = 1
    for c in level:
        n *= len(schema.edges(c)) - 1 if c in schema.numerical else len(schema.levels(c, coarse=True))
    return n


def cell_at(schema: PublicSchema, level: tuple[str, ...]) -> Column:
    """A row's cell as a whole number below ``level_size``; null where it is not ``in_domain``."""
    at = F.lit(0).cast("long")
    for c in level:
        if c in schema.numerical:
            edges = schema.edges(c)
            n, place = len(edges) - 1, binning.cell(F.col(c), edges)
        else:
            values = schema.levels(c, coarse=True)
            n, place = len(values), F.array_position(F.array(*map(F.lit, values)), _coarse(schema, c)) - 1
            place = F.when(place >= 0, place)
        at = at * n + place
    return at


def in_domain(schema: PublicSchema, level: tuple[str, ...]) -> Column:
    """Whether a row has a cell: each category is a public one. Numbers always are in a bin."""
    inside = F.lit(True)
    for c in level:
        if c not in schema.numerical:
            inside = inside & _coarse(schema, c).isin(schema.levels(c, coarse=True))
    return inside


def cell_name(schema: PublicSchema, level: tuple[str, ...], at: int) -> str:
    """The name of a cell by its number."""
    names = []
    for c in reversed(level):
        parts = cell_parts(schema, c)
        at, k = divmod(at, len(parts))
        names.append(parts[k])
    return JOIN.join(reversed(names)) or EVERY


def _coarse(schema: PublicSchema, column: str) -> Column:
    """A category, or the group that it is coarsened to."""
    value = F.col(column)
    if groups := schema.coarsen.get(column):
        table = F.create_map(*(F.lit(str(x)) for pair in groups.items() for x in pair))
        value = F.coalesce(table[value], value)
    return value


def cell_part(schema: PublicSchema, column: str) -> Column:
    """A row's part of a cell's name for one column."""
    if column in schema.numerical:
        edges = schema.edges(column)
        labels = F.array(*(F.lit(binning.cell_label(column, edges, i)) for i in range(len(edges) - 1)))
        return F.get(labels, binning.cell(F.col(column), edges))
    return F.concat(F.lit(f"{column}="), _coarse(schema, column))


def cell_key(schema: PublicSchema, level: tuple[str, ...]) -> Column:
    return F.concat_ws(JOIN, *(cell_part(schema, c) for c in level)) if level else F.lit(EVERY)


def domain_size(schema: PublicSchema) -> int:
    """Combinations of all bins, categories and the two labels."""
    n = 2
    for c in schema.numerical:
        n *= len(schema.edges(c)) - 1
    for c in schema.categorical:
        n *= len(schema.categorical[c])
    return n


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that the plan holds itself: one partition, no job."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields))


def cohort_frame(spark: SparkSession, schema: PublicSchema) -> DataFrame:
    return frame(spark, [(i, c) for i, c in enumerate(cohorts(schema))], "cohort_id int, cohort string")


def cell_frame(spark: SparkSession, schema: PublicSchema) -> DataFrame:
    """(level, cell) of every level."""
    rows = [(i, c) for i, level in enumerate(schema.conditional) for c in cells(schema, level)]
    return frame(spark, rows, "level int, cell string")


def value_frame(spark: SparkSession, schema: PublicSchema) -> DataFrame:
    """(col, kind, bin, label) of every feature's bins and categories."""
    rows = [(c, "numeric", i, binning.quota_label(schema.edges(c), i)) for c in schema.numerical for i in range(len(schema.edges(c)) - 1)]
    rows += [(c, "categorical", i, v) for c in schema.categorical for i, v in enumerate(schema.levels(c))]
    return frame(spark, rows, "col string, kind string, bin int, label string")
