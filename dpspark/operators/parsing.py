"""Rows out of generated text, and which of them are rows of the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark.schema import PublicSchema

#: Of the columns, so many have to be in the header.
LEAST_HEADER = 0.7


def normalised(value: Column) -> Column:
    """A category as text: trimmed, whole floats without their fraction, null if empty."""
    text = F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
    whole = text.rlike(r"^-?\d+\.0+$")
    number = F.regexp_replace(F.regexp_replace(text, r"\.0+$", ""), r"^(-?)0+(?=\d)", "$1")
    return F.nullif(F.when(whole, F.when(number == "-0", F.lit("0")).otherwise(number)).otherwise(text), F.lit(""))


def parsed(responses: DataFrame, schema: PublicSchema, text: str = "response", key: str = "response_id") -> DataFrame:
    """Rows (key, line, columns as text) of CSV in responses, with or without fences; lines of another width are left out.

    The first line that names 70 % of the columns is the header; fields go by its
    names. A field in double quotes may hold commas, two quotes inside stand for one.
    """
    names = schema.columns
    lines = responses.select(key, F.posexplode(F.split(F.regexp_replace(text, r"(?m)^\s*```.*$", ""), r"\r?\n")).alias("line", "raw")).where("trim(raw) <> ''")
    # a comma goes before each field, the first one too, which may be empty
    field = r',(?:\s*"((?:[^"]|"")*)"\s*|([^,]*))'
    plain = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "raw"), F.lit(field), F.lit(0)), lambda f: F.regexp_replace(f, "^,", ""))
    fields = F.transform(plain, lambda f: F.when(f.rlike(r'^\s*".*"\s*$'), F.replace(F.regexp_extract(f, r'^\s*"(.*)"\s*$', 1), F.lit('""'), F.lit('"'))).otherwise(f))
    split = lines.select(key, "line", fields.alias("fields"))
    trimmed = F.transform("fields", lambda f: F.trim(f))
    known = F.size(F.array_intersect(trimmed, F.array(*map(F.lit, names))))
    heads = split.where(known >= max(1, LEAST_HEADER * len(names))).groupBy(key).agg(F.min(F.struct("line", trimmed.alias("names"))).alias("head"))
    rows = split.join(heads, key).where((F.col("line") > F.col("head.line")) & (F.size("fields") == F.size("head.names")))
    place = lambda c: F.array_position("head.names", F.lit(c)).cast("int")
    return rows.select(key, "line", *(F.when(place(c) > 0, F.nullif(F.trim(F.get("fields", place(c) - 1)), F.lit(""))).alias(c) for c in names))


def checks(schema: PublicSchema) -> dict[str, Column]:
    """Why a row is turned down, in order: the first that holds counts."""
    labels = [str(schema.positive), str(schema.negative)]
    out = {"label": ~F.coalesce(normalised(F.col(schema.target)).isin(labels), F.lit(False))}
    none, outside = F.lit(False), F.lit(False)
    for c, (lo, hi) in schema.numerical.items():
        v = schema.number(c)
        none, outside = none | v.isNull(), outside | ~v.between(float(lo), float(hi))
    out["number"] = none
    undeclared = F.lit(False)
    for c in schema.categorical:
        undeclared = undeclared | ~F.coalesce(normalised(F.col(c)).isin(schema.levels(c)), F.lit(False))
    return out | {"category": undeclared, "bounds": F.coalesce(outside, F.lit(True))}


def validated(rows: DataFrame, schema: PublicSchema) -> DataFrame:
    """``rows`` with ``reason``: why a row is turned down, or null; numbers as numbers, categories as written in the schema."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(checks(schema).items()):
        reason = F.when(bad, F.lit(name)).otherwise(reason)
    typed = {c: schema.number(c) for c in schema.numerical} | {c: normalised(F.col(c)) for c in [*schema.categorical, schema.target]}
    return rows.withColumn("reason", reason).withColumns(typed)
