"""Column helpers for operators that are DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _sums(a: Column) -> Column:
    """0 and the running sums of an array of long."""
    return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def before(a: Column) -> Column:
    """For each element of a non-empty array of long, the sum of those before it; by blocks, so that no step copies a long array."""

    def joined(sums: Column) -> Column:
        bases = _sums(F.transform(sums, lambda s: F.element_at(s, -1)))
        return let(bases, lambda b: F.flatten(F.transform(sums, lambda s, i: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x + F.get(b, i)))))

    blocks = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: _sums(F.slice(a, b * _BLOCK + 1, _BLOCK)))
    return let(blocks, joined)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern that never matches the empty string: array of (start, text, part), in code points from 0.

    What lies between the matches and the matches themselves, by turns, make up the text.
    """
    split, every = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else every

    def placed(m: Column) -> Column:
        sizes = F.transform(F.sequence(F.lit(0), F.size(m.every) - 1), lambda i: (F.length(F.get(m.split, i)) + F.when(i > 0, F.length(F.get(m.every, i - 1))).otherwise(0)).cast("long"))
        # the sum before a match leaves out its own gap
        return let(sizes, lambda s: let(before(s), lambda b: F.transform(m.every, lambda x, i: F.struct((F.get(b, i) + F.get(s, i)).alias("start"), x.alias("text"), F.get(m.parts, i).alias("part")))))

    none = F.array().cast("array<struct<start: long, text: string, part: string>>")
    matches = let(F.struct(split.alias("split"), every.alias("every"), parts.alias("parts")), placed)
    return F.when(text.rlike(pattern), matches).otherwise(none)
