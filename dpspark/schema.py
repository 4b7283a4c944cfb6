"""The public schema of a private table: declared, checked, never inferred."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark.errors import DataValidationError, SchemaError

#: Stands for a category that is missing; no declared value may look like it.
MISSING = "\u0000missing"
DEFAULT_BINS = 10
#: Labels and categories that a validation report names at most.
NAMED = 20
_SPACE = r"^\s+|\s+$"


@dataclass(frozen=True)
class Band:
    """A half-open range [lo, hi) of a numeric column; a column's top band is closed."""

    name: str
    lo: float
    hi: float


@dataclass
class PublicSchema:
    """numerical: column to (lo, hi); categorical: column to values; conditional: levels, each a tuple of columns.

    stratify: columns whose values, or for numeric ones ``bands``, make up cohorts.
    coarsen: column to a map from values to groups, used in conditional cells.
    """

    name: str
    numerical: dict[str, tuple[float, float]]
    categorical: dict[str, list[str]]
    target: str
    positive: str
    negative: str
    bins: dict[str, list[float]] = field(default_factory=dict)
    stratify: list[str] = field(default_factory=list)
    bands: dict[str, list[Band]] = field(default_factory=dict)
    conditional: list[tuple[str, ...]] = field(default_factory=list)
    coarsen: dict[str, dict[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.numerical = {c: tuple(x) for c, x in self.numerical.items()}
        self.conditional = [tuple(x) for x in self.conditional]
        self.bands = {c: [b if isinstance(b, Band) else Band(**b) for b in x] for c, x in self.bands.items()}
        features = {*self.numerical, *self.categorical}
        if self.target in features:
            raise SchemaError("the target is also a feature")
        if both := self.numerical.keys() & self.categorical.keys():
            raise SchemaError(f"numeric and categorical at once: {sorted(both)}")
        if str(self.positive) == str(self.negative):
            raise SchemaError("the two target labels are the same")
        for c, (lo, hi) in self.numerical.items():
            if not lo < hi:
                raise SchemaError(f"{c}: the upper bound has to be above the lower one")
        for c, values in self.categorical.items():
            if not values or len({str(v) for v in values}) < len(values):
                raise SchemaError(f"{c}: categories have to be there, once each")
            if MISSING in values:
                raise SchemaError(f"{c}: a category is kept for missing values")
        for c, edges in self.bins.items():
            if c not in self.numerical:
                raise SchemaError(f"{c}: bins of a column that is not numeric")
            if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
                raise SchemaError(f"{c}: edges have to ascend, two at least")
            if (edges[0], edges[-1]) != tuple(self.numerical[c]):
                raise SchemaError(f"{c}: edges have to span the bounds")
        for c in self.stratify:
            if c not in features:
                raise SchemaError(f"{c}: stratified, but not declared")
            if c in self.numerical:
                bands, (lo, hi) = self.bands.get(c, []), self.numerical[c]
                ends = [lo, *(b.hi for b in bands)]
                if not bands or [b.lo for b in bands] != ends[:-1] or ends[-1] != hi or any(b.lo >= b.hi for b in bands):
                    raise SchemaError(f"{c}: bands have to tile the bounds")
        for level in self.conditional:
            if missing := [c for c in level if c not in features]:
                raise SchemaError(f"conditional columns that are not declared: {missing}")
        for c, groups in self.coarsen.items():
            if c not in self.categorical or not groups or not {str(v) for v in groups} <= {str(v) for v in self.categorical[c]}:
                raise SchemaError(f"{c}: a coarsening maps declared values of a categorical column")

    @property
    def features(self) -> list[str]:
        return [*self.numerical, *self.categorical]

    @property
    def columns(self) -> list[str]:
        return [*self.features, self.target]

    def edges(self, column: str) -> list[float]:
        if column in self.bins:
            return [float(e) for e in self.bins[column]]
        lo, hi = self.numerical[column]
        return [lo + (hi - lo) * i / DEFAULT_BINS for i in range(DEFAULT_BINS)] + [float(hi)]

    def levels(self, column: str, coarse: bool = False) -> list[str]:
        """A categorical column's public values; with ``coarse``, of their groups."""
        values = [str(v) for v in self.categorical[column]]
        groups = self.coarsen.get(column, {}) if coarse else {}
        return list(dict.fromkeys(str(groups.get(v, v)) for v in values))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    @classmethod
    def from_json(cls, text: str) -> PublicSchema:
        return cls(**json.loads(text))

    @classmethod
    def load(cls, path: str | Path) -> PublicSchema:
        """From a JSON document, or from ``SCHEMA`` in a Python file of the user's."""
        path = Path(path)
        if path.suffix == ".json":
            return cls.from_json(path.read_text(encoding="utf-8"))
        import runpy

        found = runpy.run_path(str(path)).get("SCHEMA")
        if not isinstance(found, cls):
            raise SchemaError(f"{path.name} defines no SCHEMA")
        return found

    def number(self, column: str) -> Column:
        """A numeric column's value, or null where it is none; never an error that shows it."""
        value = F.col(column).try_cast("double")
        return F.when(~F.isnan(value), value)

    def text(self, column: str) -> Column:
        return F.coalesce(F.regexp_replace(F.col(column).cast("string"), _SPACE, ""), F.lit(MISSING))

    def is_positive(self) -> Column:
        return self.text(self.target) == str(self.positive)

    def coerce(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``df``'s declared columns: numbers clipped to their bounds, text trimmed; rows without a number are left out. Those of ``keep`` stay as they are, in front."""
        numbers = [F.least(F.greatest(self.number(c), F.lit(float(lo))), F.lit(float(hi))).alias(c) for c, (lo, hi) in self.numerical.items()]
        # least and greatest skip nulls, so rows are filtered before they are clipped
        usable = df.where(" AND ".join(f"NOT isnan(try_cast(`{c}` AS double)) AND try_cast(`{c}` AS double) IS NOT NULL" for c in self.numerical) or "true")
        return usable.select(*keep, *numbers, *(self.text(c).alias(c) for c in self.categorical), self.text(self.target).alias(self.target))

    def _counts(self, df: DataFrame) -> dict:
        """All that validation asks of a table, in one job."""
        there = set(df.columns)
        labels = [str(self.positive), str(self.negative)]
        asked = [F.count("*").alias("rows")]
        if self.target in there:
            label = self.text(self.target)
            asked += [F.count_if(label == v).alias(f"label {i}") for i, v in enumerate(labels)] + [F.count_if(~label.isin(labels)).alias("label ?")]
        for c, (lo, hi) in self.numerical.items():
            if c in there:
                v = self.number(c)
                asked += [F.count_if(v.isNull()).alias(f"none {c}"), F.count_if((v < lo) | (v > hi)).alias(f"out {c}")]
        for c in self.categorical:
            if c in there:
                asked.append(F.count_if(~self.text(c).isin(self.levels(c))).alias(f"undeclared {c}"))
        return df.agg(*asked).first().asDict()

    def validate(self, df: DataFrame, strict: bool = True) -> dict:
        """For the curator's eyes only: rows, problems, warnings, ok. Raises all problems at once if ``strict``."""
        problems, warnings = [], []
        if missing := [c for c in self.columns if c not in df.columns]:
            problems.append(f"missing columns: {', '.join(missing)}")
        n = self._counts(df)
        if not n["rows"]:
            problems.append("the table is empty")
        elif "label ?" in n:
            here = [n["label 0"] > 0, n["label 1"] > 0]
            if n["label ?"]:
                problems.append(f"{self.target}: labels that are not declared")
            if not any(here):
                problems.append(f"{self.target}: neither declared label occurs")
            elif not all(here):
                problems.append(f"{self.target}: one class only")
        for c in self.numerical:
            if n["rows"] and n.get(f"none {c}") == n["rows"]:
                problems.append(f"{c}: no number at all")
            elif n.get(f"none {c}"):
                warnings.append(f"{c}: rows without a number will be left out")
            if n.get(f"out {c}"):
                warnings.append(f"{c}: values outside the bounds will be clipped")
        warnings += [f"{c}: categories that are not declared will not be counted" for c in self.categorical if n.get(f"undeclared {c}")]
        if problems and strict:
            raise DataValidationError("; ".join(problems))
        return {"n_rows": n["rows"], "problems": problems, "warnings": warnings, "ok": not problems, "counts": n}
