"""A conditional hierarchy for a schema that declares none, from one noised contingency job.

Which columns and how many cells are considered depends on the public domain and
on the caller's public numbers only, never on what the table happens to hold.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame

from dpspark.ledger import SEQUENTIAL, PrivacyLedger
from dpspark.noise import Noise
from dpspark.operators import counts
from dpspark.schema import Band, PublicSchema

# Fixed values of the derivation.
FRACTION_LEAST, FRACTION_MOST = 0.05, 0.30
GROUPS, NOISE_FLOOR, COHORTS = 4, 1.0, 3
PER_CELL_LEAST, PER_CELL_AIM = 8, 20


@dataclass
class DerivedConfig:
    schema: PublicSchema
    epsilon: float
    ranked: list[tuple[str, float]]
    chosen: tuple[str, ...]

    def record(self) -> dict:
        return {"epsilon": self.epsilon, "ranked": [list(x) for x in self.ranked], "chosen": list(self.chosen), "coarsen": self.schema.coarsen, "stratify": self.schema.stratify, "bands": {c: [asdict(b) for b in x] for c, x in self.schema.bands.items()}}


def _mutual_information(table: list[tuple[float, float]]) -> float:
    import math

    cells = [[max(0.0, x) for x in row] for row in table]
    total = sum(map(sum, cells))
    if total <= 0:
        return 0.0
    column = [sum(row[j] for row in cells) for j in (0, 1)]
    return sum(x / total * math.log(x * total / (sum(row) * column[j])) for row in cells for j, x in enumerate(row) if x > 0)


def fraction(schema: PublicSchema, n_records: int) -> float:
    """The share of epsilon that the choice may cost."""
    sizes = sorted(_public_levels(schema, c) for c in schema.features)
    middle = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
    return min(FRACTION_MOST, max(FRACTION_LEAST, len(sizes) * middle * 2 / max(1, n_records)))


def _public_levels(schema: PublicSchema, column: str) -> int:
    return len(schema.edges(column)) - 1 if column in schema.numerical else len(schema.levels(column))


def bands(schema: PublicSchema, column: str) -> list[Band]:
    """At most three bands of a numeric column, cut at its declared edges."""
    edges = schema.edges(column)
    n = min(COHORTS, len(edges) - 1)
    cuts = [edges[round(i * (len(edges) - 1) / n)] for i in range(n + 1)]
    return [Band(f"{column}{i}", a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def derive(schema: PublicSchema, data: DataFrame, epsilon: float, n_records: int = 1000, n_min: int = 150, selection_fraction: float | None = None, ledger: PrivacyLedger | None = None, noise: Noise | None = None) -> DerivedConfig:
    """Ranks features by noised mutual information with the target, and takes prefixes that leave about 20 records a cell.

    ``data`` is coerced. ``n_records`` is public: how many records the caller
    means to make, and how many the table is said to have.
    """
    share = selection_fraction or fraction(schema, n_records)
    spent = share * epsilon
    ledger, noise = ledger or PrivacyLedger(epsilon), noise or Noise()
    # a row is in one cell of each feature's table: the queries are charged as one
    scale = ledger.spend("autoconfig: conditional-column selection", "contingency", spent, float(len(schema.features)), SEQUENTIAL)
    tables: dict[str, dict[int, tuple[float, float]]] = {c: {} for c in schema.features}
    for r in counts.contingency(schema, data).collect():
        if r["bin"] is not None and r["bin"] >= 0:
            tables[r["col"]][r["bin"]] = r["n_pos"] + noise.laplace(scale), r["n_neg"] + noise.laplace(scale)
    ranked, coarsen = [], {}
    for c, cells in tables.items():
        rows = [cells[i] for i in sorted(cells)]
        if n_records / (2 * len(rows)) < NOISE_FLOOR * scale:
            continue  # the noise in a cell would be as large as what it is said to hold
        ranked.append((c, _mutual_information(rows)))
        if c in schema.categorical and len(rows) > GROUPS:
            order = sorted(range(len(rows)), key=lambda i: (max(0.0, rows[i][0]) / max(1.0, sum(max(0.0, x) for x in rows[i])), i))  # noqa: B023
            each = -(-len(rows) // GROUPS)
            coarsen[c] = {schema.levels(c)[i]: f"g{k // each}" for k, i in enumerate(order)}
    ranked.sort(key=lambda x: (-x[1], x[0]))
    effective, total, best = n_records / COHORTS, 1, None
    for k, (c, _) in enumerate(ranked, 1):
        total *= min(_public_levels(schema, c), GROUPS) if c in coarsen else _public_levels(schema, c)
        each = effective / total
        if each < PER_CELL_LEAST and k > 1:
            break
        if best is None or abs(each - PER_CELL_AIM) < best[0]:
            best = abs(each - PER_CELL_AIM), k
        if each < PER_CELL_LEAST:
            break
    chosen = tuple(c for c, _ in ranked[: best[1]]) if best else ()
    numeric = next((c for c, _ in ranked if c in schema.numerical), None)
    cut = {numeric: bands(schema, numeric)} if numeric and n_records / COHORTS >= n_min else {}
    new = replace(schema, conditional=[chosen[:k] for k in range(len(chosen) + 1)], coarsen={c: g for c, g in coarsen.items() if c in chosen}, stratify=list(cut), bands=cut)
    return DerivedConfig(new, spent, ranked, chosen)
