"""The privacy ledger: every scale of noise comes from it, and it never lends.

Within a group, sequential queries add up, and parallel ones cost as much as the
most expensive lineage: a partition key is a tuple, and a query on a part of it
concerns everything below. Groups add up.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpspark.errors import AccountingError

TOLERANCE = 1e-9
#: A person's epsilon above this says next to nothing.
VACUOUS = 10.0
SEQUENTIAL, PARALLEL = "sequential", "parallel"

WHAT_THIS_IS = "An account of the noise that was asked for and drawn. It is no proof of a guarantee: that rests on the declared schema, the privacy unit and the code."
CAVEATS = (
    "Noise is drawn in floating point; the discrete mechanism is there where that matters.",
    "One row is one unit unless the most rows of a person are declared.",
    "Neighbouring tables differ by one added or removed unit.",
    "What is derived from the data outside the ledger is not covered.",
)


@dataclass(frozen=True)
class Query:
    name: str
    kind: str
    epsilon: float
    sensitivity: float
    composition: str
    partition: tuple[str, ...]
    group: str
    scale: float
    at: str


def _cost(queries: list[Query]) -> float:
    """Of one group."""
    total = sum(q.epsilon for q in queries if q.composition == SEQUENTIAL)
    own: dict[tuple[str, ...], float] = defaultdict(float)
    for q in queries:
        if q.composition == PARALLEL:
            own[q.partition] += q.epsilon
    lineage = [sum(own.get(key[:k], 0.0) for k in range(len(key) + 1)) for key in own]
    return total + max(lineage, default=0.0)


class PrivacyLedger:
    """epsilon: the budget; max_rows_per_person: the declared privacy unit, None if it was not declared."""

    def __init__(self, epsilon: float, delta: float = 0.0, max_rows_per_person: int | None = None):
        if not epsilon > 0:
            raise AccountingError("epsilon has to be positive")
        if delta:
            raise AccountingError("only pure differential privacy is accounted for: delta is 0")
        if max_rows_per_person is not None and (not isinstance(max_rows_per_person, int) or isinstance(max_rows_per_person, bool) or max_rows_per_person < 1):
            raise AccountingError("max_rows_per_person is a whole number of 1 or more, or None")
        self.epsilon, self.unit = float(epsilon), max_rows_per_person
        self.queries: list[Query] = []
        self.sealed = False
        self._groups: dict[str, list[Query]] = defaultdict(list)
        self._costs: dict[str, float] = {}

    def spend(self, name: str, kind: str, epsilon: float, sensitivity: float = 1.0, composition: str = SEQUENTIAL, partition: tuple[str, ...] = (), group: str = "") -> float:
        """Charges one query and returns the scale of its noise, or refuses and charges nothing."""
        return self.spend_all([(name, partition)], kind, epsilon, sensitivity, composition, group)

    def spend_all(self, named: list[tuple[str, tuple[str, ...]]], kind: str, epsilon: float, sensitivity: float = 1.0, composition: str = PARALLEL, group: str = "") -> float:
        """Charges queries of one kind, (name, partition) each, and returns their common scale."""
        if self.sealed:
            raise AccountingError("the ledger is sealed")
        if not epsilon > 0 or not sensitivity > 0:
            raise AccountingError("epsilon and sensitivity have to be positive")
        if composition not in (SEQUENTIAL, PARALLEL):
            raise AccountingError(f"there is no {composition} composition")
        at, scale = datetime.now(UTC).isoformat(), sensitivity / epsilon
        new = [Query(n, kind, float(epsilon), float(sensitivity), composition, tuple(p), group or n, scale, at) for n, p in named]
        costs = dict(self._costs)
        for g in {q.group for q in new}:
            costs[g] = _cost([*self._groups.get(g, []), *(q for q in new if q.group == g)])
        if sum(costs.values()) > self.epsilon + TOLERANCE:
            raise AccountingError("the query would go beyond the budget")
        for q in new:
            self.queries.append(q)
            self._groups[q.group].append(q)
        self._costs = costs
        return scale

    def total(self) -> float:
        return sum(self._costs.values())

    def seal(self) -> None:
        self.sealed = True

    def assert_within_budget(self) -> None:
        if self.total() > self.epsilon + TOLERANCE:
            raise AccountingError("more was spent than there was")

    def audit(self) -> dict:
        groups = {}
        for name, queries in self._groups.items():
            by: dict[str, float] = defaultdict(float)
            for q in queries:
                if q.composition == PARALLEL:
                    by["/".join(q.partition)] += q.epsilon
            sequential = sum(q.epsilon for q in queries if q.composition == SEQUENTIAL)
            groups[name] = {"sequential_sum": sequential, "parallel_by_partition": dict(by), "parallel_cost": _cost(queries) - sequential, "group_total": _cost(queries), "n_partitions": len(by), "n_queries": len(queries)}
        unit = self.unit
        return {
            "_what_this_is": WHAT_THIS_IS, "caveats": list(CAVEATS), "epsilon_budget": self.epsilon, "epsilon_accounted": self.total(), "delta": 0.0,
            "max_rows_per_person": unit, "epsilon_per_person": None if unit is None else unit * self.total(),
            "warnings": [] if unit else ["the most rows of a person were not declared: the account is per row"],
            "groups": groups, "queries": [asdict(q) | {"partition": list(q.partition)} for q in self.queries],
        }

    def write_audit(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.audit(), indent=1), encoding="utf-8")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, q.name, q.kind, q.epsilon, q.sensitivity, q.composition, "/".join(q.partition), q.group, q.scale, q.at) for i, q in enumerate(self.queries)]
        return spark.createDataFrame(rows, "seq int, name string, kind string, epsilon double, sensitivity double, composition string, partition string, grp string, noise_scale double, ts string")


def lineages(entries: DataFrame) -> DataFrame:
    """(grp, partition, own, cost) of every parallel partition: its own epsilon, and that of its lineage.

    A partition's parents are its prefixes up to a ``/``, and the empty one. Each
    partition is sent to its parents' sums, so that no two partitions meet that
    are not kin.
    """
    own = entries.where(F.col("composition") == PARALLEL).groupBy("grp", "partition").agg(F.sum("epsilon").alias("own"))
    parts = F.split("partition", "/")
    line = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    asked = own.select("grp", "partition", "own", F.explode(line).alias("parent"))
    above = own.select("grp", F.col("partition").alias("parent"), F.col("own").alias("part"))
    return asked.join(above, ["grp", "parent"]).groupBy("grp", "partition").agg(F.first("own").alias("own"), F.sum("part").alias("cost"))


def audit_rollup(entries: DataFrame) -> DataFrame:
    """(grp, sequential_sum, parallel_cost, group_total, n_partitions, n_queries) of ledger rows (epsilon, composition, partition, grp)."""
    most = lineages(entries).groupBy("grp").agg(F.max("cost").alias("parallel_cost"), F.count("*").alias("n_partitions"))
    sequential = F.sum(F.when(F.col("composition") == SEQUENTIAL, F.col("epsilon")).otherwise(0.0))
    rows = entries.groupBy("grp").agg(sequential.alias("sequential_sum"), F.count("*").alias("n_queries")).join(most, "grp", "left")
    cost = F.coalesce("parallel_cost", F.lit(0.0))
    return rows.select("grp", "sequential_sum", cost.alias("parallel_cost"), (F.col("sequential_sum") + cost).alias("group_total"), F.coalesce("n_partitions", F.lit(0).cast("long")).alias("n_partitions"), "n_queries")


def ledger_total(entries: DataFrame) -> DataFrame:
    """(total) of ledger rows (epsilon, composition, partition, grp): what its groups cost together."""
    return audit_rollup(entries).agg(F.coalesce(F.sum("group_total"), F.lit(0.0)).alias("total"))


def per_person(most_rows: int, epsilon: float, acknowledged: bool) -> str | None:
    """Refuses a vacuous privacy unit, or returns the warning that goes with an acknowledged one."""
    if most_rows * epsilon <= VACUOUS:
        return None
    text = f"at up to {most_rows} rows a person, epsilon is above {VACUOUS:g} for a person: that is next to no protection"
    if not acknowledged:
        raise AccountingError(text)
    return text


Draw = Callable[[float], float]
