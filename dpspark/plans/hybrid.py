"""Correcting another tool's table: release conditional rates, relabel to them, measure what it gained."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpspark import domains
from dpspark.errors import CorrectionError, DomainTooLargeError
from dpspark.functions.draw import uniform
from dpspark.ledger import PARALLEL, PrivacyLedger, per_person
from dpspark.noise import Noise
from dpspark.operators import counts
from dpspark.operators.sampling import numbered
from dpspark.plans.release import COUNTS_SHARE, N_MIN, N_MIN_FLOOR, published
from dpspark.schema import PublicSchema

# Beyond these a marginal synthesiser is known not to finish.
MOST_COLUMNS, MANY_ROWS, MANY_ROWS_COLUMNS, MOST_WIDE, MOST_WIDE_COLUMNS, WIDE = 18, 50_000, 10, 5, 13, 8
WORTH = 0.02


@dataclass
class ConditionalTable:
    columns: tuple[str, ...]
    cells: dict[str, float]
    support: dict[str, int]
    epsilon: float
    audit: dict = field(default_factory=dict)

    def frame(self, spark) -> DataFrame:
        return domains.frame(spark, [(c, r, self.support[c]) for c, r in self.cells.items()], "cell string, rate double, support long")


def check_feasible(schema: PublicSchema, n_rows: int) -> dict:
    """Refuses a table that is too large for a marginal synthesiser."""
    columns = len(schema.columns)
    wide = sum(len(schema.edges(c)) - 1 >= WIDE for c in schema.numerical)
    if columns > MOST_COLUMNS:
        raise DomainTooLargeError(f"more than {MOST_COLUMNS} columns")
    if n_rows > MANY_ROWS and columns >= MANY_ROWS_COLUMNS:
        raise DomainTooLargeError(f"more than {MANY_ROWS} rows with {MANY_ROWS_COLUMNS} columns or more")
    if wide > MOST_WIDE and columns >= MOST_WIDE_COLUMNS:
        raise DomainTooLargeError(f"more than {MOST_WIDE} numbers of {WIDE} bins or more with {MOST_WIDE_COLUMNS} columns or more")
    return {"columns": columns, "rows": n_rows, "wide": wide, "domain": domains.domain_size(schema)}


def release_conditional_table(schema: PublicSchema, df: DataFrame, columns: tuple[str, ...], epsilon: float, n_min: int = N_MIN, seed: int | None = None, max_rows_per_person: int | None = None, acknowledge_vacuous_privacy_unit: bool = False) -> ConditionalTable:
    """The noised rate of every cell of the public domain with enough rows."""
    if n_min < N_MIN_FLOOR:
        raise CorrectionError(f"n_min has to be {N_MIN_FLOOR} at least")
    said = per_person(max_rows_per_person, epsilon, acknowledge_vacuous_privacy_unit) if max_rows_per_person else None
    noise, ledger = Noise(seed), PrivacyLedger(epsilon, max_rows_per_person=max_rows_per_person)
    one = replace(schema, conditional=[tuple(columns)], stratify=[], bands={})
    schema.validate(df)
    exact = {r["cell"]: (r["n"], r["n_pos"]) for r in counts.level_counts(one, schema.coerce(df)).collect()}
    cells = sorted(exact)
    scale = ledger.spend_all([(f"count[{c}]", (c,)) for c in cells], "count", COUNTS_SHARE * epsilon, 1.0, PARALLEL, "counts")
    support = {c: published(v, n_min) for c in cells if (v := exact[c][0] + noise.laplace(scale)) >= n_min}
    if not support:
        raise CorrectionError("no cell is large enough; the counts have been charged")
    scale = ledger.spend_all([(f"rate[{c}]", (c,)) for c in support], "count", (1 - COUNTS_SHARE) * epsilon, 1.0, PARALLEL, "rates")
    rates = {c: round(min(1.0, max(0.0, exact[c][1] + noise.laplace(scale)) / max(n, n_min)), 5) for c, n in support.items()}
    ledger.seal()
    audit = ledger.audit() | {"guarantee_void": noise.void}
    audit["warnings"] += [said] if said else []
    return ConditionalTable(tuple(columns), rates, support, epsilon, audit)


def relabelled(schema: PublicSchema, df: DataFrame, columns: tuple[str, ...], rates: DataFrame, key: str, seed: int, score: str | None = None) -> DataFrame:
    """``df`` with targets that meet the rates (cell, rate) in each cell, up to one row; cells without a rate keep theirs.

    How many rows are positive is rounded at random, without bias; which ones is
    random too, or by ``score``, a column.
    """
    cell = domains.cell_key(schema, columns)
    rows = df.withColumn("_cell", cell).join(F.broadcast(rates.select(F.col("cell").alias("_cell"), F.col("rate").alias("_rate"))), "_cell", "left")
    draw = uniform(F.col(key), f"{seed} row")
    rows = numbered(rows, 1 - F.col(score) if score else draw, "_place", ["_cell"], [draw, key], total="_total")
    exact = F.col("_rate") * F.col("_total")
    wanted = F.floor(exact) + F.when(uniform(F.col("_cell"), f"{seed} cell") < exact - F.floor(exact), 1).otherwise(0)
    label = F.when(F.col("_rate").isNull(), F.col(schema.target)).when(F.col("_place") <= wanted, F.lit(str(schema.positive))).otherwise(F.lit(str(schema.negative)))
    return rows.withColumn("_label", label).withColumn(schema.target, F.col("_label")).select(df.columns)


def relabel(schema: PublicSchema, synthetic: DataFrame, table: ConditionalTable, key: str, preserve_ranking: bool = False, seed: int = 0) -> DataFrame:
    if not preserve_ranking:
        return relabelled(schema, synthetic, table.columns, table.frame(synthetic.sparkSession), key, seed)
    from dpspark.operators.students import ranking_scores

    ranked = ranking_scores(schema, synthetic, key, seed)
    if ranked is None:  # the table's own target can't be told from its features: any order is as good
        return relabel(schema, synthetic, table, key, False, seed)
    rates = table.frame(synthetic.sparkSession)
    return relabelled(schema, synthetic.join(ranked, key), table.columns, rates, key, seed, "_score").select(synthetic.columns)


def conditional_error(schema: PublicSchema, df: DataFrame, columns: tuple[str, ...], rates: DataFrame) -> DataFrame:
    """(error): the mean distance of a table's rates from released ones (cell, rate), over cells that it has."""
    own = df.groupBy(domains.cell_key(schema, columns).alias("cell")).agg(F.avg(schema.is_positive().cast("double")).alias("own"))
    return own.join(F.broadcast(rates), "cell").agg(F.avg(F.abs(F.col("own") - F.col("rate"))).alias("error"))


def estimate_gain(schema: PublicSchema, before: DataFrame, after: DataFrame, table: ConditionalTable) -> dict:
    rates = table.frame(before.sparkSession)
    # a table without any of the released cells has no error: not a number, rather than a perfect 0
    error = [math.nan if (e := conditional_error(schema, d, table.columns, rates).first()[0]) is None else e for d in (before, after)]
    shift = counts.feature_shift(schema, before, after).agg(F.avg("tv")).first()[0] or 0.0
    return {"error_before": error[0], "error_after": error[1], "reduction": error[0] - error[1], "worth_it": error[0] - error[1] > WORTH, "feature_shift": shift}


def correct(schema: PublicSchema, private: DataFrame, synthetic: DataFrame, columns: tuple[str, ...], epsilon: float, key: str, n_min: int = N_MIN, seed: int | None = None, max_rows_per_person: int | None = None, acknowledge_vacuous_privacy_unit: bool = False, preserve_ranking: bool = False) -> tuple[DataFrame, ConditionalTable, dict]:
    """Release, relabel, and what it gained; ``key`` names the synthetic rows."""
    table = release_conditional_table(schema, private, columns, epsilon, n_min, seed, max_rows_per_person, acknowledge_vacuous_privacy_unit)
    out = relabel(schema, synthetic, table, key, preserve_ranking, seed or 0)
    return out, table, estimate_gain(schema, synthetic, out, table)
