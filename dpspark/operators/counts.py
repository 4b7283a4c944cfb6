"""Exact counts over public domains. Nothing here adds noise, and nothing here may be published.

All histograms of all cohorts and classes are one scan and one partial
aggregation; so are all conditional levels. What a task sends on is bounded by
the public domain, not by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dpspark import domains
from dpspark.functions import binning
from dpspark.schema import MISSING, PublicSchema

POSITIVE, NEGATIVE = "pos", "neg"


def _places(schema: PublicSchema, of) -> Column:
    """For each feature a struct (col, bin): numbers by ``of``, categories by their place in the declared list."""
    parts = []
    for c in schema.numerical:
        parts.append(F.struct(F.lit(c).alias("col"), of(F.col(c), schema.edges(c)).alias("bin")))
    for c in schema.categorical:
        place = F.array_position(F.array(*(F.lit(v) for v in schema.levels(c))), F.col(c)) - 1
        parts.append(F.struct(F.lit(c).alias("col"), place.cast("int").alias("bin")))
    return F.array(*parts)


def class_column(schema: PublicSchema) -> Column:
    return F.when(schema.is_positive(), F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))


def cohort_counts(schema: PublicSchema, df: DataFrame) -> DataFrame:
    """(cohort, n, n_pos) of every public cohort, empty ones too."""
    seen = df.groupBy(domains.cohort_key(schema).alias("cohort")).agg(F.count("*").alias("n"), F.count_if(schema.is_positive()).alias("n_pos"))
    every = domains.cohort_frame(df.sparkSession, schema)
    zero = F.lit(0).cast("long")
    return every.join(seen, "cohort", "left").select("cohort", F.coalesce("n", zero).alias("n"), F.coalesce("n_pos", zero).alias("n_pos"))


def histograms(schema: PublicSchema, df: DataFrame) -> DataFrame:
    """(cohort, cls, col, kind, bin, label, n) of every cohort, class, feature and bin of the public domain."""
    spark = df.sparkSession
    rows = df.select(domains.cohort_key(schema).alias("cohort"), class_column(schema).alias("cls"), F.explode(_places(schema, binning.histogram)).alias("p"))
    seen = rows.select("cohort", "cls", "p.col", "p.bin").where("bin >= 0").groupBy("cohort", "cls", "col", "bin").agg(F.count("*").alias("n"))
    classes = domains.frame(spark, [(POSITIVE,), (NEGATIVE,)], "cls string")
    every = domains.cohort_frame(spark, schema).crossJoin(classes).crossJoin(domains.value_frame(spark, schema))
    return every.join(seen, ["cohort", "cls", "col", "bin"], "left").select("cohort", "cls", "col", "kind", "bin", "label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def pooled(hist: DataFrame) -> DataFrame:
    """Histograms of cohorts, over both classes."""
    return hist.groupBy("cohort", "col", "kind", "bin", "label").agg(F.sum("n").alias("n"))


def level_counts(schema: PublicSchema, df: DataFrame) -> DataFrame:
    """(level, cell, n, n_pos) of every cell of every conditional level: one scan by grouping sets."""
    spark = df.sparkSession
    used = list(dict.fromkeys(c for level in schema.conditional for c in level))
    keyed = df.select(*(domains.cell_part(schema, c).alias(f"k{i}") for i, c in enumerate(used)), schema.is_positive().alias("positive"))
    sets = [[F.col(f"k{used.index(c)}") for c in level] for level in schema.conditional]
    every = domains.cell_frame(spark, schema)
    if used:
        found = keyed.groupingSets(sets, *(F.col(f"k{i}") for i in range(len(used)))).agg(F.count("*").alias("n"), F.count_if("positive").alias("n_pos"), F.grouping_id().alias("gid"))
        level, cell = F.lit(-1), F.lit("")
        for i, columns in enumerate(schema.conditional):
            gid = sum(1 << (len(used) - 1 - j) for j, c in enumerate(used) if c not in columns)
            name = F.concat_ws(domains.JOIN, *(F.col(f"k{used.index(c)}") for c in columns)) if columns else F.lit(domains.EVERY)
            level, cell = F.when(F.col("gid") == gid, F.lit(i)).otherwise(level), F.when(F.col("gid") == gid, name).otherwise(cell)
        found = found.select(level.alias("level"), cell.alias("cell"), "n", "n_pos")
    else:
        found = keyed.agg(F.count("*").alias("n"), F.count_if("positive").alias("n_pos")).select(F.lit(0).alias("level"), F.lit(domains.EVERY).alias("cell"), "n", "n_pos")
    zero = F.lit(0).cast("long")
    return every.join(found, ["level", "cell"], "left").select("level", "cell", F.coalesce("n", zero).alias("n"), F.coalesce("n_pos", zero).alias("n_pos"))


def occupied(schema: PublicSchema, df: DataFrame, level: tuple[str, ...]) -> DataFrame:
    """(at, n, n_pos) of the cells of a level that have rows, by ``domains.cell_at``; the level is never listed."""
    # a filter on ``at`` would be pushed down and find every row's bins a second time
    keyed = df.where(domains.in_domain(schema, level)).select(domains.cell_at(schema, level).alias("at"), schema.is_positive().alias("positive"))
    return keyed.groupBy("at").agg(F.count("*").alias("n"), F.count_if("positive").alias("n_pos"))


def contingency(schema: PublicSchema, df: DataFrame) -> DataFrame:
    """(col, bin, n_pos, n_neg) of every feature; numbers by intervals, -1 for values that are in none."""
    rows = df.select(schema.is_positive().alias("positive"), F.explode(_places(schema, binning.interval)).alias("p"))
    seen = rows.groupBy("p.col", "p.bin").agg(F.count_if("positive").alias("n_pos"), F.count_if(~F.col("positive")).alias("n_neg"))
    every = domains.value_frame(df.sparkSession, schema).select("col", "bin")
    zero = F.lit(0).cast("long")
    return every.join(seen, ["col", "bin"], "full").select("col", "bin", F.coalesce("n_pos", zero).alias("n_pos"), F.coalesce("n_neg", zero).alias("n_neg"))


def mutual_information(table: DataFrame) -> DataFrame:
    """(col, mi) in nats of a contingency table, whose counts may be noised; nothing below 0 counts."""
    cells = table.select("col", "bin", F.posexplode(F.array(*(F.greatest(F.col(c).cast("double"), F.lit(0.0)) for c in ("n_pos", "n_neg")))).alias("cls", "n"))
    total, row, column = (F.sum("n").over(Window.partitionBy(*by)) for by in (["col"], ["col", "bin"], ["col", "cls"]))
    cells = cells.select("col", "n", total.alias("t"), row.alias("r"), column.alias("c"))
    part = F.when((F.col("n") > 0) & (F.col("t") > 0), F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("r") * F.col("c")))).otherwise(F.lit(0.0))
    return cells.groupBy("col").agg(F.sum(part).alias("mi"))


def coarse_groups(table: DataFrame, most: int = 4) -> DataFrame:
    """(col, bin, grp): a column's levels ranked by their rate, in at most ``most`` groups of equal size."""
    rate = F.col("n_pos") / F.greatest(F.col("n_pos") + F.col("n_neg"), F.lit(1))
    ranked = table.select("col", "bin", F.row_number().over(Window.partitionBy("col").orderBy(rate, "bin")).alias("rank"), F.count("*").over(Window.partitionBy("col")).alias("levels"))
    size = F.ceil(F.col("levels") / most)
    return ranked.select("col", "bin", F.when(F.col("levels") > most, F.concat(F.lit("g"), F.floor((F.col("rank") - 1) / size).cast("string"))).alias("grp"))


def rates(schema: PublicSchema, df: DataFrame, level: int) -> DataFrame:
    """(cell, n, rate) of one level's public cells; the rate of an empty cell is null."""
    one = PublicSchema(**{**schema.__dict__, "conditional": [schema.conditional[level]]})
    return level_counts(one, df).select("cell", "n", F.when(F.col("n") > 0, F.col("n_pos") / F.col("n")).alias("rate"))


def rates_of(schema: PublicSchema, df: DataFrame, columns: Sequence[str], cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, cell, n, rate) of the cells of ``cells`` (cell) that have rows: one aggregate, for any number of cells that are not asked for."""
    rows = df.select(*by, domains.cell_key(schema, tuple(columns)).alias("cell"), schema.is_positive().cast("double").alias("y"))
    return rows.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.avg("y").alias("rate")).join(F.broadcast(cells.select("cell").distinct()), "cell", "left_semi").select(*by, "cell", "n", "rate")


def _labels(schema: PublicSchema, df: DataFrame, target: bool, by: Sequence[str] = ()) -> DataFrame:
    """(by, col, value, n): each column's interval or category as text."""
    parts = [F.struct(F.lit(c).alias("col"), binning.interval(F.col(c), schema.edges(c)).cast("string").alias("value")) for c in schema.numerical]
    parts += [F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in [*schema.categorical, *([schema.target] if target else [])]]
    return df.select(*by, F.explode(F.array(*parts)).alias("p")).groupBy(*by, "p.col", "p.value").agg(F.count("*").alias("n"))


def variation(p: DataFrame, q: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, col, tv): half the sum of the differences of two tables (col, value, n) of counts; ``by`` are columns of ``p``, each value of which is held against ``q``."""
    share = lambda d, name, by=(): d.select(*by, "col", "value", (F.col("n") / F.sum("n").over(Window.partitionBy(*by, "col"))).alias(name))
    if by:
        # values that only q has differ by their whole share: what is left of 1
        both = share(p, "p", by).join(share(q, "q"), ["col", "value"], "left").join(q.select("col", F.lit(1.0).alias("all")).distinct(), "col", "left")
        met = F.coalesce("q", F.lit(0.0))
        return both.groupBy(*by, "col").agg(((F.sum(F.abs(F.col("p") - met)) + F.coalesce(F.max("all"), F.lit(0.0)) - F.sum(met)) / 2).alias("tv"))
    both = share(p, "p").join(share(q, "q"), ["col", "value"], "full")
    return both.groupBy("col").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tv"))


def marginal_tv(schema: PublicSchema, a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, col, tv) of every column, the target too; of each part of ``a`` if it has parts."""
    return variation(_labels(schema, a, True, by), _labels(schema, b, True), by)


def feature_shift(schema: PublicSchema, a: DataFrame, b: DataFrame) -> DataFrame:
    """(col, tv) of the categorical features."""
    only = PublicSchema(**{**schema.__dict__, "numerical": {}, "bins": {}, "bands": {}, "stratify": [], "conditional": [], "coarsen": {}})
    return variation(_labels(only, a, False), _labels(only, b, False))


def absent_categories(schema: PublicSchema, df: DataFrame) -> DataFrame:
    """(col, value) that are declared and do not occur."""
    rows = [(c, v) for c in schema.categorical for v in schema.levels(c)] + [(schema.target, str(schema.positive)), (schema.target, str(schema.negative))]
    declared = domains.frame(df.sparkSession, rows, "col string, value string")
    seen = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in [*schema.categorical, schema.target]))).alias("p")).select("p.*").distinct()
    return declared.join(seen, ["col", "value"], "left_anti")


def undeclared(schema: PublicSchema, df: DataFrame) -> DataFrame:
    """(col, n): rows whose category is not declared; for the curator."""
    found = [F.count_if(~F.col(c).isin(schema.levels(c)) | (F.col(c) == MISSING)).alias(c) for c in schema.categorical]
    return df.agg(*found).unpivot([], list(schema.categorical), "col", "n")


def emitted(schema: PublicSchema, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, cls, col, bin, n): what a generated table has of each bin, pool bins for numbers."""
    rows = df.select(*by, class_column(schema).alias("cls"), F.explode(_places(schema, binning.pool)).alias("p"))
    return rows.groupBy(*by, "cls", "p.col", "p.bin").agg(F.count("*").alias("n")).where("bin >= 0")


def capped(df: DataFrame, person: str, order: Sequence[str | Column], most: int) -> DataFrame:
    """At most ``most`` rows of each person, the first by ``order``: the privacy unit of ``most`` rows is then a fact."""
    rank = F.row_number().over(Window.partitionBy(person).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
