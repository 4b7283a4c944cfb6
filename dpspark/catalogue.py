"""The registered queries of the engine and the SQL that they are held against.

Whatever is compared is deterministic: exact counts, or noise and draws by the
hash of a key, which both engines compute alike. Shares are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dpspark import domains, fixtures, ledger
from dpspark.fixtures import F1, F2, F4, F5
from dpspark.functions import binning
from dpspark.functions.draw import uniform
from dpspark.operators import counts, parsing, quota, sampling
from dpspark.plans import bound, hybrid, selection
from dpspark.plans.release import Release, mixture, numeric_block
from dpspark.schema import PublicSchema
from dpspark.sources import etl, tables

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

F2_SQL = f"(SELECT *, {fixtures.F2_Y} AS y FROM lineitem)"
F5_SQL = f"(SELECT *, {fixtures.F5_Y} AS y FROM orders)"
F4_SQL = "(SELECT doc_id, n_chars, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id))"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def r6(c: Column) -> Column:
    return F.round(c, 6)


# -- SQL text of what the column expressions say --------------------------------


def sql_steps(col: str, edges: Sequence[float], op: str = ">=") -> str:
    return "(" + (" + ".join(f"CAST({col} {op} CAST({e} AS DOUBLE) AS INT)" for e in edges) or "0") + ")"


def sql_inside(col: str, edges: Sequence[float], op: str) -> str:
    return f"CASE WHEN {col} >= {edges[0]} AND {col} <= {edges[-1]} THEN {sql_steps(col, edges[1:-1], op)} ELSE -1 END"


SQL_BIN = {
    "cell": lambda c, e: sql_steps(c, e[1:-1]),
    "histogram": lambda c, e: sql_inside(c, e, ">="),
    "interval": lambda c, e: sql_inside(c, e, ">"),
    "pool": lambda c, e: sql_steps(c, e[1:-1]),
    "band": lambda c, e: sql_inside(c, e, ">="),
}


def sql_values(rows: Sequence[tuple], names: str) -> str:
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({names}))"


def sql_cohort(schema: PublicSchema) -> str:
    (c,) = schema.stratify
    bands = schema.bands[c]
    cases = " ".join(f"WHEN {c} >= {b.lo} AND {c} {'<=' if b is bands[-1] else '<'} {b.hi} THEN '{b.name}'" for b in bands)
    return f"CASE {cases} ELSE 'oob' END"


def sql_cell(schema: PublicSchema, level: Sequence[str]) -> str:
    parts = []
    for c in level:
        if c in schema.numerical:
            edges = schema.edges(c)
            at = SQL_BIN["cell"](c, edges)
            parts.append(f"CASE {at} " + " ".join(f"WHEN {i} THEN '{binning.cell_label(c, edges, i)}'" for i in range(len(edges) - 1)) + " END")
        else:
            value = c
            if g := schema.coarsen.get(c):
                value = f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in g.items()) + f" ELSE {c} END"
            parts.append(f"'{c}=' || {value}")
    return " || ' & ' || ".join(f"({p})" for p in parts) or "'*'"


def sql_melt(schema: PublicSchema, table: str, kind: str, keys: str = "") -> str:
    """col and bin of every row and feature."""
    lead = f"{keys}, " if keys else ""
    parts = [f"SELECT {lead}'{c}' AS col, {SQL_BIN[kind](c, schema.edges(c))} AS bin FROM {table}" for c in schema.numerical]
    for c in schema.categorical:
        cases = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(schema.levels(c)))
        parts.append(f"SELECT {lead}'{c}' AS col, CASE {c} {cases} END AS bin FROM {table}")
    return "(" + " UNION ALL ".join(parts) + ")"


def sql_domain(schema: PublicSchema) -> str:
    rows = [(c, i) for c in schema.numerical for i in range(len(schema.edges(c)) - 1)] + [(c, i) for c in schema.categorical for i in range(len(schema.levels(c)))]
    return sql_values(rows, "col, bin")


def sql_uniform(key: str, seed: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}')), 1, 8)) AS BIGINT) / 4294967296.0)"


def sql_names(names: Sequence[str], column: str) -> str:
    return sql_values([(n,) for n in names], column)


# -- normalisation ----------------------------------------------------------------

NARROW = PublicSchema("lineitem, narrow", {"l_quantity": (5, 45), "l_discount": (0.02, 0.08)}, {"l_returnflag": ["A", "N", "R"]}, "l_linestatus", "O", "F")
STATUS = PublicSchema("order status", {"o_totalprice": (2000, 400000)}, {"o_orderpriority": F5.categorical["o_orderpriority"][:4]}, "o_orderstatus", "O", "F")


@query("SELECT least(greatest(l_quantity, 5), 45) AS l_quantity, least(greatest(l_discount, 0.02), 0.08)::DOUBLE AS l_discount, l_returnflag, l_linestatus FROM lineitem")
def coerce_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NARROW.coerce(fixtures.f1(spark, sf_dir))


@query(
    "SELECT unnest(['rows', 'label 0', 'label 1', 'label ?', 'none o_totalprice', 'out o_totalprice', 'undeclared o_orderpriority']) AS what, "
    "unnest([count(*), count_if(o_orderstatus = 'O'), count_if(o_orderstatus = 'F'), count_if(o_orderstatus NOT IN ('O', 'F')), count_if(o_totalprice IS NULL), "
    "count_if(o_totalprice < 2000 OR o_totalprice > 400000), count_if(o_orderpriority = '5-LOW')])::BIGINT AS n FROM orders"
)
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = STATUS.validate(fixtures.read(spark, sf_dir, "orders"), strict=False)["counts"]
    return domains.frame(spark, list(found.items()), "what string, n long")


def _binned(name: str) -> None:
    edges = {c: F1.edges(c) for c in ("l_quantity", "l_discount")}
    # values on both sides of the bounds too, and on them
    parts = " UNION ALL ".join(f"SELECT '{c}' AS col, {SQL_BIN[name]('v', e)} AS bin FROM (SELECT {c} AS v FROM lineitem UNION ALL SELECT {c} + 5 FROM lineitem UNION ALL SELECT {c} - 5 FROM lineitem)" for c, e in edges.items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, of = fixtures.f1(spark, sf_dir), getattr(binning, name)
        values = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), of(F.col(c) + d, e).alias("bin")) for c, e in edges.items() for d in (0, 5, -5))))
        return df.select(values.alias("p")).groupBy("p.col", "p.bin").agg(F.count("*").alias("n"))

    run.__name__ = f"binning_{name}"
    query(f"SELECT col, bin, count(*) AS n FROM ({parts}) GROUP BY col, bin")(run)


for _name in ("cell", "histogram", "interval", "pool", "band"):
    _binned(_name)


# -- counts over public domains -----------------------------------------------------


@query(
    f"SELECT d.cohort, count(k.cohort)::BIGINT AS n, coalesce(sum(k.p), 0)::BIGINT AS n_pos FROM {sql_names(domains.cohorts(F2), 'cohort')} d "
    f"LEFT JOIN (SELECT {sql_cohort(F2)} AS cohort, CAST(y = 'YES' AS INT) AS p FROM {F2_SQL}) k ON k.cohort = d.cohort GROUP BY d.cohort"
)
def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.cohort_counts(F2, F2.coerce(fixtures.f2(spark, sf_dir)))


def _sql_levels(schema: PublicSchema, table: str, positive: str) -> str:
    parts = []
    for i, level in enumerate(schema.conditional):
        seen = f"(SELECT {sql_cell(schema, level)} AS cell, CAST({positive} AS INT) AS p FROM {table})"
        parts.append(f"SELECT {i} AS level, d.cell, count(k.cell)::BIGINT AS n, coalesce(sum(k.p), 0)::BIGINT AS n_pos FROM {sql_names(domains.cells(schema, level), 'cell')} d LEFT JOIN {seen} k ON k.cell = d.cell GROUP BY d.cell")
    return " UNION ALL ".join(parts)


@query(_sql_levels(F2, F2_SQL, "y = 'YES'"))
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.level_counts(F2, F2.coerce(fixtures.f2(spark, sf_dir)))


@query(_sql_levels(F4, F4_SQL, "quality = 1"))
def coarsened_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.level_counts(F4, F4.coerce(fixtures.f4(spark, sf_dir)))


_HIST = f"""
SELECT c.cohort, k.cls, d.col, d.bin, count(s.bin)::BIGINT AS n
FROM {sql_names(domains.cohorts(F2), 'cohort')} c CROSS JOIN {sql_names([counts.POSITIVE, counts.NEGATIVE], 'cls')} k CROSS JOIN {sql_domain(F2)} d
LEFT JOIN {sql_melt(F2, F2_SQL, 'histogram', f"{sql_cohort(F2)} AS cohort, CASE WHEN y = 'YES' THEN 'pos' ELSE 'neg' END AS cls")} s
ON s.cohort = c.cohort AND s.cls = k.cls AND s.col = d.col AND s.bin = d.bin GROUP BY ALL"""


@query(_HIST)
def hist_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.histograms(F2, F2.coerce(fixtures.f2(spark, sf_dir))).select("cohort", "cls", "col", "bin", "n")


@query(f"SELECT cohort, col, bin, sum(n)::BIGINT AS n FROM ({_HIST}) GROUP BY ALL")
def hist_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.pooled(counts.histograms(F2, F2.coerce(fixtures.f2(spark, sf_dir)))).select("cohort", "col", "bin", "n")


@query(f"SELECT {sql_cohort(F2)} AS cohort, round(avg(CAST(y = 'YES' AS INT)), 6) AS pos_share FROM {F2_SQL} GROUP BY 1")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.cohort_counts(F2, F2.coerce(fixtures.f2(spark, sf_dir)))
    return found.select("cohort", r6(F.col("n_pos") / F.col("n")).alias("pos_share"))


@query(
    f"WITH h AS ({_HIST}), t AS (SELECT cohort, cls, col, bin, n / sum(n) OVER (PARTITION BY cohort, cls, col) AS p FROM h), "
    "w AS (SELECT cohort, sum(n) FILTER (cls = 'pos') / sum(n) AS w FROM h WHERE col = 'l_returnflag' GROUP BY cohort) "
    "SELECT cohort, col, bin, round(sum(p * CASE cls WHEN 'pos' THEN w ELSE 1 - w END), 6) AS share FROM t JOIN w USING (cohort) GROUP BY cohort, col, bin"
)
def pooled_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = counts.histograms(F2, F2.coerce(fixtures.f2(spark, sf_dir)))
    share = hist.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cohort", "cls", "col")))
    weight = hist.where("col = 'l_returnflag'").groupBy("cohort").agg((F.sum(F.when(F.col("cls") == "pos", F.col("n")).otherwise(0)) / F.sum("n")).alias("w"))
    mixed = share.join(F.broadcast(weight), "cohort").groupBy("cohort", "col", "bin")
    return mixed.agg(r6(F.sum(F.col("p") * F.when(F.col("cls") == "pos", F.col("w")).otherwise(1 - F.col("w")))).alias("share"))


def _sql_centres(schema: PublicSchema) -> str:
    return sql_values([(c, i, (a + b) / 2) for c in schema.numerical for i, (a, b) in enumerate(zip(schema.edges(c), schema.edges(c)[1:], strict=False))], "col, bin, centre")


@query(
    f"WITH p AS (SELECT cohort, col, bin, sum(n) AS n FROM ({_HIST}) GROUP BY ALL), s AS (SELECT cohort, col, centre, n / sum(n) OVER (PARTITION BY cohort, col) AS share FROM p JOIN {_sql_centres(F2)} USING (col, bin)), "
    "m AS (SELECT cohort, col, sum(share * centre) AS mean FROM s GROUP BY ALL) "
    "SELECT cohort, col, round(any_value(mean), 6) AS mean, round(sqrt(sum(share * (centre - mean) * (centre - mean))), 6) AS std FROM s JOIN m USING (cohort, col) GROUP BY cohort, col"
)
def hist_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = counts.pooled(counts.histograms(F2, F2.coerce(fixtures.f2(spark, sf_dir))))
    rows = [(c, i, (a + b) / 2) for c in F2.numerical for i, (a, b) in enumerate(zip(F2.edges(c), F2.edges(c)[1:], strict=False))]
    share = hist.join(F.broadcast(domains.frame(spark, rows, "col string, bin int, centre double")), ["col", "bin"]).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cohort", "col")))
    found = share.groupBy("cohort", "col").agg(F.sum(F.col("share") * F.col("centre")).alias("m"), F.sum(F.col("share") * F.col("centre") ** 2).alias("q"))
    return found.select("cohort", "col", r6(F.col("m")).alias("mean"), r6(F.sqrt(F.greatest(F.col("q") - F.col("m") ** 2, F.lit(0.0)))).alias("std"))


_CONTINGENCY = f"""
SELECT d.col, d.bin, coalesce(sum(s.p), 0)::BIGINT AS n_pos, coalesce(sum(1 - s.p), 0)::BIGINT AS n_neg
FROM {sql_domain(F2)} d LEFT JOIN {sql_melt(F2, F2_SQL, 'interval', "CAST(y = 'YES' AS INT) AS p")} s ON s.col = d.col AND s.bin = d.bin GROUP BY d.col, d.bin"""
_MI = f"""
WITH c AS (SELECT col, bin, unnest([0, 1]) AS cls, unnest([n_pos, n_neg]) AS n FROM ({_CONTINGENCY})),
t AS (SELECT col, n, sum(n) OVER (PARTITION BY col) AS t, sum(n) OVER (PARTITION BY col, bin) AS r, sum(n) OVER (PARTITION BY col, cls) AS k FROM c)
SELECT col, round(sum(CASE WHEN n > 0 THEN n / t * ln(n * t / (r::DOUBLE * k)) ELSE 0 END), 6) AS mi FROM t GROUP BY col"""


@query(_CONTINGENCY)
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.contingency(F2, F2.coerce(fixtures.f2(spark, sf_dir)))


@query(_MI)
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.mutual_information(counts.contingency(F2, F2.coerce(fixtures.f2(spark, sf_dir)))).select("col", r6(F.col("mi")).alias("mi"))


@query(f"SELECT col, rank FROM (SELECT col, (row_number() OVER (ORDER BY mi DESC, col))::INT AS rank FROM ({_MI})) WHERE rank <= 2")
def top_k_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    mi = counts.mutual_information(counts.contingency(F2, F2.coerce(fixtures.f2(spark, sf_dir)))).withColumn("mi", r6(F.col("mi")))
    return mi.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mi"), "col"))).where("rank <= 2").select("col", "rank")


@query(
    f"WITH c AS (SELECT d.col, d.bin, coalesce(sum(s.p), 0) AS a, coalesce(sum(1 - s.p), 0) AS b FROM {sql_domain(F4)} d LEFT JOIN {sql_melt(F4, F4_SQL, 'interval', 'quality AS p')} s ON s.col = d.col AND s.bin = d.bin GROUP BY d.col, d.bin), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY a / greatest(a + b, 1), bin) AS rank, count(*) OVER (PARTITION BY col) AS levels FROM c WHERE col IN ('lang', 'source')) "
    "SELECT col, bin, CASE WHEN levels > 4 THEN 'g' || CAST(floor((rank - 1) / ceil(levels / 4)) AS BIGINT) END AS grp FROM k"
)
def coarsen_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.coarse_groups(counts.contingency(F4, F4.coerce(fixtures.f4(spark, sf_dir))).where("col <> 'n_chars' AND bin >= 0"))


@query(f"SELECT {sql_cell(F2, ('l_returnflag', 'l_linestatus'))} AS cell, count(*)::BIGINT AS n, round(avg(CAST(y = 'YES' AS INT)), 6) AS rate FROM {F2_SQL} GROUP BY 1")
def cell_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.rates(F2, F2.coerce(fixtures.f2(spark, sf_dir)), 2).select("cell", "n", r6(F.col("rate")).alias("rate"))


@query(
    f"SELECT CASE WHEN y = 'YES' THEN 'pos' ELSE 'neg' END AS cls, col, bin, count(*)::BIGINT AS n FROM {sql_melt(F2, F2_SQL, 'pool', 'y')} GROUP BY ALL"
)
def emitted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.emitted(F2, F2.coerce(fixtures.f2(spark, sf_dir)))


# -- noise, with draws by hash: the tests' mechanism, the release's arithmetic ----------

SCALE, N_MIN = 20.0, 150


def _fixed_noise(key: Column, scale: float) -> Column:
    u = uniform(key, "noise") - 0.5
    return -F.lit(scale) * F.signum(u) * F.log1p(-2 * F.abs(u))


def _sql_noise(key: str, scale: float) -> str:
    u = f"({sql_uniform(key, 'noise')} - 0.5)"
    return f"(-{scale} * sign({u}) * ln(1 - 2 * abs({u})))"


@query(f"WITH h AS ({_HIST}), z AS (SELECT *, greatest(n + {_sql_noise('''concat_ws('/', cohort, cls, col, CAST(bin AS VARCHAR))''', SCALE)}, 0) AS v FROM h) SELECT cohort, cls, col, bin, round(CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 1.0 / count(*) OVER w END, 5) AS share FROM z WINDOW w AS (PARTITION BY cohort, cls, col)")
def noisy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = counts.histograms(F2, F2.coerce(fixtures.f2(spark, sf_dir)))
    noisy = hist.withColumn("v", F.greatest(F.col("n") + _fixed_noise(F.concat_ws("/", "cohort", "cls", "col", F.col("bin").cast("string")), SCALE), F.lit(0.0)))
    w = Window.partitionBy("cohort", "cls", "col")
    total = F.sum("v").over(w)
    return noisy.select("cohort", "cls", "col", "bin", F.round(F.when(total > 0, F.col("v") / total).otherwise(1.0 / F.count("*").over(w)), 5).alias("share"))


@query(
    f"WITH l AS ({_sql_levels(F2, F2_SQL, '''y = 'YES' ''')}), z AS (SELECT *, n + {_sql_noise('cell', SCALE)} AS v FROM l) "
    f"SELECT level, cell, greatest({N_MIN}, round_even(v, 0))::BIGINT AS support, round(least(1, greatest(0, n_pos) / greatest({N_MIN}, round_even(v, 0))), 5) AS rate FROM z WHERE v >= {N_MIN}"
)
def noisy_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.level_counts(F2, F2.coerce(fixtures.f2(spark, sf_dir))).withColumn("v", F.col("n") + _fixed_noise(F.col("cell"), SCALE)).where(F.col("v") >= N_MIN)
    support = F.greatest(F.lit(N_MIN).cast("long"), F.bround("v", 0).cast("long"))
    return found.select("level", "cell", support.alias("support"), F.round(F.least(F.lit(1.0), F.col("n_pos") / support), 5).alias("rate"))


#: A ledger of real cells: a count for each flag and status, below it one for each quantity, and one query on every ship date's month.
_LEDGER = (
    "(SELECT 0.01 * (1 + count(*) % 7) AS epsilon, 'parallel' AS composition, l_returnflag || '/' || l_linestatus AS partition, 'marginals' AS grp FROM lineitem GROUP BY l_returnflag, l_linestatus "
    "UNION ALL SELECT 0.001 * (1 + count(*) % 5), 'parallel', l_returnflag || '/' || l_linestatus || '/' || CAST(CAST(l_quantity AS INT) AS {text}), 'marginals' FROM lineitem GROUP BY l_returnflag, l_linestatus, CAST(l_quantity AS INT) "
    "UNION ALL SELECT 0.002, 'parallel', l_returnflag, 'marginals' FROM lineitem GROUP BY l_returnflag "
    "UNION ALL SELECT 0.003, 'parallel', '', 'marginals' FROM (SELECT count(*) FROM lineitem) "
    "UNION ALL SELECT 0.0001 * (1 + count(*) % 3), 'parallel', 'q' || CAST(CAST(l_quantity AS INT) AS {text}), 'counts' FROM lineitem GROUP BY CAST(l_quantity AS INT) "
    "UNION ALL SELECT 0.0005, 'sequential', '', 'discounts' FROM lineitem GROUP BY l_discount UNION ALL SELECT 0.0007, 'sequential', '', 'marginals' FROM lineitem GROUP BY l_tax)"
)
_LINEAGE = (
    f"WITH l AS {_LEDGER.format(text='VARCHAR')}, p AS (SELECT grp, partition, sum(epsilon) AS own FROM l WHERE composition = 'parallel' GROUP BY ALL), "
    "m AS (SELECT a.grp, a.partition, sum(b.own) AS cost FROM p a JOIN p b ON a.grp = b.grp AND (a.partition = b.partition OR starts_with(a.partition, b.partition || '/') OR b.partition = '') GROUP BY ALL), "
    "g AS (SELECT grp, round(coalesce(sum(epsilon) FILTER (composition = 'sequential'), 0), 6)::DOUBLE AS sequential_sum, round(coalesce((SELECT max(cost) FROM m WHERE m.grp = l.grp), 0), 6)::DOUBLE AS parallel_cost, "
    "(SELECT count(*) FROM p WHERE p.grp = l.grp)::BIGINT AS n_partitions, count(*)::BIGINT AS n_queries FROM l GROUP BY grp) "
)


def _ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LEDGER.format(text="STRING").replace("lineitem", "{lines}")[1:-1], lines=fixtures.f1(spark, sf_dir))


@query(f"{_LINEAGE} SELECT round(sum(sequential_sum + parallel_cost), 6)::DOUBLE AS total FROM g")
def ledger_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_total(_ledger_rows(spark, sf_dir)).select(r6(F.col("total")).alias("total"))


@query(f"{_LINEAGE} SELECT *, round(sequential_sum + parallel_cost, 6)::DOUBLE AS group_total FROM g")
def ledger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.audit_rollup(_ledger_rows(spark, sf_dir)).select("grp", *(r6(F.col(c)).alias(c) for c in ("sequential_sum", "parallel_cost", "group_total")), "n_partitions", "n_queries")


# -- quotas -----------------------------------------------------------------------------


@query(
    f"WITH s AS (SELECT {sql_cohort(F2)} AS cohort, count(*) AS size FROM {F2_SQL} GROUP BY 1), e AS (SELECT cohort, 997 * size::DOUBLE / sum(size) OVER () AS exact FROM s) "
    "SELECT cohort, (floor(exact) + CAST(row_number() OVER (ORDER BY exact - floor(exact) DESC, cohort) <= 997 - sum(floor(exact)) OVER () AS INT))::BIGINT AS rows FROM e"
)
def allocate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = counts.cohort_counts(F2, F2.coerce(fixtures.f2(spark, sf_dir))).select("cohort", F.col("n").alias("size"))
    return quota.allocated(sizes, 997)


@query(
    f"WITH h AS ({_HIST}), e AS (SELECT cohort, cls, col, bin, n / sum(n) OVER (PARTITION BY cohort, cls, col) * 25 AS exact FROM h) "
    "SELECT cohort, cls, col, bin, (floor(exact) + CAST(row_number() OVER (w ORDER BY exact - floor(exact) DESC, bin) <= 25 - sum(floor(exact)) OVER w AS INT))::BIGINT AS quota FROM e WINDOW w AS (PARTITION BY cohort, cls, col)"
)
def batch_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = counts.histograms(F2, F2.coerce(fixtures.f2(spark, sf_dir)))
    shares = hist.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cohort", "cls", "col")))
    return quota.quotas(shares, ["cohort", "cls", "col"], F.lit(25), F.col("bin")).select("cohort", "cls", "col", "bin", "quota")


# -- rows of generated text ---------------------------------------------------------------

#: Orders as a model would write them, 50 ids to an answer: some lines of another width, some cells quoted, some values that the schema doesn't know.
_PRICE = "CASE o_orderkey % 13 WHEN 3 THEN 'x' WHEN 4 THEN '999999999' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS {text}) END"
_PRIORITY = "CASE o_orderkey % 17 WHEN 5 THEN '9-NONE' ELSE o_orderpriority END"
_LABEL = "CASE o_orderkey % 19 WHEN 6 THEN '' WHEN 7 THEN 'MAYBE' ELSE y END"
_LINE = f"CASE WHEN o_orderkey % 11 = 0 THEN 'a line of another width' WHEN o_orderkey % 7 = 0 THEN concat({_LABEL}, ', \"', {_PRIORITY}, '\", ', {_PRICE}) ELSE concat_ws(',', {_LABEL}, {_PRIORITY}, {_PRICE}) END"
_PARSED = (
    f"(SELECT CAST(o_orderkey // 50 AS BIGINT) AS response_id, {_PRICE.format(text='VARCHAR')} AS o_totalprice, {_PRIORITY} AS o_orderpriority, nullif({_LABEL}, '') AS y FROM {F5_SQL} WHERE o_orderkey % 11 <> 0)"
)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fixtures.f5(spark, sf_dir).select("o_orderkey", F.expr(_LINE.format(text="STRING")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x.line), "\n")
    return orders.groupBy(F.expr("o_orderkey DIV 50").alias("response_id")).agg(F.concat(F.lit("Here they are\n```csv\ny,o_orderpriority,o_totalprice\n"), body, F.lit("\n```")).alias("response"))


@query(f"SELECT * FROM {_PARSED}")
def csv_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parsed(_answers(spark, sf_dir), F5).drop("line")


@query(
    "SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN coalesce(y, '') NOT IN ('YES', 'NO') THEN 'label' WHEN try_cast(o_totalprice AS DOUBLE) IS NULL THEN 'number' "
    f"WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') THEN 'category' WHEN try_cast(o_totalprice AS DOUBLE) NOT BETWEEN 1000 AND 500000 THEN 'bounds' END AS reason FROM {_PARSED}) GROUP BY reason"
)
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.validated(parsing.parsed(_answers(spark, sf_dir), F5), F5).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "SELECT value, count(*)::BIGINT AS n FROM (SELECT CASE WHEN regexp_full_match(t, '-?[0-9]+\\.0+') THEN CAST(CAST(CAST(t AS DOUBLE) AS BIGINT) AS VARCHAR) WHEN t = '' THEN NULL ELSE t END AS value "
    "FROM (SELECT regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT unnest([CAST(l_linenumber AS VARCHAR) || '.0', ' ' || l_returnflag || ' ', '00' || CAST(l_linenumber AS VARCHAR) || '.00', '-0.0', '']) AS x FROM lineitem))) GROUP BY value"
)
def normalise_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, flag = F.col("l_linenumber").cast("string"), F.col("l_returnflag")
    raw = F.array(F.concat(n, F.lit(".0")), F.concat(F.lit(" "), flag, F.lit(" ")), F.concat(F.lit("00"), n, F.lit(".00")), F.lit("-0.0"), F.lit(""))
    return fixtures.f1(spark, sf_dir).select(F.explode(raw).alias("x")).groupBy(parsing.normalised(F.col("x")).alias("value")).agg(F.count("*").alias("n"))


# -- a table out of raw ones -----------------------------------------------------------------

SEGMENTS = {"BUILDING": "works", "MACHINERY": "works", "AUTOMOBILE": "cars", "HOUSEHOLD": "home"}
OUTCOMES = {"F": "YES", "O": "NO"}
BALANCES = ([-0.01, 1000.0, 4000.0, 7000.0, 9000.0], ["low", "fair", "good", "high"])
LIMITS = {"price": (5000.0, 300000.0)}


def _sql_map(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query(
    f"SELECT * FROM (SELECT o_orderkey, least(greatest(o_totalprice, 5000), 300000)::DOUBLE AS price, {_sql_map('c_mktsegment', SEGMENTS)} AS segment, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 3 THEN 'north' END AS area, "
    "CASE WHEN c_acctbal <= -0.01 THEN NULL WHEN c_acctbal <= 1000 THEN 'low' WHEN c_acctbal <= 4000 THEN 'fair' WHEN c_acctbal <= 7000 THEN 'good' WHEN c_acctbal <= 9000 THEN 'high' END AS balance, "
    f"{_sql_map('o_orderstatus', OUTCOMES)} AS outcome FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_totalprice BETWEEN 2000 AND 450000) "
    "WHERE segment IS NOT NULL AND area IS NOT NULL AND balance IS NOT NULL AND outcome IS NOT NULL"
)
def demo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region = (fixtures.read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    raw = etl.joined([orders.withColumnRenamed("o_custkey", "c_custkey"), customer.withColumnRenamed("c_nationkey", "n_nationkey"), nation.withColumnRenamed("n_regionkey", "r_regionkey"), region], ["c_custkey", "n_nationkey", "r_regionkey"])
    columns = {"price": etl.number("o_totalprice"), "segment": etl.value_map("c_mktsegment", SEGMENTS), "area": etl.value_map("r_regionkey", {0: "south", 1: "west", 3: "north"}), "balance": etl.cut("c_acctbal", *BALANCES), "outcome": etl.value_map("o_orderstatus", OUTCOMES)}
    return etl.pulled_up(raw, columns, {"price": (2000, 450000)}, LIMITS, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderpriority, round(o_totalprice, 6)::DOUBLE AS o_totalprice, CASE o_orderkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'a, \"b\"' ELSE '' END AS note FROM orders")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV to shared storage and read again: words for nothing, quotes and empty cells stay what they are."""
    note = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'a, \"b\"' ELSE '' END")
    path = f"{tables.shared_path(spark)}.csv"
    tables.write_table(fixtures.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", note.alias("note")), path)
    back = tables.read_table(spark, path, ["note", "o_totalprice", "o_orderpriority", "o_orderkey"])
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", r6(F.col("o_totalprice").cast("double")).alias("o_totalprice"), "note")


# -- selection ----------------------------------------------------------------------------


def small_release(schema: PublicSchema = F5) -> Release:
    """A release made by hand, so that what follows from one can be compared."""
    def block(p: list[float], q: list[float]) -> dict:
        return {"numerical": {"o_totalprice": numeric_block(p, schema.edges("o_totalprice"), schema.numerical["o_totalprice"])}, "categorical": {"o_orderpriority": dict(zip(schema.levels("o_orderpriority"), q, strict=True))}}

    small = block([0.6, 0.4, 0, 0], [0.3, 0.3, 0.2, 0.2, 0]), block([0.5, 0.5, 0, 0], [0.1, 0.2, 0.3, 0.2, 0.2])
    cohorts = [
        {"cohort_id": 1, "cohort_name": "small", "cohort_size": 400, "class_balance": {"YES": 0.4, "NO": 0.6}, "by_class": {"YES": small[0], "NO": small[1]}, **mixture(schema, 0.4, *small)},
        {"cohort_id": 0, "cohort_name": "large", "cohort_size": 600, "class_balance": {"YES": 0.5, "NO": 0.5}, **block([0, 0, 0.4, 0.6], [0.2] * 5)},
    ]
    cells = {f"o_orderpriority={v}": {"rate": r, "support": 200} for v, r in zip(schema.levels("o_orderpriority"), (0.7, 0.4, 0.3, 0.3, 0.25), strict=True)}
    stratify = [["o_totalprice", [b.__dict__ for b in schema.bands["o_totalprice"]]]]
    return Release(schema.name, 2.0, 150, cohorts, [{"level": 0, "columns": ["o_orderpriority"], "cells": cells}], {}, stratify)


#: A cell of the table's own release has this share of the rows at least.
CELL_SHARE = 0.2
#: Rows that a rate is over at least; what a positive row of the line items is.
FLOORED, IS_YES = 2500, "y = 'YES'"


def table_release(spark: SparkSession, sf_dir: str) -> Release:
    """The orders' own counts in the form of a release: no noise, for comparison only."""
    data = F5.coerce(fixtures.f5(spark, sf_dir))
    labels = {counts.POSITIVE: "YES", counts.NEGATIVE: "NO"}
    hist: dict = {}
    for r in counts.histograms(F5, data).collect():
        hist.setdefault((r["cohort"], labels[r["cls"]]), {}).setdefault(r["col"], []).append((r["bin"], r["label"], r["n"]))
    cohorts = []
    for i, r in enumerate(counts.cohort_counts(F5, data).orderBy("cohort").collect()):
        if r["n"]:
            size = {"YES": r["n_pos"], "NO": r["n"] - r["n_pos"]}
            blocks = {}
            for v, n in size.items():
                shares = {c: [(label, k / max(n, 1)) for _, label, k in sorted(x)] for c, x in hist[r["cohort"], v].items()}
                blocks[v] = {"numerical": {c: {"bin_edges": F5.edges(c), "proportions": [p for _, p in shares[c]]} for c in F5.numerical}, "categorical": {c: dict(shares[c]) for c in F5.categorical}}
            pooled = {
                "numerical": {c: {"bin_edges": F5.edges(c), "proportions": [sum(size[v] * blocks[v]["numerical"][c]["proportions"][k] for v in size) / r["n"] for k in range(len(F5.edges(c)) - 1)]} for c in F5.numerical},
                "categorical": {c: {x: sum(size[v] * blocks[v]["categorical"][c][x] for v in size) / r["n"] for x in F5.levels(c)} for c in F5.categorical},
            }
            cohorts.append({"cohort_id": i, "cohort_name": r["cohort"], "cohort_size": r["n"], "class_balance": {v: n / r["n"] for v, n in size.items()}, "by_class": blocks, **pooled})
    total = sum(c["cohort_size"] for c in cohorts)
    cells = {r["cell"]: {"rate": r["n_pos"] / r["n"], "support": r["n"]} for r in counts.level_counts(F5, data).orderBy("cell").collect() if r["n"] >= CELL_SHARE * total}
    stratify = [["o_totalprice", [b.__dict__ for b in F5.bands["o_totalprice"]]]]
    return Release(F5.name, 2.0, 150, cohorts, [{"level": 0, "columns": ["o_orderpriority"], "cells": cells}], {}, stratify)


TAKEN = 500


@query(
    f"SELECT cohort, owed::DOUBLE AS owed, count(c)::BIGINT AS have, round(count(c) / owed, 6)::DOUBLE AS ratio FROM {sql_values([('small', 200.0), ('large', 300.0)], 'cohort, owed')} LEFT JOIN (SELECT {sql_cohort(F5)} AS c FROM {F5_SQL}) ON c = cohort GROUP BY cohort, owed"
)
def pool_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pool_coverage(small_release(), F5, F5.coerce(fixtures.f5(spark, sf_dir)), TAKEN).withColumn("ratio", r6(F.col("ratio")))


def _rake_targets() -> tuple[list, list, dict[str, list]]:
    """What ``small_release`` asks of the sums of weights: rows of (cohort, target), (cohort, cls, target) and, by column, (cohort, k, b, target)."""
    release, total = small_release(), 1000
    cohort, balance, hist = [], [], {c: [] for c in F5.features}
    for c in release.cohorts:
        mass, name = TAKEN * c["cohort_size"] / total, c["cohort_name"]
        cohort.append((name, mass))
        balance += [(name, k, mass * c["class_balance"][v]) for k, v in ((1, "YES"), (0, "NO"))]
        for k, v in ((1, "YES"), (0, "NO")):
            b, m, key = (c["by_class"][v], mass * c["class_balance"][v], k) if "by_class" in c else (c, mass, -1)
            hist["o_totalprice"] += [(name, key, i, m * p) for i, p in enumerate(b["numerical"]["o_totalprice"]["proportions"])] if key >= 0 or k else []
            hist["o_orderpriority"] += [(name, key, i, m * p) for i, p in enumerate(b["categorical"]["o_orderpriority"].values())] if key >= 0 or k else []
    return cohort, balance, hist


_CELLS = f"SELECT {sql_cohort(F5)} AS cohort, CAST(y = 'YES' AS INT) AS cls, {SQL_BIN['pool']('o_totalprice', F5.edges('o_totalprice'))} AS b1, CASE o_orderpriority {' '.join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(F5.levels('o_orderpriority')))} END AS b2, o_orderkey FROM {F5_SQL}"
_KEY = "CASE WHEN x.cohort = 'small' THEN x.cls ELSE -1 END"


def _sql_rake(rounds: int) -> str:
    """CTEs up to ``raked`` (cohort, cls, b1, b2, n, w); a round updates one family after the other, by windows over the tuples."""
    cohort, balance, hist = _rake_targets()
    least = lambda rows: [r for r in rows if r[-1] == 0 or r[-1] >= 1]
    inner = "w"
    steps = [(least(cohort), "cohort, target", "x.cohort", "c.cohort = x.cohort"), (least(balance), "cohort, cls, target", "x.cohort, x.cls", "c.cohort = x.cohort AND c.cls = x.cls")]
    steps += [(least(hist[c]), "cohort, k, b, target", f"x.cohort, {_KEY}, x.{b}", f"c.cohort = x.cohort AND c.k = {_KEY} AND c.b = x.{b}") for c, b in (("o_totalprice", "b1"), ("o_orderpriority", "b2"))]
    inner = f"(SELECT * FROM r WHERE step < {rounds})"
    for rows, names, by, on in steps:
        inner = f"(SELECT x.step, x.cohort, x.cls, x.b1, x.b2, x.n, x.w * coalesce(c.target / nullif(sum(x.w * x.n) OVER (PARTITION BY {by}), 0), 1) AS w FROM {inner} x LEFT JOIN {sql_values(rows, names)} c ON {on})"
    clipped = f"(SELECT * REPLACE (least(1, greatest(0, w)) AS w) FROM {inner})"
    return (
        f"t0 AS MATERIALIZED (SELECT cohort, cls, b1, b2, count(*) AS n FROM ({_CELLS}) GROUP BY ALL), "
        f"r AS (SELECT 0 AS step, cohort, cls, b1, b2, n, {TAKEN}::DOUBLE / sum(n) OVER () AS w FROM t0 UNION ALL SELECT step + 1, cohort, cls, b1, b2, n, least(1, w * {TAKEN} / sum(w * n) OVER ())::DOUBLE AS w FROM {clipped}), "
        f"raked AS MATERIALIZED (SELECT cohort, cls, b1, b2, n, w FROM r WHERE step = {rounds})"
    )


_RAKED = "SELECT cohort, CAST(cls AS BOOLEAN) AS pos, b1, b2, n, round(w, 6)::DOUBLE AS w FROM raked"


def _rake(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    found = selection.inclusion_weights(F5, small_release(), F5.coerce(fixtures.f5(spark, sf_dir)), TAKEN, rounds)
    return found.select(F.col("_cohort").alias("cohort"), F.col("_pos").alias("pos"), F.col("_b_o_totalprice").cast("int").alias("b1"), F.col("_b_o_orderpriority").cast("int").alias("b2"), F.col("_n").alias("n"), r6(F.col("_w")).alias("w"))


@query(f"WITH RECURSIVE {_sql_rake(1)} {_RAKED}")
def rake_one_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rake(spark, sf_dir, 1)


@query(f"WITH RECURSIVE {_sql_rake(selection.ROUNDS)} {_RAKED}")
def rake_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rake(spark, sf_dir, selection.ROUNDS)


def _f5_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.f5(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderpriority", "y")


SELECT_SEED = 7
_START = ((SELECT_SEED * 0x9E3779B9 + 1) % (1 << 32) + 0.5) / (1 << 32)
_SYSTEMATIC = (
    f"{_sql_rake(selection.ROUNDS)}, "
    f"scaled AS (SELECT *, w * {TAKEN} / sum(w * n) OVER () AS v FROM raked), "
    "placed AS (SELECT *, sum(v * n) OVER (ORDER BY cohort, cls, b1, b2) - v * n AS ahead FROM scaled), "
    f"ranked AS (SELECT o_orderkey, x.cohort, x.cls, x.b1, x.b2, ahead, v, row_number() OVER (PARTITION BY x.cohort, x.cls, x.b1, x.b2 ORDER BY {sql_uniform('o_orderkey', str(SELECT_SEED))}, o_orderkey) AS k FROM ({_CELLS}) x JOIN placed p USING (cohort, cls, b1, b2)), "
    f"drawn AS MATERIALIZED (SELECT *, floor(ahead + k * v - {_START!r}) > floor(ahead + k * v - {_START!r} - v) AS taken FROM ranked)"
)


def _select(spark: SparkSession, sf_dir: str, refined: bool) -> DataFrame:
    return selection.select_to_release(F5, small_release(), _f5_keyed(spark, sf_dir), TAKEN, "o_orderkey", seed=SELECT_SEED, sub_bin="generator", refined=refined)


@query(f"WITH RECURSIVE {_SYSTEMATIC} SELECT o_orderkey FROM drawn WHERE taken")
def systematic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, False).select("o_orderkey")


def _sql_swaps() -> str:
    """CTEs up to ``final`` (i, taken): in each step of the recursion the swap that lowers the weighted distance most, of equal ones the first."""
    cohort, balance, hist = _rake_targets()
    code = {"small": 0, "large": 1}
    rows = [(0, str(code[c]), t, 1.0) for c, t in cohort] + [(1, f"{code[c]}/{k}", t, 1.0) for c, k, t in balance]
    rows += [(2 + i, f"{code[c]}/{k}/{b}", t, 1.0) for i, col in enumerate(F5.features) for c, k, b, t in hist[col]]
    # values of a category that no histogram has
    rows += [(3, f"{code[c]}/{k}/5", 0.0, 1.0) for c, k in (("small", 1), ("small", 0), ("large", -1))]
    for i, (t, w) in enumerate(selection.pooled_targets(F5, small_release(), TAKEN)):
        rows += [(4 + i, str(b), float(x), float(y)) for b, (x, y) in enumerate(zip(t, w, strict=True))]
    member = ["CAST(CAST(cohort = 'large' AS INT) AS VARCHAR)", "concat_ws('/', CAST(cohort = 'large' AS INT), cls)", *(f"concat_ws('/', CAST(cohort = 'large' AS INT), {_KEY}, x.{b})" for b in ("b1", "b2")), "CAST(b1 AS VARCHAR)", "CAST(b2 AS VARCHAR)"]
    return (
        "u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cohort, cls, b1, b2) AS i, * FROM (SELECT cohort, cls, b1, b2, count(*) AS n, count_if(taken) AS t FROM drawn GROUP BY ALL)), "
        f"asked AS MATERIALIZED {sql_values(rows, 'f, c, target, weight')}, "
        f"m AS MATERIALIZED ({' UNION ALL '.join(f'SELECT i, {f} AS f, {c} AS c FROM u x' for f, c in enumerate(member))}), "
        "s AS (SELECT 0 AS step, (SELECT list(t ORDER BY i) FROM u) AS taken UNION ALL SELECT step + 1, list_transform_step FROM ("
        "WITH now AS (SELECT step, taken FROM s), "
        "have AS (SELECT m.f, m.c, any_value(a.weight) AS w, sum(now.taken[m.i]) - any_value(a.target) AS d FROM now, m JOIN asked a ON a.f = m.f AND a.c = m.c GROUP BY ALL), "
        "gain AS (SELECT m.i, sum(w * (abs(d) - abs(d - 1))) AS less, sum(w * (abs(d) - abs(d + 1))) AS more FROM m JOIN have h ON h.f = m.f AND h.c = m.c GROUP BY m.i), "
        "shared AS (SELECT a.i, b.i AS j, sum(2 * w * greatest(0, 1 - abs(d))) AS extra FROM have h JOIN m a ON a.f = h.f AND a.c = h.c JOIN m b ON b.f = h.f AND b.c = h.c WHERE abs(d) < 1 GROUP BY a.i, b.i), "
        "pairs AS (SELECT x.i, y.i AS j, round(x.less + y.more + coalesce(extra, 0), 9) AS value FROM now, gain x, gain y JOIN u ON u.i = y.i LEFT JOIN shared z ON z.i = x.i AND z.j = y.i WHERE x.i <> y.i AND now.taken[x.i] > 0 AND now.taken[y.i] < u.n), "
        f"best AS (SELECT i, j FROM pairs WHERE value > 1e-9 ORDER BY value DESC, i, j LIMIT 1) "
        f"SELECT step, [now.taken[k] - CAST(k = best.i AS INT) + CAST(k = best.j AS INT) FOR k IN range(1, len(now.taken) + 1)] AS list_transform_step FROM now, best WHERE step < {selection.ROUNDS * TAKEN})), "
        "final AS (SELECT u.i, cohort, cls, b1, b2, x.taken[u.i] AS quota FROM u, (SELECT taken FROM s ORDER BY step DESC LIMIT 1) x)"
    )


@query(f"WITH RECURSIVE {_SYSTEMATIC}, {_sql_swaps()} SELECT o_orderkey, o_totalprice, o_orderpriority, y FROM drawn JOIN final USING (cohort, cls, b1, b2) JOIN {F5_SQL} USING (o_orderkey) WHERE k <= quota")
def select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(spark, sf_dir, True)


#: A level of 10.7 million cells, of which few have rows.
WIDE = PublicSchema(
    "lineitem, wide",
    {"l_quantity": (1, 50), "l_extendedprice": (900, 105000), "l_discount": (0, 0.1), "l_tax": (0, 0.08), "l_linenumber": (1, 8)},
    {"l_returnflag": ["A", "N", "R"]},
    "l_linestatus", "O", "F",
    bins={"l_linenumber": list(range(1, 9)), "l_quantity": list(range(1, 51)), "l_extendedprice": [*(900 + 801 * i for i in range(130)), 105000], "l_discount": [round(0.01 * i, 2) for i in range(11)], "l_tax": [round(0.01 * i, 2) for i in range(9)]},
    conditional=[("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag")],
)


def _sql_wide() -> str:
    at = "0"
    for c in WIDE.conditional[0]:
        if c in WIDE.numerical:
            at = f"({at} * {len(WIDE.edges(c)) - 1} + {SQL_BIN['cell'](c, WIDE.edges(c))})"
        else:
            at = f"({at} * 3 + CASE {c} WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)"
    return f"SELECT {at}::BIGINT AS at, count(*)::BIGINT AS n, count_if(l_linestatus = 'O')::BIGINT AS n_pos FROM lineitem GROUP BY 1"


@query(_sql_wide())
def occupied_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.occupied(WIDE, WIDE.coerce(fixtures.f1(spark, sf_dir)), WIDE.conditional[0])


@query(f"SELECT o_orderkey FROM orders ORDER BY {sql_uniform('o_orderkey', '11')}, o_orderkey LIMIT 300")
def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.simple_sample(fixtures.read(spark, sf_dir, "orders"), "o_orderkey", 300, 11).select("o_orderkey")


@query(
    f"SELECT a.o_orderkey, b.y FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_uniform('o_orderkey', '5 rows')}, o_orderkey) AS r FROM {F5_SQL}) a "
    f"JOIN (SELECT y, row_number() OVER (ORDER BY {sql_uniform('o_orderkey', '5 values')}, o_orderkey) AS r FROM {F5_SQL}) b USING (r)"
)
def permute_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.permuted(fixtures.f5(spark, sf_dir).select("o_orderkey", "y"), "o_orderkey", "y", 5)


@query(f"SELECT o_orderkey FROM orders WHERE {sql_uniform('o_orderkey', '3')} < 0.8")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(fixtures.read(spark, sf_dir, "orders"), "o_orderkey", 0.8, 3)[0].select("o_orderkey")


@query(
    f"WITH b AS (SELECT *, {SQL_BIN['pool']('o_totalprice', F5.edges('o_totalprice'))} AS i FROM orders), e AS (SELECT *, [1000.0, 50000.0, 100000.0, 200000.0][i + 1] AS lo, [50000.0, 100000.0, 200000.0, 500000.0][i + 1] AS hi FROM b) "
    f"SELECT o_orderkey, round(CASE WHEN i < 2 THEN lo + {sql_uniform('o_orderkey', '9 o_totalprice')} * (hi - lo) ELSE o_totalprice END, 6)::DOUBLE AS o_totalprice FROM e"
)
def subbin_redraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.sub_bin_redraw(F5, small_release(), _f5_keyed(spark, sf_dir), "o_orderkey", 9).select("o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"))


# -- bound, evaluation, correction --------------------------------------------------------------

P_HAT = {f"o_orderpriority={v}": p for v, p in zip(F5.levels("o_orderpriority"), (0.8, 0.3, 0.35, 0.3, 0.2), strict=True)}
HALF = bound.halfwidth(150, 0.5, 5, 0.05)
_SCORES = (
    f"SELECT p.cell, p_hat::DOUBLE AS p_hat, round(avg(y), 6) AS rate, count(y)::BIGINT AS n, round(CASE WHEN count(y) > 0 THEN abs(p_hat - avg(y)) + {HALF!r} ELSE 1 END, 6)::DOUBLE AS bound "
    f"FROM {sql_values(list(P_HAT.items()), 'cell, p_hat')} p LEFT JOIN (SELECT {sql_cell(F5, ('o_orderpriority',))} AS cell, CAST(y = 'YES' AS INT) AS y FROM {F5_SQL}) s ON s.cell = p.cell GROUP BY p.cell, p_hat"
)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p_hat = domains.frame(spark, list(P_HAT.items()), "cell string, p_hat double")
    found = bound.scored(counts.rates(F5, F5.coerce(fixtures.f5(spark, sf_dir)), 0), p_hat, HALF)
    return found.select("cell", "p_hat", r6(F.col("rate")).alias("rate"), "n", r6(F.col("bound")).alias("bound"))


@query(_SCORES)
def cell_bound_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


_CONDITIONS = (
    f"WITH o AS (SELECT o_orderkey, o_orderpriority, y FROM {F5_SQL}), h AS (SELECT * FROM o WHERE o_orderkey % 3 = 0 ORDER BY {sql_uniform('o_orderkey', '6')}, o_orderkey LIMIT 400), "
    f"p AS (SELECT a.o_orderkey, a.o_orderpriority, b.y FROM (SELECT *, row_number() OVER (ORDER BY {sql_uniform('o_orderkey', '6 rows')}, o_orderkey) AS r FROM h) a JOIN (SELECT y, row_number() OVER (ORDER BY {sql_uniform('o_orderkey', '6 values')}, o_orderkey) AS r FROM h) b USING (r)), "
    "t AS (SELECT 'synthetic' AS condition, o_orderpriority, y FROM o WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'ceiling', o_orderpriority, y FROM h UNION ALL SELECT 'floor', o_orderpriority, y FROM p) "
    f"SELECT condition, 'o_orderpriority=' || o_orderpriority AS cell, count(*)::BIGINT AS n, round(avg(CAST(y = 'YES' AS INT)), 6) AS rate, round(abs(p_hat - avg(CAST(y = 'YES' AS INT))) + {HALF!r}, 6)::DOUBLE AS bound FROM t JOIN {sql_values(list(P_HAT.items()), 'cell, p_hat')} q ON q.cell = 'o_orderpriority=' || o_orderpriority GROUP BY condition, o_orderpriority, p_hat"
)


@query(_CONDITIONS)
def bound_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fixtures.f5(spark, sf_dir).select("o_orderkey", *F5.columns)
    sample = sampling.simple_sample(orders.where("o_orderkey % 3 = 0"), "o_orderkey", 400, 6)
    tables = {"synthetic": orders.where("o_orderkey % 3 <> 0"), "ceiling": sample, "floor": sampling.permuted(sample, "o_orderkey", "y", 6)}
    p_hat = domains.frame(spark, list(P_HAT.items()), "cell string, p_hat double")
    found = bound.conditions(F5, tables, ("o_orderpriority",), p_hat).join(F.broadcast(p_hat), "cell")
    return found.select("condition", "cell", "n", r6(F.col("rate")).alias("rate"), r6(F.abs(F.col("p_hat") - F.col("rate")) + HALF).alias("bound"))


@query(f"SELECT count_if(n > 0)::BIGINT AS covered, count_if(n = 0)::BIGINT AS uncovered, count_if(n > 0 AND n < 20)::BIGINT AS thin, max(bound) AS worst, round(avg(bound), 6) AS mean FROM ({_SCORES})")
def bound_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return _scores(spark, sf_dir).agg(F.count_if(n > 0).alias("covered"), F.count_if(n == 0).alias("uncovered"), F.count_if((n > 0) & (n < bound.THIN)).alias("thin"), F.max("bound").alias("worst"), r6(F.avg("bound")).alias("mean"))


_OWN_CELLS = f"(SELECT o_orderpriority, count(*) AS n, avg(CAST(y = 'YES' AS INT)) AS rate FROM {F5_SQL} GROUP BY 1 HAVING count(*) >= {CELL_SHARE} * (SELECT count(*) FROM orders))"


@query(f"SELECT round({HALF!r} + 0.5 * max(abs(rate - (SELECT avg(CAST(y = 'YES' AS INT)) FROM {F5_SQL}))), 6)::DOUBLE AS tolerance FROM {_OWN_CELLS}")
def derived_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table_release(spark, sf_dir)
    return domains.frame(spark, [(round(bound.tolerance(r, r.conditional_levels[0], "YES", HALF), 6),)], "tolerance double")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = fixtures.f5(spark, sf_dir)
    return F5.coerce(df.where("o_orderkey % 3 <> 0")), F5.coerce(df.where("o_orderkey % 3 = 0"))


def _sql_labels(schema: PublicSchema, table: str, target: bool) -> str:
    parts = [f"SELECT '{c}' AS col, CAST({SQL_BIN['interval'](c, schema.edges(c))} AS VARCHAR) AS value, o_orderkey % 3 = 0 AS second FROM {table}" for c in schema.numerical]
    parts += [f"SELECT '{c}', {c}, o_orderkey % 3 = 0 FROM {table}" for c in [*schema.categorical, *([schema.target] if target else [])]]
    return "(" + " UNION ALL ".join(parts) + ")"


@query(
    f"WITH n AS (SELECT col, value, count_if(NOT second) AS a, count_if(second) AS b FROM {_sql_labels(F5, F5_SQL, True)} GROUP BY ALL), s AS (SELECT col, a / sum(a) OVER (PARTITION BY col) AS p, b / sum(b) OVER (PARTITION BY col) AS q FROM n) "
    "SELECT col, round(sum(abs(p - q)) / 2, 6) AS tv FROM s GROUP BY col"
)
def marginal_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.marginal_tv(F5, *_halves(spark, sf_dir)).select("col", r6(F.col("tv")).alias("tv"))


@query(
    "WITH n AS (SELECT o_orderpriority AS v, count_if(o_orderkey % 3 <> 0) AS a, count_if(o_orderkey % 3 = 0) AS b FROM orders GROUP BY 1), s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM n) "
    "SELECT 'o_orderpriority' AS col, round(sum(abs(p - q)) / 2, 6) AS tv FROM s"
)
def feature_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.feature_shift(F5, *_halves(spark, sf_dir)).select("col", r6(F.col("tv")).alias("tv"))


@query(f"SELECT col, value FROM {sql_values([('lang', v) for v in F4.levels('lang')] + [('source', v) for v in F4.levels('source')] + [('quality', '1'), ('quality', '0')], 'col, value')} EXCEPT SELECT unnest(['lang', 'source', 'quality']), unnest([lang, source, CAST(quality AS VARCHAR)]) FROM {F4_SQL} WHERE lang <> 'es' AND source <> 'src3'")
def absent_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.absent_categories(F4, F4.coerce(fixtures.f4(spark, sf_dir).where("lang <> 'es' AND source <> 'src3'")))


RATES = [("o_orderpriority=1-URGENT", 0.5), ("o_orderpriority=2-HIGH", 0.25), ("o_orderpriority=3-MEDIUM", 0.123)]
_RELABELLED = (
    f"WITH s AS (SELECT o_orderkey, y, {sql_cell(F5, ('o_orderpriority',))} AS cell FROM {F5_SQL}), k AS (SELECT s.*, rate, rate * count(*) OVER (PARTITION BY s.cell) AS exact, "
    f"row_number() OVER (PARTITION BY s.cell ORDER BY {sql_uniform('o_orderkey', '4 row')}, o_orderkey) AS place FROM s LEFT JOIN {sql_values(RATES, 'cell, rate')} r ON r.cell = s.cell) "
    f"SELECT o_orderkey, cell, CASE WHEN rate IS NULL THEN y WHEN place <= floor(exact) + CAST({sql_uniform('cell', '4 cell')} < exact - floor(exact) AS INT) THEN 'YES' ELSE 'NO' END AS y FROM k"
)


def _relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.relabelled(F5, _f5_keyed(spark, sf_dir), ("o_orderpriority",), domains.frame(spark, RATES, "cell string, rate double"), "o_orderkey", 4)


_RANKED = (
    f"WITH s AS (SELECT o_orderkey, y, o_totalprice, {sql_cell(F5, ('o_orderpriority',))} AS cell FROM {F5_SQL}), k AS (SELECT s.*, rate, rate * count(*) OVER (PARTITION BY s.cell) AS exact, "
    f"row_number() OVER (PARTITION BY s.cell ORDER BY 1 - o_totalprice / 600000, {sql_uniform('o_orderkey', '4 row')}, o_orderkey) AS place FROM s LEFT JOIN {sql_values(RATES, 'cell, rate')} r ON r.cell = s.cell) "
    f"SELECT o_orderkey, CASE WHEN rate IS NULL THEN y WHEN place <= floor(exact) + CAST({sql_uniform('cell', '4 cell')} < exact - floor(exact) AS INT) THEN 'YES' ELSE 'NO' END AS y FROM k"
)


@query(_RANKED)
def relabel_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _f5_keyed(spark, sf_dir).withColumn("score", F.col("o_totalprice") / 600000)
    return hybrid.relabelled(F5, scored, ("o_orderpriority",), domains.frame(spark, RATES, "cell string, rate double"), "o_orderkey", 4, "score").select("o_orderkey", "y")


@query(f"SELECT o_orderkey, y FROM ({_RELABELLED})")
def relabel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relabelled(spark, sf_dir).select("o_orderkey", "y")


@query(f"SELECT round(avg(abs(own - rate)), 6) AS error FROM (SELECT cell, avg(CAST(y = 'YES' AS INT)) AS own FROM (SELECT y, {sql_cell(F5, ('o_orderpriority',))} AS cell FROM {F5_SQL}) GROUP BY cell) JOIN {sql_values(RATES, 'cell, rate')} USING (cell)")
def conditional_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.conditional_error(F5, fixtures.f5(spark, sf_dir), ("o_orderpriority",), domains.frame(spark, RATES, "cell string, rate double")).select(r6(F.col("error")).alias("error"))


@query(
    f"WITH r AS (SELECT y = 'YES' AS p, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS k FROM {F5_SQL}) "
    "SELECT round((sum(k) FILTER (p) - count_if(p) * (count_if(p) + 1) / 2.0) / (count_if(p)::DOUBLE * count_if(NOT p)), 6)::DOUBLE AS auc FROM r"
)
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dpspark.operators.students import auc

    found = fixtures.f5(spark, sf_dir).select(F.col("o_totalprice").alias("score"), (F.col("y") == "YES").alias("positive"))
    return auc(found).select(r6(F.col("auc")).alias("auc"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def cap_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.capped(fixtures.read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5).select("event_id")


@query("SELECT max(n)::BIGINT AS most_rows, 0.1 * max(n)::DOUBLE AS epsilon, 0.1 * max(n) > 10 AS vacuous FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def group_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = fixtures.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most_rows"))
    epsilon = F.lit(0.1) * F.col("most_rows")
    return most.select("most_rows", epsilon.alias("epsilon"), (epsilon > ledger.VACUOUS).alias("vacuous"))


@query(
    f"SELECT o_orderkey, o_orderpriority AS stratum, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY {sql_uniform('o_orderkey', '1')}, o_orderkey) <= round(0.8 * count(*) OVER (PARTITION BY o_orderpriority)) THEN 'train' ELSE 'holdout' END AS part FROM orders"
)
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sampling.stratified_split(fixtures.read(spark, sf_dir, "orders"), "o_orderkey", 0.8, F.col("o_orderpriority"), 1)
    both = reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(name)) for p, name in zip(parts, ("train", "holdout"), strict=True)))
    return both.select("o_orderkey", F.col("o_orderpriority").alias("stratum"), "part")


_LABELS = [(c, i, binning.quota_label(F5.edges(c), i)) for c in F5.numerical for i in range(len(F5.edges(c)) - 1)] + [(c, i, v) for c in F5.categorical for i, v in enumerate(F5.levels(c))]


@query(
    f"WITH m AS (SELECT cohort, cls, col, bin, count(*) AS n FROM (SELECT {sql_cohort(F5)} AS cohort, y AS cls, col, bin FROM {sql_melt(F5, F5_SQL, 'histogram', 'o_orderkey, y, o_totalprice')}) GROUP BY ALL), "
    "b AS (SELECT cohort, cls, col, bin, n FROM m UNION ALL SELECT cohort, NULL, col, bin, sum(n) FROM m GROUP BY cohort, col, bin) "
    f"SELECT cohort, cls, col, label, round(n / sum(n) OVER (PARTITION BY cohort, cls, col), 6)::DOUBLE AS share FROM b JOIN {sql_values(_LABELS, 'col, bin, label')} USING (col, bin)"
)
def release_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histograms of a release that went through JSON, as a flat table."""
    frames = Release.from_json(table_release(spark, sf_dir).to_json()).frames(spark)
    found = frames["release_histogram"].join(frames["release_cohort"].select("cohort_id", "cohort"), "cohort_id")
    return found.where("share > 0").select("cohort", "cls", "col", "label", r6(F.col("share")).alias("share"))


@query(f"SELECT cell, round(rate, 6)::DOUBLE AS rate, n::BIGINT AS support FROM (SELECT 'o_orderpriority=' || o_orderpriority AS cell, rate, n FROM {_OWN_CELLS})")
def release_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its conditional cells, read back from JSON too."""
    cells = Release.from_json(table_release(spark, sf_dir).to_json()).frames(spark)["release_cell"]
    return cells.select("cell", r6(F.col("rate")).alias("rate"), "support")


@query(f"SELECT col, label, round(count(*) / sum(count(*)) OVER (PARTITION BY col), 6)::DOUBLE AS share FROM (SELECT col, bin FROM {sql_melt(F5, F5_SQL, 'histogram')}) JOIN {sql_values(_LABELS, 'col, bin, label')} USING (col, bin) GROUP BY col, label")
def mixture_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quota.mixture(F5, table_release(spark, sf_dir))
    return domains.frame(spark, [(c, k, round(p, 6)) for c, x in found.items() for k, p in x.items() if p > 0], "col string, label string, share double")


@query(f"WITH l AS ({_sql_levels(F2, F2_SQL, IS_YES)}) SELECT level, cell, round(n_pos / greatest(n, {FLOORED}), 6)::DOUBLE AS rate FROM l")
def floored_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives over the rows of a cell, or over a floor: what one row can move is bounded by it."""
    found = counts.level_counts(F2, F2.coerce(fixtures.f2(spark, sf_dir)))
    return found.select("level", "cell", r6(F.col("n_pos") / F.greatest(F.col("n"), F.lit(FLOORED))).alias("rate"))


DRAW_SEEDS = (1000, 1001, 1002)


def _sql_draws() -> str:
    """Total variation of three samples of 500 rows, and of the same with permuted targets, from every third order."""
    train = f"(SELECT o_orderkey, o_totalprice, o_orderpriority, y FROM {F5_SQL} WHERE o_orderkey % 3 <> 0)"
    real = [f"(SELECT {s} AS draw, * FROM {train} ORDER BY {sql_uniform('o_orderkey', str(s))}, o_orderkey LIMIT 500)" for s in DRAW_SEEDS]
    out = f"WITH real AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM {r}' for r in real)}), "
    order = lambda what: f"row_number() OVER (PARTITION BY draw ORDER BY {sql_uniform('o_orderkey', 'SEED').replace(chr(39) + 'SEED' + chr(39), f'CAST(draw AS VARCHAR) || {chr(39)} {what}{chr(39)}')}, o_orderkey)"
    out += f"permuted AS (SELECT a.draw, a.o_orderkey, a.o_totalprice, a.o_orderpriority, b.y FROM (SELECT *, {order('rows')} AS r FROM real) a JOIN (SELECT draw, y, {order('values')} AS r FROM real) b USING (draw, r)), "
    labels = lambda t, keys: " UNION ALL ".join(f"SELECT {keys}'{c}' AS col, CAST({v} AS VARCHAR) AS value FROM {t}" for c, v in (("o_totalprice", SQL_BIN["interval"]("o_totalprice", F5.edges("o_totalprice"))), ("o_orderpriority", "o_orderpriority"), ("y", "y")))
    out += f"q AS (SELECT col, value, count(*) / sum(count(*)) OVER (PARTITION BY col) AS q FROM ({labels(f'(SELECT * FROM {F5_SQL} WHERE o_orderkey % 3 = 0)', '')}) GROUP BY col, value), "
    kinds = " UNION ALL ".join(f"SELECT '{k}' AS kind, draw, col, value, count(*) AS n FROM ({labels(k, 'draw, ')}) GROUP BY ALL" for k in ("real", "permuted"))
    out += f"p AS (SELECT *, n / sum(n) OVER (PARTITION BY kind, draw, col) AS p FROM ({kinds})), k AS (SELECT DISTINCT kind, draw FROM p), "
    out += "both_ AS (SELECT x.kind, x.draw, x.col, x.value, x.q, coalesce(p.p, 0) AS p FROM (SELECT kind, draw, col, value, q FROM k, q) x LEFT JOIN p USING (kind, draw, col, value) UNION ALL SELECT kind, draw, col, value, 0, p FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.col = p.col AND q.value = p.value)) "
    return out + "SELECT kind, draw, round(avg(tv), 6)::DOUBLE AS tv FROM (SELECT kind, draw, col, sum(abs(p - q)) / 2 AS tv FROM both_ GROUP BY ALL) GROUP BY ALL"


@query(_sql_draws())
def reference_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fixtures.f5(spark, sf_dir).select("o_orderkey", *F5.columns)
    real = sampling.samples(orders.where("o_orderkey % 3 <> 0"), "o_orderkey", 500, DRAW_SEEDS)
    holdout = F5.coerce(orders.where("o_orderkey % 3 = 0"))
    parts = []
    for kind, drawn in (("real", real), ("permuted", sampling.permuted(real, "o_orderkey", "y", 0, sampling.DRAW))):
        gaps = counts.marginal_tv(F5, F5.coerce(drawn, [sampling.DRAW]), holdout, [sampling.DRAW])
        parts.append(gaps.groupBy(sampling.DRAW).agg(r6(F.avg("tv")).alias("tv")).select(F.lit(kind).alias("kind"), F.col(sampling.DRAW).alias("draw"), "tv"))
    return parts[0].unionByName(parts[1])


@query()
def tstr_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dpspark.operators.students import tstr

    train, test = sampling.split(fixtures.f5(spark, sf_dir), "o_orderkey", 0.8, 1)
    return domains.frame(spark, list(tstr(F5, train, test, only=("LR",)).items()), "student string, auc double")


@query(f"SELECT kind, round(avg(tv), 6) AS mean, min(tv) AS least, max(tv) AS most FROM ({_sql_draws()}) GROUP BY kind")
def reference_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dpspark.plans.evaluate import spread

    draws: dict[str, list[float]] = {}
    for r in reference_draws(spark, sf_dir).collect():
        draws.setdefault(r["kind"], []).append(r["tv"])
    found = {k: spread(v) for k, v in draws.items()}
    return domains.frame(spark, [(k, round(x["mean"], 6), x["min"], x["max"]) for k, x in found.items()], "kind string, mean double, least double, most double")


@query(
    f"SELECT cohort, cls, col, bin, count(*)::BIGINT AS n FROM (SELECT {sql_cohort(F5)} AS cohort, CASE WHEN y = 'YES' THEN 'pos' ELSE 'neg' END AS cls, col, bin FROM {sql_melt(F5, F5_SQL, 'histogram', 'o_orderkey, y, o_totalprice')}) GROUP BY ALL"
)
def statistical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as the table has, from its own counts: every bin of every cohort and class is met exactly."""
    from dpspark.plans.generate import statistical

    rows = statistical(spark, F5, table_release(spark, sf_dir), fixtures.f5(spark, sf_dir).count(), seed=2)
    return counts.histograms(F5, F5.coerce(rows)).where("n > 0").select("cohort", "cls", "col", "bin", "n")


@query(f"SELECT 'o_orderpriority' AS col, round(sum(n) / (SELECT count(*) FROM orders), 6)::DOUBLE AS covered FROM {_OWN_CELLS}")
def band_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.frame(spark, [(c, round(x, 6)) for c, x in quota.band_coverage(F5, table_release(spark, sf_dir)).items()], "col string, covered double")
