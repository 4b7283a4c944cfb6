"""Public schemas over the test tables, for the registered queries and the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpspark.schema import Band, PublicSchema

F1 = PublicSchema(
    "lineitem",
    {"l_quantity": (1, 50), "l_extendedprice": (900, 105000), "l_discount": (0, 0.1), "l_tax": (0, 0.08)},
    {"l_returnflag": ["A", "N", "R"]},
    "l_linestatus", "O", "F",
    bins={"l_quantity": [1, 10, 20, 30, 40, 50], "l_extendedprice": [900, 20000, 40000, 60000, 80000, 105000], "l_discount": [0, 0.02, 0.04, 0.06, 0.08, 0.1], "l_tax": [0, 0.02, 0.04, 0.06, 0.08]},
)
F2 = PublicSchema(
    "lineitem with a signal",
    {"l_quantity": (1, 50), "l_discount": (0, 0.1)},
    {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]},
    "y", "YES", "NO",
    bins={"l_quantity": [1, 10, 25, 40, 50], "l_discount": [0, 0.02, 0.04, 0.06, 0.08, 0.1]},
    stratify=["l_quantity"], bands={"l_quantity": [Band("low", 1, 25), Band("high", 25, 50)]},
    conditional=[(), ("l_returnflag",), ("l_returnflag", "l_linestatus")],
)
F4 = PublicSchema(
    "labelled documents",
    {"n_chars": (0, 200000)},
    {"lang": ["de", "en", "es", "fr"], "source": [f"src{i}" for i in range(20)]},
    "quality", "1", "0",
    bins={"n_chars": [0, 400, 1000, 2000, 4000, 200000]},
    conditional=[("source",)], coarsen={"source": {f"src{i}": f"g{i // 5}" for i in range(20)}},
)
F5 = PublicSchema(
    "orders with a signal",
    {"o_totalprice": (1000, 500000)},
    {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]},
    "y", "YES", "NO",
    bins={"o_totalprice": [1000, 50000, 100000, 200000, 500000]},
    stratify=["o_totalprice"], bands={"o_totalprice": [Band("small", 1000, 100000), Band("large", 100000, 500000)]},
    conditional=[("o_orderpriority",)],
)
# Ledger rows: epsilon, composition, partition, group.
F6 = [(0.1, "sequential", "", "a"), (0.2, "parallel", "x", "b"), (0.2, "parallel", "y", "b"), (0.1, "parallel", "x/1", "b"), (0.15, "parallel", "x/2", "b"), (0.3, "sequential", "", "b")]
# Answers of a model: fences, a bad line, a whole float, an empty cell, an unknown category, a number out of bounds.
F7 = [
    (1, "Here you are\n```csv\no_totalprice,o_orderpriority,y\n2000,1-URGENT,YES\n3000.5,5-LOW,NO\nbad line\n```"),
    (2, "o_orderpriority,y,o_totalprice\n2-HIGH,YES,900\n9-NONE,NO,5000\n3-MEDIUM,,7000\n\"4-NOT SPECIFIED\",NO,x\n 5-LOW , NO , 450000 "),
    (3, "no table at all"),
]

F2_Y = "CASE WHEN (l_orderkey * 7 + l_linenumber * 3) % 10 < 2 + 4 * CAST(l_returnflag = 'R' AS INT) + 2 * CAST(l_quantity >= 25 AS INT) THEN 'YES' ELSE 'NO' END"
F5_Y = "CASE WHEN (o_orderkey * 7) % 10 < 2 + 5 * CAST(o_orderpriority = '1-URGENT' AS INT) + 2 * CAST(o_totalprice >= 100000 AS INT) THEN 'YES' ELSE 'NO' END"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumn("y", F.expr(F2_Y))


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")


def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("y", F.expr(F5_Y))
