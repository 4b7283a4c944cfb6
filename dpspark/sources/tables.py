"""Tables from CSV, JSON, Parquet and ORC files, and to them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark import InheritableThread
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from dpspark.errors import DataValidationError

_NEVER = "\u0000never"


def kind_of(path: str) -> str:
    bare = path.rstrip("/").removesuffix(".gz").lower()
    return next((k for k in ("csv", "json", "orc") if bare.endswith(f".{k}") or bare.endswith(f".{k}l")), "parquet")


def read_table(spark: SparkSession, path: str, columns: Sequence[str], kind: str | None = None) -> DataFrame:
    """The named columns of a table. In CSV, ``None``, ``NA``, the empty cell and the like are values, and all columns are text."""
    kind = kind or kind_of(path)
    if kind == "csv":
        head = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
        df = spark.read.schema(schema).option("header", True).option("nullValue", _NEVER).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)
    else:
        df = spark.read.format(kind).load(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise DataValidationError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns).fillna("") if kind == "csv" else df.select(*columns)


def write_table(df: DataFrame, path: str, kind: str | None = None) -> None:
    kind = kind or kind_of(path)
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
    else:
        writer.format(kind).save(path)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a temporary folder where the setting is missing, for a local master only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="dpspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` evaluated once and written to shared storage: a lost executor repeats nothing of it."""
    path = path or shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Seconds between two looks at a job that is watched.
LOOK = 0.05


def kept_while(df: DataFrame, path: str, going_on: Callable[[], bool]) -> tuple[DataFrame, bool]:
    """``df`` written to ``path`` by a job that ends early if it is not ``going_on``; what its finished tasks wrote stays. The second value: was it ended?

    A task's file is put in place when the task ends, not when the job does, so
    that ending the job's group loses only tasks that are under way.
    """
    spark, failed = df.sparkSession, []
    group = f"dpspark-{uuid.uuid4().hex}"

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "answers of a decoder", True)
        try:
            df.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
        except Exception as e:
            failed.append(e)

    job, ended = InheritableThread(target=run), False
    job.start()
    while job.is_alive():
        job.join(LOOK)
        if not ended and not going_on():
            ended = True
        if ended:  # again, in case the job had not begun
            spark.sparkContext.cancelJobGroup(group)
    if failed and not ended:
        raise failed[0]
    try:
        found = spark.read.schema(df.schema).parquet(path)
    except AnalysisException:  # no task had ended
        found = spark.createDataFrame([], df.schema)
    return found, ended
