"""Models that are trained on one table and tested on another."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpspark.functions.draw import uniform
from dpspark.operators.sampling import numbered
from dpspark.schema import PublicSchema
from dpspark.sources.tables import kept

INFORMATIVE = 0.55


def students(seed: int) -> dict:
    """Defaults that fix the comparison."""
    return {
        "LR": LogisticRegression(maxIter=2000, labelCol="_y", featuresCol="_x"),
        "RF": RandomForestClassifier(numTrees=300, seed=seed, labelCol="_y", featuresCol="_x"),
        "GBM": GBTClassifier(maxIter=100, seed=seed, labelCol="_y", featuresCol="_x"),
    }


def pipeline(schema: PublicSchema, student) -> Pipeline:
    """Numbers scaled, categories one-hot, unseen ones kept apart."""
    stages, inputs = [], []
    if schema.categorical:
        names = list(schema.categorical)
        stages += [StringIndexer(inputCols=names, outputCols=[f"_i_{c}" for c in names], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_i_{c}" for c in names], outputCols=[f"_h_{c}" for c in names], handleInvalid="keep", dropLast=False)]
        inputs += [f"_h_{c}" for c in names]
    if schema.numerical:
        stages += [VectorAssembler(inputCols=list(schema.numerical), outputCol="_n"), StandardScaler(inputCol="_n", outputCol="_s", withMean=True)]
        inputs.append("_s")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="_x"), student])


def labelled(schema: PublicSchema, df: DataFrame) -> DataFrame:
    return schema.coerce(df).withColumn("_y", schema.is_positive().cast("double"))


def _by_score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positives and negatives of each score of a batch."""
    for batch in batches:
        s, at = np.unique(batch["s"].to_numpy(zero_copy_only=False), return_inverse=True)
        p = batch["p"].to_numpy(zero_copy_only=False).astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.bincount(at[p], minlength=len(s))), pa.array(np.bincount(at[~p], minlength=len(s)))], names=["s", "p", "n"])


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of scores: its least one, its positives and negatives, and the pairs within it that are in order (ties: half)."""
    parts = [b for b in batches if len(b)]
    if parts:
        s, p, n = (np.concatenate([b[c].to_numpy() for b in parts]) for c in ("s", "p", "n"))
        s, at = np.unique(s, return_inverse=True)
        p, n = (np.bincount(at, x, len(s)) for x in (p, n))
        yield pa.RecordBatch.from_arrays([pa.array(s[:1]), pa.array([p.sum()]), pa.array([n.sum()]), pa.array([float((p * (np.cumsum(n) - n / 2)).sum())])], names=["s", "p", "n", "u"])


def auc(df: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """(auc) of a score for a boolean, by the pairs of a positive and a negative that are in order; ties count half. Null with one class.

    One pass: rows are counted by score where they are, so that a score that very
    many rows have is a few; ranges of scores are sized by Spark, and each counts
    its own pairs; what is put together are a few numbers of each range. A null
    score is like minus infinity.
    """
    lowest = F.lit(float("-inf"))
    rows = df.select(F.coalesce(F.col(score).cast("double"), lowest).alias("s"), F.coalesce(positive, F.lit(False)).alias("p"))
    counted = rows.mapInArrow(_by_score, "s double, p long, n long").repartitionByRange("s")
    ranges = counted.mapInArrow(_by_range, "s double, p double, n double, u double").agg(F.array_sort(F.collect_list(F.struct("s", "p", "n", "u"))).alias("r"))
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.lit(0.0).alias("u"))
    add = lambda a, x: F.struct((a.p + x.p).alias("p"), (a.n + x.n).alias("n"), (a.u + x.u + x.p * a.n).alias("u"))
    total = ranges.select(F.aggregate("r", zero, add).alias("t")).select("t.*")
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def tstr(schema: PublicSchema, train: DataFrame, holdout: DataFrame, seed: int = 0, only: tuple[str, ...] = ("LR", "RF", "GBM")) -> dict[str, float]:
    """AUC on ``holdout`` of each student trained on ``train``; NaN where ``train`` has one class."""
    data, test = labelled(schema, train), labelled(schema, holdout)
    if data.select("_y").distinct().count() < 2:
        return dict.fromkeys(only, float("nan"))
    out = {}
    for name in only:
        model = pipeline(schema, students(seed)[name]).fit(data)
        found = auc(predicted(model, test).select("score", (F.col("_y") == 1).alias("positive"))).first()[0]
        out[name] = float("nan") if found is None else found
    return out


#: Folds of the scores that a table's own rows are ranked by.
RANK_FOLDS = 5


def folds(df: DataFrame, key: str, stratum: str, k: int, seed: int) -> DataFrame:
    """``df`` with ``_fold`` from 0 to ``k``: every stratum's rows are dealt out in turn, in the order of a hash of ``key``."""
    return numbered(df, uniform(F.col(key), f"{seed} fold"), "_rank", [stratum], [key]).withColumn("_fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def out_of_fold(schema: PublicSchema, df: DataFrame, key: str, seed: int, k: int = RANK_FOLDS, student: str = "RF") -> DataFrame:
    """(key, _y, _score): each row's score by a model of the folds that it is not in; one fit for each fold."""
    data = kept(folds(df.select(key, *schema.columns).withColumn("_y", schema.is_positive().cast("double")), key, "_y", k, seed))
    parts = []
    for f in range(k):
        model = pipeline(schema, students(seed)[student]).fit(data.where(F.col("_fold") != f))
        parts.append(predicted(model, data.where(F.col("_fold") == f)).select(key, "_y", F.col("score").alias("_score")))
    return reduce(DataFrame.unionByName, parts)


def ranking_scores(schema: PublicSchema, df: DataFrame, key: str, seed: int, k: int = RANK_FOLDS) -> DataFrame | None:
    """(key, _score): each row's cross-validated score; None where a class has fewer rows than folds, or the scores can't tell the target."""
    least = df.groupBy(schema.is_positive()).count().agg(F.min("count"), F.count("*")).first()
    if least[1] < 2 or least[0] < k:
        return None
    found = kept(out_of_fold(schema, df, key, seed, k))
    quality = auc(found.select(F.col("_score").alias("score"), (F.col("_y") == 1).alias("positive"))).first()[0]
    return found.select(key, "_score") if quality is not None and quality >= INFORMATIVE else None


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
