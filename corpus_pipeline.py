"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``docs``; rows with a null doc_id can't be judged and stay.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpspark.llm import decontaminate, linededup, neardup, packing, toxicity
from dpspark.llm.common import shared_dir, table, written


#: Documents that a task hands to Python at once: with several stages' workers alive, what they hold adds up.
BATCH = 1000


def _in_small_batches(stage):
    """``stage`` with Arrow batches of BATCH rows."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``: broadcast if few, else shuffled."""
    ids = written(ids.select("doc_id").distinct(), shared_dir(docs.sparkSession), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= neardup.BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are scored as toxic."""
    flagged = toxicity.flagged(docs, table(spark, sf_dir, "labels"))
    return _without(docs, flagged.where("predicted = 1"))


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that an earlier document has, nor documents of which nothing is left."""
    found = linededup.remove_repeats(docs, keep=docs.columns)
    blank = F.trim(F.regexp_replace("text", r"\s+", " ")) == ""
    rows = found.where(~((F.col("removed_words") > 0) & blank))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return _without(docs, neardup.near_duplicates(docs).where("NOT kept"))


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return _without(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in full sequences."""
    return packing.digest(packing.pack(docs))


STAGES = [(name, _in_small_batches(stage)) for name, stage in (("toxicity", toxic_out), ("line_dedup", repeats_out), ("near_dedup", copies_out), ("decontamination", leaks_out), ("packing", packed))]

#: Fitted scores, winnowing, MinHash and tokenizers have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
