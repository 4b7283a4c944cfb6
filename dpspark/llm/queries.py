"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dpspark.llm import centroids, decontaminate, extract, fingerprints, linededup, middle, neardup, packing, preferences, quality, secrets, toxicity, warc
from dpspark.llm.common import table


def op1_preference_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.segments(*preferences.swapped_replies(table(spark, sf_dir, "conversations")))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_preference_segments, op2_warc_index, op3_benchmark_leaks, op4_toxicity, op5_fingerprints, op6_main_text, op7_line_dedup, op8_near_duplicates, op9_secrets, op10_pack_windows, op11_centroid_clusters, op12_fill_in_middle, op13_quality, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_segments": preferences.SQL, "op11_centroid_clusters": centroids.SQL, "op12_fill_in_middle": middle.SQL}
