"""Every stage of the pipeline on odd and on empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, empty, odd  # noqa: F401

LABELS = [(3, 1, 0), (4, 1, 1), (7, 1, 0), (8, 0, 1), (9, 1, 0), (None, 1, 1), (5, None, None), (77, 0, 1)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Labels and benchmark of a few rows, some without id, text or label."""
    folder = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "x y z"), (3, "no such words are anywhere in these texts at all today")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_tables(spark, odd, small, k):  # noqa: F811
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    docs = odd.select("doc_id", "text").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit("own"), "kept": F.lit(1)})
    out = stage(spark, docs, small)
    rows = out.collect()
    if name == "packing":
        of = {r["doc_id"] for r in rows}
        assert of == {i for i, _ in ODD} and sum(r["length"] for r in rows if r["doc_id"] == 1) == 1
        # each row is packed, those that share an id too
        assert sum(r["start"] == 0 for r in rows) == len(ODD)
    else:
        assert out.columns == docs.columns and sum(r["doc_id"] is None for r in rows) == 2
        assert {(r["score"], r["kept"], r["lang"]) for r in rows} == {("own", 1, None)}
        assert len(rows) >= len(ODD) - (2 if name in ("near_dedup", "line_dedup") else 1)
    none = stage(spark, empty(docs), small)
    assert none.count() == 0 and none.columns == out.columns
    # and without labels or benchmark
    blank = small + "-blank"
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").where("false").write.mode("overwrite").parquet(f"{blank}/{t}.parquet")
    assert stage(spark, docs, blank).count() > 0
