"""Joins, value maps and cut labels against pandas, and odd values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dpspark.errors import SchemaError
from dpspark.sources import etl


def test_labels_are_those_of_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(-1, 6, 500), [0.0, 1.0, 2.0, 4.0, 5.1, -0.01, 9.0, np.nan]])
    edges, labels = [-0.01, 1.0, 2.0, 4.0, 5.1], ["a", "b", "c", "d"]
    want = pd.cut(x, edges, labels=labels).astype(object)
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "i long, x double")
    got = [r["l"] for r in df.select("i", etl.cut("x", edges, labels).alias("l")).orderBy("i").collect()]
    assert got == [None if pd.isna(v) else v for v in want]
    codes = {1: "male", 2: "female"}
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "c int")
    assert [r[0] for r in df.select(etl.value_map("c", codes)).collect()] == ["male", "female", None, None]
    assert [r[0] for r in df.select(etl.value_map("c", {})).collect()] == [None] * 4


def test_odd_values(spark):
    df = spark.createDataFrame([("3",), ("x",), ("",), (None,), ("nan",), ("1e3",), (" 7 ",)], "v string")
    assert [r[0] for r in df.select(etl.number("v")).collect()] == [3.0, None, None, None, None, 1000.0, 7.0]
    for edges, labels in (([0, 1], []), ([1, 0], ["a"]), ([0, 0], ["a"]), ([0], [])):
        if len(edges) == len(labels) + 1 and edges == sorted(set(edges)):
            continue
        with pytest.raises(SchemaError):
            etl.cut("v", edges, labels)


def test_joins_and_bounds(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None), (None, 1.0), (4, 500.0)], "k long, x double")
    b = spark.createDataFrame([(1, 1, "u"), (2, 1, "v"), (2, 2, "w"), (3, 1, "u"), (4, 9, "u"), (None, 1, "u")], "k long, j long, y string")
    c = spark.createDataFrame([(1, 2, 10), (2, 1, 20), (2, 2, 30), (3, 1, 40), (4, 9, 50)], "k long, j long, z long")
    raw = etl.joined([a, b, c], ["k", ["k", "j"]])
    out = etl.pulled_up(raw, {"x": etl.number("x"), "y": F.col("y")}, {"x": (0, 100)}, {"x": (10, 40)}, ["k", "z"])
    assert sorted(map(tuple, out.collect())) == [(2, 20, 40.0, "v"), (2, 30, 40.0, "w")]
    assert etl.pulled_up(raw.where("false"), {"x": F.col("x")}).count() == 0
    # without a range a null is no bound
    kept = etl.pulled_up(raw, {"x": etl.number("x")}, bounds={"x": (0, 60)}, keep=["k"])
    assert sorted(map(tuple, kept.collect())) == [(2, 50.0), (2, 50.0), (4, 60.0)]
    with pytest.raises(SchemaError):
        etl.joined([a, b], [])
