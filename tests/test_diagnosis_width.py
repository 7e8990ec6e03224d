"""Failure modes are columns of one aggregate."""

import math

from plumbline.operators import gates


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_diagnosis_is_one_aggregate_without_a_sort(spark):
    specs = {"b": {"s1": (0.0, 0.5)}, "a": {"s1": (0.0, 0.5), "s2": (0.5, 1.0)}, "c": {"s3": (0.0, 1.0)}}
    d = spark.createDataFrame([(1, "s1", 0.5), (1, "s2", 0.75), (2, "s1", 0.75), (3, "s3", None), (4, "zz", 0.1), (5, "s2", 0.0), (6, "s1", math.nan)], "k int, signal string, value double")
    got = gates.diagnose_failures(d, "k", 2, specs)
    assert "Window" not in _plan(got) and got.columns == ["k", "mode", "confidence", "n_signals", "rank"]
    rows = sorted(tuple(r) for r in got.filter("k < 6").collect())
    assert rows == [(1, "a", 1.0, 2, 1), (1, "b", 1.0, 1, 2), (2, "a", 0.5, 1, 1), (2, "b", 0.5, 1, 2), (5, "a", 0.0, 1, 1)]
    assert [(r["mode"], math.isnan(r["confidence"])) for r in got.filter("k = 6").orderBy("rank").collect()] == [("a", True), ("b", True)]
