"""Raking in one task and as distributed aggregates: same weights, margins as asked for."""

import numpy as np
from plumbline.operators import weights as B
from pyspark.sql import functions as F


def test_both_ways_agree_and_meet_the_margins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b) if b else None, int(c)) for a, b, c in zip(rng.integers(0, 4, 900), rng.integers(0, 3, 900), rng.integers(0, 2, 900))]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    margins = B.long_bins(df.filter("a + c <> 3"), ["a", "b", "c"])
    cells = B.cells_of(df, ["a", "b", "c"])
    once = {(r["a"], r["b"], r["c"]): r for r in B.rake_cells(cells, margins, ["a", "c"], tol=1e-10).collect()}
    monkeypatch.setattr(B, "RAKED_AT_ONCE", 0)
    apart = {(r["a"], r["b"], r["c"]): r for r in B.rake_cells(cells, margins, ["a", "c"], tol=1e-10).collect()}
    assert once.keys() == apart.keys() and all(abs(once[k]["w"] - apart[k]["w"]) < 1e-9 and once[k]["iterations"] == apart[k]["iterations"] and once[k]["converged"] for k in once)
    got = {(r["descriptor"], r["bin"]): r["mass"] for r in B.long_bins(spark.createDataFrame(list(once.values())), ["a", "c"], F.col("w") * F.col("n")).collect()}
    want = {(r["descriptor"], r["bin"]): r["mass"] for r in margins.filter("descriptor <> 'b'").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_raking_of_no_cells(spark):
    none = spark.createDataFrame([], "a int, n long")
    assert B.rake_cells(none, spark.createDataFrame([("a", 1, 1.0)], "descriptor string, bin int, mass double"), ["a"]).count() == 0
