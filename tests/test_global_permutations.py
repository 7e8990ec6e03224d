"""Permuted global statistics: an edge and its reverse are evaluated once, next to edges of near places."""

import pandas as pd

from plumbline.operators import graph as G


def test_reversed_edges_count_once(spark):
    units = spark.createDataFrame(pd.DataFrame({"zcta_id": [f"{k:02d}" for k in range(30)], "x": [float(k * k % 17) for k in range(30)]}))
    edges = spark.createDataFrame(pd.DataFrame({"src": [f"{k:02d}" for k in range(29)], "dst": [f"{k + 1:02d}" for k in range(29)], "weight": 1.0}))
    both = G.global_autocorrelation_p(G.symmetric(edges), units, "x", 99, 7)
    assert "least(src_pos" in both._jdf.queryExecution().executedPlan().toString()
    assert tuple(both.select("moran_p", "geary_p").first()) == tuple(G.global_autocorrelation_p(edges, units, "x", 99, 7).select("moran_p", "geary_p").first())
