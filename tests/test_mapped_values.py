"""Permutation statistics of more units than are broadcast read the values from a file; no draw becomes a row."""

import numpy as np
import pandas as pd

from plumbline.operators import graph as G
from plumbline.operators.replicates import LEAST_HALF, ROUNDS, mix32, places, word


def _answers(spark) -> tuple[list, tuple]:
    n = 60
    units = spark.createDataFrame(pd.DataFrame({"zcta_id": [f"{k:02d}" for k in range(n)], "x": [float(k * k % 17 + k / 9) for k in range(n)]}))
    edges = G.symmetric(spark.createDataFrame(pd.DataFrame({"src": [f"{k:02d}" for k in range(n - 1)], "dst": [f"{k + 1:02d}" for k in range(n - 1)], "weight": 1.0})))
    local, whole = G.local_moran_p(G.local_moran(edges, units, "x"), 199, 3), G.global_autocorrelation_p(edges, units, "x", 199, 5)
    for df, column in ((local, "draw"), (whole, "za")):  # values are looked up inside the tasks, not joined to rows of draws
        assert f"{column}#" not in df._jdf.queryExecution().analyzed().toString()
    return sorted(map(tuple, local.select("zcta_id", "p_sim").collect())), tuple(whole.select("moran_p", "geary_p").first())


def test_values_in_pieces_give_the_same_p(spark, monkeypatch):
    want = _answers(spark)
    monkeypatch.setattr(G, "HELD_VALUES", 0)
    monkeypatch.setattr(G, "PIECE", 25, raising=False)  # three pieces of the file
    assert _answers(spark) == want


def test_narrow_places_equal_wide_ones():
    def wide(x: int, n: int, key: int) -> int:
        half = max(LEAST_HALF, (max(n - 1, 1).bit_length() + 1) // 2)
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for r in range(ROUNDS):
                left, right = right, left ^ (int(mix32(np.uint64(key ^ (right << 4 | r)))) & ((1 << half) - 1))
            x = left << half | right
            if x < n:
                return x

    for n in (1, 5, 1000, 70_001, 2**32, 2**33):
        keys = word(9, np.arange(1, 8)[:, None], 4)
        x = np.broadcast_to(np.arange(min(n, 4)), (7, min(n, 4)))
        assert places(x, n, keys).tolist() == [[wide(int(a), n, int(k)) for a in row] for row, k in zip(x, keys[:, 0])]
