"""Ranks of unit means must not depend on the order in which rows are added."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_point


def _lineitem(rows: int = 6_000, units: int = 40) -> pd.DataFrame:
    r = np.random.default_rng(5)
    return pd.DataFrame({
        "l_orderkey": r.integers(0, 900, rows), "l_partkey": r.integers(0, 50, rows), "l_suppkey": r.integers(0, units, rows), "l_linenumber": r.integers(1, 8, rows).astype(np.int32),
        "l_quantity": r.integers(1, 4, rows).astype(float), "l_returnflag": r.choice(["A", "N"], rows)})


def _correlations(li: pd.DataFrame) -> dict:
    """Spearman's rho of exact means and losses by (event, level)."""
    ln = li["l_linenumber"].astype(int)
    tenths = (li["l_quantity"] * 10).astype(int) + ((li["l_partkey"] * 31 + ln * 17 + li["l_orderkey"]) % 41 - 20) * (2 + ln)
    loss = (li["l_quantity"] * (1 + li["l_orderkey"] % 5)).groupby(li["l_suppkey"]).sum()
    out = {}
    for key, g in tenths.groupby([li["l_returnflag"], "r" + ((ln + 1) // 2).astype(str)]):
        per = g.groupby(li["l_suppkey"]).agg(["sum", "count"])
        exact = {u: Fraction(int(s), int(n)) for u, s, n in per.itertuples()}
        place = {v: k for k, v in enumerate(sorted(set(exact.values())))}
        ranks = pd.Series({u: place[v] for u, v in exact.items()}).rank()
        out[key] = (ranks.corr(loss.loc[ranks.index].rank()), len(ranks))
    return out


def _in_two_orders(spark, tmp_path, name: str):
    li = _lineitem()
    answers = []
    for k, part in enumerate((li, li.sample(frac=1, random_state=3))):
        folder = tmp_path / str(k)
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
        answers.append(sorted(map(tuple, entry_point.queries()[name](spark, str(folder)).collect())))
    return li, answers


def test_event_validation_ranks_exact_means(spark, tmp_path):
    li, (first, second) = _in_two_orders(spark, tmp_path, "r20_event_validation")
    assert first == second
    want = _correlations(li)
    assert {(e, l): (pytest.approx(rho, abs=2e-8), n) for e, l, rho, n in first} == want


def test_validation_robustness_uses_exact_means(spark, tmp_path):
    li, (first, second) = _in_two_orders(spark, tmp_path, "r20_validation_robustness")
    assert first == second
    rho = pd.Series({k: r for k, (r, _) in _correlations(li).items()}).unstack()  # events x levels
    best = rho.idxmax(axis=1).value_counts()
    want = [(lv, *(pytest.approx(x, abs=2e-7) for x in (c.mean(), c.median(), c.min(), c.max())), len(c), best.get(lv, 0)) for lv, c in rho.items()]
    assert first == sorted(want, key=lambda r: r[0])
