import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import ranking as R
from plumbline.operators.graph import bh_adjust
from plumbline.operators.inference import clopper_pearson, holm_adjust, kendall_tau_b, krippendorff_alpha, signed_rank, wilcoxon_exact


def frame(spark, seed=0, n=500):
    g = np.random.default_rng(seed)
    p = pd.DataFrame({"id": range(n), "grp": g.integers(0, 3, n), "x": g.integers(0, 40, n) / 4.0, "y": g.integers(0, 60, n) / 3.0})
    p.loc[p.index % 3 == 0, "x"] = 5.0  # one value holds a third of all rows
    return p, spark.createDataFrame(p)


def test_average_ranks_match_pandas_with_a_hot_value(spark):
    p, d = frame(spark)
    got = R.with_avg_rank(d, ["grp"], "x", "r").toPandas().set_index("id").sort_index()["r"]
    want = p.groupby("grp")["x"].rank(method="average")
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_text_ranks_sort_like_text(spark):
    ids = [f"unit-{i:05d}" for i in range(300)] + ["unit-00007x"]
    d = spark.createDataFrame([(i,) for i in ids], "id string").repartition(7)
    got = {r["id"]: r["below"] for r in R.value_ranks(d, [], "id").collect()}
    assert [got[i] for i in sorted(ids)] == list(range(len(ids)))


def test_quantiles_match_numpy(spark):
    p, d = frame(spark, 3)
    got = R.quantiles(d, ["grp"], "y", {"a": 0.1, "b": 0.5, "c": 0.99}).toPandas().set_index("grp")
    for g, s in p.groupby("grp")["y"]:
        assert np.allclose(got.loc[g, ["a", "b", "c"]].to_numpy(float), np.quantile(s, [0.1, 0.5, 0.99]))


def test_hash_order_is_dense_and_independent_of_partitioning(spark):
    _, d = frame(spark)
    a = {(r["grp"], r["id"]): r["pos"] for r in R.hash_order(d, ["grp"], "id", 7).collect()}
    b = {(r["grp"], r["id"]): r["pos"] for r in R.hash_order(d.repartition(13, "y"), ["grp"], "id", 7).collect()}
    assert a == b
    for g in range(3):
        pos = sorted(v for (k, _), v in a.items() if k == g)
        assert pos == list(range(len(pos)))


def tau(x, y):
    sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    return (sx * sy).sum() / np.sqrt((sx * sx).sum() * (sy * sy).sum())


def test_tau_b_matches_pair_counting(spark):
    p, d = frame(spark, 5, 200)
    got = kendall_tau_b(d, ["grp"], "x", "y").toPandas().set_index("grp")["tau_b"]
    for g, s in p.groupby("grp"):
        assert abs(got[g] - tau(s["x"].to_numpy(), s["y"].to_numpy())) < 1e-9


def test_perfect_and_reversed_order(spark):
    d = spark.createDataFrame([(float(i), float(i), float(-i)) for i in range(20)], "a double, b double, c double")
    assert kendall_tau_b(d, [], "a", "b").first()["tau_b"] == 1.0
    assert kendall_tau_b(d, [], "a", "c").first()["tau_b"] == -1.0
    assert abs(R.spearman(d, [], "a", "c").first()["rho"] + 1) < 1e-12


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.03]
    d = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    order = np.argsort(p, kind="stable")
    bh, holm = np.empty(6), np.empty(6)
    low, high = 1.0, 0.0
    for k in range(5, -1, -1):
        low = min(low, p[order[k]] * 6 / (k + 1))
        bh[order[k]] = low
    for k in range(6):
        high = max(high, min(1.0, p[order[k]] * (6 - k)))
        holm[order[k]] = high
    assert np.allclose(bh_adjust(d, "p").orderBy("i").toPandas()["p_adj"], bh)
    assert np.allclose(holm_adjust(d, "p").orderBy("i").toPandas()["p_holm"], holm)


def test_auc_of_a_perfect_score(spark):
    d = spark.createDataFrame([(float(i), i >= 5) for i in range(10)], "s double, y boolean")
    r = R.roc_pr_auc(d, [], "s", F.col("y")).first()
    assert r["roc_auc"] == 1.0 and abs(r["pr_auc"] - 1.0) < 1e-12


def test_clopper_pearson_known_bounds(spark):
    rows = {(r["k"], r["n"]): (r["ci"]["lower"], r["ci"]["upper"]) for r in spark.createDataFrame([(0, 10), (10, 10), (5, 10)], "k int, n int").withColumn("ci", clopper_pearson("k", "n")).collect()}
    assert rows[(0, 10)][0] == 0 and abs(rows[(0, 10)][1] - (1 - 0.025 ** 0.1)) < 1e-9
    assert rows[(10, 10)][1] == 1 and abs(rows[(10, 10)][0] - 0.025 ** 0.1) < 1e-9
    assert abs(rows[(5, 10)][0] - 0.187086) < 1e-5 and abs(rows[(5, 10)][1] - 0.812914) < 1e-5


def test_signed_rank_exact(spark):
    d = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4, -5)], "d double")
    r = signed_rank(d, [], "d").first()
    assert (r["w_plus"], r["w_minus"], r["wilcoxon_stat"]) == (10.0, 5.0, 5.0)
    assert abs(r["wilcoxon_p"] - 0.625) < 1e-12


def test_krippendorff(spark):
    full = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", None)], "x string, y string")
    assert krippendorff_alpha(full, ["x", "y"]).first()["alpha"] == 1.0
    mixed = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "a")], "x string, y string")
    assert abs(krippendorff_alpha(mixed, ["x", "y"]).first()["alpha"] - (1 - 7 * 4 / 32)) < 1e-12


def test_sign_flips_by_enumeration(spark):
    from itertools import product

    from plumbline.operators import resample as R

    rng = np.random.default_rng(6)
    rows, want = [], {}
    for g, n in (("a", 6), ("b", 11), ("tied", 9)):
        d = np.round(rng.normal(0.3, 1, n), 1) if g != "tied" else np.ones(n)
        rows += [(g, f"{g}{i}", float(x)) for i, x in enumerate(d)]
        null = np.array([np.mean(np.abs(d) * s) for s in product((-1, 1), repeat=n)])
        want[g] = (np.mean(null >= d.mean() - 1e-12), np.mean(np.abs(null) >= abs(d.mean()) - 1e-12))
    df = spark.createDataFrame(rows, "g string, k string, d double")
    for which, alternative in enumerate(("greater", "two-sided")):
        got = {r["g"]: (r["method"], r["p_value"]) for r in R.sign_flip_p(df, ["g"], "d", "k", alternative=alternative).collect()}
        assert all(got[g][0] == "exact" and abs(got[g][1] - want[g][which]) < 1e-12 for g in want)


def test_sign_flips_beyond_the_exact_range(spark):
    from plumbline.operators import resample as R

    rows = [("same", i, 1.0) for i in range(24)] + [("none", i, (-1.0) ** i) for i in range(24)]
    df = spark.createDataFrame(rows, "g string, k long, d double")
    got = {r["g"]: r for r in R.sign_flip_p(df, ["g"], "d", "k").collect()}
    assert got["same"]["method"] == "sampled" and got["same"]["p_value"] == 1 / 1000  # equal differences flip apart
    assert got["none"]["p_value"] > 0.3
    assert {r["method"] for r in R.sign_flip_p(df, ["g"], "d", "k", reps=0).collect()} == {"none"}
    twenty = df.filter("g = 'same' and k < 20").drop("g")
    r = R.sign_flip_p(twenty, [], "d", "k").first()
    assert (r["n"], r["method"]) == (20, "exact") and abs(r["p_value"] - 2.0**-20) < 1e-12


def test_draws_reach_beyond_32_bits(spark):
    from plumbline.functions.core import seeded_hash

    n = 1 << 40
    got = [r[0] for r in spark.range(2000).select(F.pmod(seeded_hash(1, "id"), F.lit(n))).collect()]
    assert sum(x >= 1 << 39 for x in got) in range(900, 1100) and len(set(got)) == 2000


def test_queue_places_with_ties_and_one_large_group(spark):
    from plumbline.operators.served import positions

    g = np.random.default_rng(9)
    n = 3000
    p = pd.DataFrame({"s": np.where(np.arange(n) % 10 > 0, "hot", "b"), "a": g.integers(0, 3, n), "b": g.integers(0, 2, n), "id": [f"unit-with-a-long-prefix-{x:04d}" for x in g.integers(0, 1500, n)]})
    got = positions(spark.createDataFrame(p), ["s"], [F.col("a"), F.col("b")], "id").toPandas()
    want = p.assign(k=list(zip(p["a"], p["b"], p["id"])))
    want["place"] = want.groupby("s")["k"].rank(method="min").astype(int)
    assert sorted(zip(got["s"], got["a"], got["b"], got["id"], got["ordinal_position"])) == sorted(zip(want["s"], want["a"], want["b"], want["id"], want["place"]))
