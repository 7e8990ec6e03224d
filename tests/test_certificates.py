import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import certificates as C
from plumbline.operators import clean
from plumbline.operators import gates as G
from plumbline.operators import resample as R
from plumbline.operators import weights as B
from plumbline.operators.aggregate import history_before
from plumbline.operators.inference import checkability, ridge_out_of_block


def test_simplex_of_missing_metric_is_all_noise(spark):
    d = spark.createDataFrame([(None, 0.5, "regression"), (0.6, 0.8, "regression"), (0.75, 0.7, "classification"), (-0.2, 0.1, "regression")], "s double, r double, t string")
    rows = d.select(*[e.alias(k) for k, e in C.simplex_from_metrics("s", "r", "t").items()]).collect()
    assert tuple(rows[0]) == (0.0, 0.0, 1.0)
    assert np.allclose(rows[1], (0.6, 0.25, 0.15)) and np.allclose(rows[2], (0.5, 0.0, 0.5)) and np.allclose(rows[3], (0.0, 1.0, 0.0))
    assert all(abs(sum(r) - 1) < 1e-12 for r in rows)


def test_coherence_of_agreeing_folds(spark):
    d = spark.createDataFrame([("a", v) for v in (0.5, 0.5, 0.5)] + [("b", 0.2), ("c", 0.4), ("c", -0.1), ("c", 0.2), ("c", 0.3)], "cell string, m double")
    r = {x["cell"]: x for x in C.coherence(d, ["cell"], "m").collect()}
    assert r["a"]["coherence"] == 1.0
    assert r["b"]["coherence"] is None and r["b"]["coherence_status"] == "NOT_COMPUTED_INSUFFICIENT_FOLDS"
    assert abs(r["c"]["coherence"] - (0.6 * 0.75 + 0.4 * (1 - 0.2 / 0.5))) < 1e-9


def test_capped_weights(spark):
    d = spark.createDataFrame([([0.9, 0.1, 0.02],), ([0.3],), ([0.0, 0.0],), ([1.0, 1.0],)], "raw array<double>")
    w = [r["w"] for r in d.select(C.capped_weights(F.col("raw")).alias("w")).collect()]
    assert np.allclose(w[0], [0.6, 0.4 * 2 / 3, 0.4 / 3]) and w[1] == [1.0] and np.allclose(w[2], [0.5, 0.5]) and np.allclose(w[3], [0.5, 0.5])


def cert(**kw):
    return {"alpha": 0.5, "N": 0.3, "kappa_compat": 0.8, "sigma": 0.1, "coherence": None, "kappa_L": None, "noise_admissibility": None, **kw}


GEO, UNI = G.PRESETS["GEOSPATIAL_CONUS27"], G.PRESETS["UNIVERSAL"]
CASES = [
    (GEO, cert(N=0.55, alpha=0.25), "REJECT"), (GEO, cert(N=0.60, alpha=0.45), "EXECUTE"), (GEO, cert(N=0.20, alpha=0.25), "EXECUTE"), (GEO, cert(N=0.80, alpha=0.20, noise_admissibility=0.40), "EXECUTE"),
    (GEO, cert(coherence=0.10), "BLOCK"), (GEO, cert(), "EXECUTE"), (UNI, cert(), "BLOCK"), (GEO, cert(kappa_compat=0.20, sigma=0.20), "RE_ENCODE"), (GEO, cert(kappa_compat=0.215, sigma=0.20), "EXECUTE"),
    (GEO, cert(kappa_compat=0.215, sigma=0.45), "RE_ENCODE"), (GEO, cert(kappa_L=0.10), "REPAIR"), (GEO, cert(kappa_compat=None), "BLOCK"), (UNI, cert(coherence=0.9, kappa_compat=0.95), "EXECUTE"),
]


def test_gate_decisions(spark):
    schema = "id int, alpha double, N double, kappa_compat double, sigma double, coherence double, kappa_L double, noise_admissibility double"
    for p in (GEO, UNI):
        rows = [(i, *[c[k] for k in ("alpha", "N", "kappa_compat", "sigma", "coherence", "kappa_L", "noise_admissibility")]) for i, (q, c, _) in enumerate(CASES) if q is p]
        got = {r["id"]: r["decision"] for r in G.gate_decision(spark.createDataFrame(rows, schema), p).collect()}
        assert got == {i: want for i, (q, _, want) in enumerate(CASES) if q is p}


def test_trace_scores(spark):
    step = "array<struct<tool_name:string,tool_group:string,args:map<string,string>,valid:boolean,success:boolean>>"
    s = lambda n, g, a=None: (n, g, a or {}, True, True)
    rows = [("same", [s("a", "x", {"k": "1"}), s("b", "y")], [s("a", "x", {"k": "1"}), s("b", "y")]), ("swap", [s("b", "y"), s("a", "x", {"k": "2"})], [s("a", "x", {"k": "1"}), s("b", "y")])]
    r = {x["id"]: x for x in G.process_score(spark.createDataFrame(rows, f"id string, pred {step}, gold {step}"), "id").collect()}
    # a call without arguments scores no key, as an empty union counts as one missing key
    assert r["same"]["category_f1"] == 1 and r["same"]["order_score"] == 1 and abs(r["same"]["arg_acc"] - 0.5) < 1e-12
    assert abs(r["swap"]["order_score"] - (1 + 1 + 0.5) / 3) < 1e-12 and abs(r["swap"]["arg_acc"] - 0.25) < 1e-12


def test_claim_on_the_cutoff_is_excluded(spark):
    c = spark.createDataFrame([("00001", "2017-08-24", 10.0), ("00001", "2017-08-25", 100.0), ("00001", "2018-01-01", 7.0)], "zcta_id string, d string, building double").withColumn("claim_date", F.to_timestamp("d"))
    e = spark.createDataFrame([("h", "2017-08-25"), ("i", "2019-01-01")], "event string, s string").withColumn("start", F.to_timestamp("s")).drop("s")
    u = spark.createDataFrame([("00001",), ("00002",)], "zcta_id string")
    r = {(x["zcta_id"], x["event"]): (x["historical_frequency"], x["historical_severity"]) for x in history_before(c, e, u).collect()}
    assert r == {("00001", "h"): (1, 10.0), ("00001", "i"): (3, 39.0), ("00002", "h"): (0, 0.0), ("00002", "i"): (0, 0.0)}


@pytest.fixture(scope="module")
def shifted(spark):
    g = np.random.default_rng(3)
    d1 = g.choice(5, 3000, p=[0.3, 0.3, 0.2, 0.1, 0.1])
    d2 = np.where(g.random(3000) < 0.8, d1, g.choice(5, 3000))
    v = pd.DataFrame({"d1": d1, "d2": d2})
    return spark.createDataFrame(v), spark.createDataFrame(pd.DataFrame({"d1": g.choice(5, 3000), "d2": g.choice(5, 3000)}))


def test_raking_closes_the_margin_gap_and_the_product_does_not(shifted):
    v, t = shifted
    cols = ["d1", "d2"]
    cells, target = B.cells_of(v, cols), B.long_bins(t, cols)
    gap = lambda c: B.margin_gap(B.long_bins(c, cols, F.col("w") * F.col("n")), target).first()[0]
    raked = B.rake_cells(cells, target, cols)
    assert gap(raked) < 1e-5 < gap(B.product_cells(cells, target, cols))
    assert raked.first()["converged"]
    rows = B.attach(v, B.shrink_cells(raked, 0.2), cols)
    assert abs(rows.agg(F.sum("weight")).first()[0] - 1) < 1e-9 and rows.count() == 3000


def test_target_only_bin_is_a_coverage_failure(spark, shifted):
    v, _ = shifted
    t = v.unionByName(v.withColumn("d1", F.lit(9)))
    d = B.decompose(v, t, ["d1"], ladder={"x": B.Stack()}).first()
    assert d["stack_status"] == "FAIL_COVERAGE" and abs(d["max_uncovered_target_mass"] - 0.5) < 1e-9


def test_bootstrap_does_not_depend_on_partitioning(spark):
    g = np.random.default_rng(5)
    p = pd.DataFrame({"b": g.integers(0, 9, 400).astype(str), "y_true": g.normal(size=400)})
    p["y_pred"] = p["y_true"] + g.normal(size=400) * 0.3
    d = spark.createDataFrame(p).withColumn("k", F.lit(1))
    one = {r["rep"]: round(r["r2"], 9) for r in R.block_bootstrap_r2(d, ["k"], "b", 25).collect()}
    two = {r["rep"]: round(r["r2"], 9) for r in R.block_bootstrap_r2(d.repartition(11), ["k"], "b", 25).collect()}
    assert one == two and len(set(one.values())) > 5


def test_ridge_matches_a_direct_solve(spark):
    g = np.random.default_rng(6)
    z, blk = g.normal(size=(120, 4)), g.integers(0, 3, 120)
    y = z @ [1.0, -2.0, 0.5, 0.0] + g.normal(size=120) * 0.1
    d = spark.createDataFrame([(i, int(blk[i]), z[i].tolist(), [float(y[i])]) for i in range(120)], "id int, b int, z array<double>, ys array<double>").repartition(5)
    got = ridge_out_of_block(d, "b", "id", "z", "ys").toPandas().set_index("id")
    for b in range(3):
        m = blk != b
        w = np.linalg.solve(z[m].T @ z[m] + np.eye(4), z[m].T @ y[m])
        for i in np.where(~m)[0]:
            assert abs(got.loc[i, "predicted"][0] - z[i] @ w) < 1e-8
    c = checkability(d.withColumn("y", F.col("ys")[0]).drop("ys"), "b", "id", "z", "y", 9).first()
    assert c["observed_r2"] > 0.9 and c["p_value"] == 0.1


def test_unknown_boolean_token_raises(spark):
    d = spark.createDataFrame([("yes",), ("maybe",)], "flag string")
    with pytest.raises(Exception, match="unknown boolean token"):
        d.filter(clean.Rule("flag", "truthy").test(d)).collect()
    with pytest.raises(clean.MissingLayer):
        clean.Rule("none", "notnull").test(d)
    with pytest.raises(clean.EmptyDomain):
        clean.Domain("x", (clean.Rule("flag", "eq", "no"),)).select_checked(d)


def test_raked_weights_by_plain_fitting(spark):
    import numpy as np

    from plumbline.operators import weights as B

    g = np.random.default_rng(12)
    v = [(int(a), int(b)) for a, b in zip(g.choice(4, 400, p=[0.4, 0.3, 0.2, 0.1]), g.choice(3, 400, p=[0.6, 0.3, 0.1]))]
    t = [(int(a), int(b)) for a, b in zip(g.choice(4, 900), g.choice(3, 900, p=[0.2, 0.3, 0.5]))]
    cols = ["d1", "d2"]
    frame = lambda rows: spark.createDataFrame(rows, "d1 int, d2 int")
    got = B.rake_cells(B.cells_of(frame(v), cols), B.long_bins(frame(t), cols), cols).collect()
    n = np.zeros((4, 3))
    np.add.at(n, tuple(np.array(v).T), 1)
    goal = [np.bincount([x[k] for x in t], minlength=m) / len(t) for k, m in ((0, 4), (1, 3))]
    w, steps = np.ones((4, 3)), 0
    while True:
        steps, old = steps + 1, w.copy()
        for axis in (0, 1):
            have = (w * n).sum(axis=1 - axis)
            f = np.clip((w * n).sum() * goal[axis] / have, 0.1, 10)
            w = w * (f[:, None] if axis == 0 else f[None, :])
        if np.abs(w / old - 1).max() < 1e-6:
            break
    assert all(r["converged"] and r["iterations"] == steps and abs(r["w"] - w[r["d1"], r["d2"]]) < 1e-7 for r in got) and len(got) == (n > 0).sum()
