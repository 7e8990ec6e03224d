import gzip
import json
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import folds as D
from plumbline.operators import served as V
from plumbline.operators import tables as T
from plumbline.plans.standins import Tables
from plumbline.sources import readers as R
from plumbline.sources import writers as X
from plumbline.streaming import twins as S


@pytest.fixture
def home(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


@pytest.fixture(scope="module")
def units(spark):
    rows = [(f"{i:05d}", f"c{min(i // 10, 12)}", f"s{i % 7}", "q" + str(i % 3)) for i in range(200)]
    return spark.createDataFrame(rows, "zcta_id string, county_fips string, state_fips string, seg string")


def test_folds_keep_blocks_whole(units):
    f = D.spatial_folds(units, 4).toPandas()
    assert len(f) == 200 and f.groupby("merged")["fold"].nunique().max() == 1
    assert f.groupby("fold").size().min() >= D.MIN_FOLD
    again = D.spatial_folds(units.repartition(9), 4).toPandas()
    assert dict(zip(f["zcta_id"], f["fold"])) == dict(zip(again["zcta_id"], again["fold"]))


def lightest(items, loads):
    """Bin of each (name, size) in turn, by a heap-free scan."""
    loads, where = dict(loads), {}
    for name, size in items:
        where[name] = min(loads, key=lambda b: (loads[b], b))
        loads[where[name]] += size
    return where, loads


def test_small_blocks_join_the_lightest(spark):
    r = random.Random(3)
    for n, low in ((12, 5), (30, 5), (6, 50), (5, 0)):
        size = {f"b{i:02d}": r.randint(1, 12) for i in range(n)}
        big = {b: v for b, v in size.items() if v >= low}
        small = sorted((b for b in size if b not in big), key=lambda b: (-size[b], b))
        want = {b: b for b in size} | (lightest([(b, size[b]) for b in small], big)[0] if big else {})
        sizes = spark.createDataFrame([(b, v, r.randrange(1000)) for b, v in size.items()], "block string, n long, h long")
        merged = D.merge_targets(sizes, low)
        assert {x["block"]: x["merged"] for x in merged.collect()} == want
        groups, draw = {}, {x["block"]: x["h"] for x in sizes.collect()}
        for b, t in want.items():
            groups[t] = groups.get(t, 0) + size[b]
        order = sorted(groups, key=lambda t: (draw[t], t))
        for k in (4, 3, 2):
            place, loads = lightest([(t, groups[t]) for t in order], {f: 0 for f in range(k)})
            if k <= len(groups) and min(loads.values()) >= 9:
                break
        assert {x["merged"]: x["fold"] for x in D.place_folds(merged, 4, 9).collect()} == place


def test_counties_are_balanced_by_stratum(spark):
    r = random.Random(4)
    rows = [(f"{i:03d}", r.choice("abc"), r.randint(1, 9), r.randrange(50)) for i in range(40)]
    own, whole, want = {}, [0] * 3, {}
    for c, s, n, _ in sorted(rows, key=lambda x: (x[3], x[0])):
        load = own.setdefault(s, [0] * 3)
        want[c] = f = min(range(3), key=lambda i: (load[i], whole[i], i))
        load[f] += n
        whole[f] += n
    got = D.balance_by_stratum(spark.createDataFrame(rows, "county_fips string, stratum string, n_zctas int, h long"), 3)
    assert {x["county_fips"]: x["fold"] for x in got.collect()} == want


def test_splits_do_not_leak(units):
    c = D.county_summary(units, "seg")
    i = D.imputation_split(units, c, 3).join(units, "zcta_id")
    assert D.split_leaks(i, "county_fips", "split_imputation").count() == 0
    e = D.extrapolation_split(units, ["s1"], 3).join(units, "zcta_id")
    assert D.split_leaks(e, "state_fips", "split_extrapolation").count() == 0
    assert {r["split_extrapolation"] for r in e.filter("state_fips = 's1'").collect()} == {"test"}
    with pytest.raises(ValueError):
        D.get_split(i, "imputation", 9)


def test_readers_round_trip(spark, home):
    spark.createDataFrame([("7", 1.0, float("nan")), ("12345", 2.0, 3.0)], "zcta_id string, acs_x double, y double").write.parquet(f"{home}/u")
    u = R.load_units(spark, f"{home}/u").orderBy("zcta_id").collect()
    assert u[0]["zcta_id"] == "00007" and u[0]["y"] is None
    spark.createDataFrame([("7", -1.0)], "zcta_id string, acs_x double").write.parquet(f"{home}/bad")
    with pytest.raises(ValueError, match="negative"):
        R.load_units(spark, f"{home}/bad")
    assert R.load_enrichment(spark, f"{home}/nothing") is None
    pd.DataFrame({"zcta_id": ["1"], "dateOfLoss": ["2017-01-02"]}).to_parquet(f"{home}/claims_dr12.parquet")
    pd.DataFrame({"zcta_id": ["2"], "dateOfLoss": ["bad"], "extra": [1]}).to_parquet(f"{home}/claims_dr34.parquet")
    c = {r["zcta_id"]: r for r in R.load_claims(spark, f"{home}/claims_dr*.parquet").collect()}
    assert c["00001"]["dr_number"] == 12 and c["00002"]["dateOfLoss"] is None and c["00002"]["extra"] == 1


def test_tracks_and_storm_events(spark, home):
    import os

    os.makedirs(home)
    with open(f"{home}/t.txt", "w") as f:
        f.write("AL092017,             HARVEY,      2,\n20170817, 0600,  , TD, 13.7N,  45.8W,  30, 1007,\n20170825, 1800, L, HU, 27.1S,  97.3E, -999, 943,\nAL112017,  IRMA, 1,\n20170830, 0000,  , TS, 16.1N, 26.9W, 30, 1008,\n")
    t = R.load_tracks(spark, f"{home}/t.txt", ["AL092017"]).orderBy("timestamp").collect()
    assert [(r["storm_name"], r["lat"], r["lon"], r["max_wind_kt"]) for r in t] == [("HARVEY", 13.7, -45.8, 30), ("HARVEY", -27.1, 97.3, None)]
    with gzip.open(f"{home}/e.csv.gz", "wt") as f:
        f.write("EVENT_TYPE,CZ_TYPE,STATE_FIPS,CZ_FIPS,YEAR,DAMAGE_PROPERTY,DAMAGE_CROPS,DEATHS_DIRECT,DEATHS_INDIRECT,INJURIES_DIRECT,INJURIES_INDIRECT\nflash flood,C,6,37,2017,1.5M,,1,x,0,2\nHail,C,6,37,2017,1K,,0,0,0,0\n")
    e = R.load_storm_events(spark, f"{home}/e.csv.gz").collect()
    assert [tuple(r) for r in e] == [("06037", 2017, 1500.0, 0.0, 1, 2)]


def test_envelopes_and_runs(spark, home):
    import os

    os.makedirs(home)
    json.dump({"phase": "certificates_r1", "preset_id": "p", "certificates": [{"scenario": "h", "target": "t", "R": 0.5}]}, open(f"{home}/a.json", "w"))
    json.dump({"phase": "4_diagnostics"}, open(f"{home}/b.json", "w"))
    open(f"{home}/c.json", "w").write("{not json")
    rows = R.load_envelopes(spark, home).collect()
    assert sorted(r["status"] for r in rows) == ["MALFORMED_JSON", "OK", "OTHER"]
    ok = [r for r in rows if r["status"] == "OK"][0]
    assert (ok["kind"], ok["level"], ok["R"]) == ("certificates", "r1", 0.5)
    with pytest.raises(ValueError):
        R.load_envelopes(spark, home, strict=True)
    runs = {"runs": [{"scenario": "h", "target": "t", "task": "regression", "solver": s, "metrics": {"r2": v}} for s, v in (("a", 0.2), ("b", 0.4), ("c", None))]}
    r = R.run_cells(spark.createDataFrame([(json.dumps(runs),)], "v string"), "v").first()
    assert (r["best_metric"], r["solver"], r["n_folds"], r["n_null_folds"], r["status"]) == (0.4, "b", 3, 1, "VALID")


def test_release_is_in_z_order_and_hashed(spark, home):
    u = spark.createDataFrame([(str(i), float(i % 8), float(i // 8)) for i in range(64)], "zcta_id string, lon double, lat double")
    X.write_release(u, u.select("zcta_id"), f"{home}/r", 2)
    assert spark.read.parquet(f"{home}/r").count() == 64
    m = X.manifest(spark, f"{home}/r/*.parquet").collect()
    assert len(m) >= 1 and all(len(r["sha256"]) == 64 and r["size_bytes"] > 0 for r in m)
    p = X.write_with_provenance(u, f"{home}/w", ["x"]).first()
    assert p["n_rows"] == 64 and p["columns"] == u.columns


def test_fan_out_and_many_to_one(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    dup = spark.createDataFrame([("a", 2), ("a", 1)], "k string, v int")
    assert {r["k"]: r["v"] for r in T.enrich(left, {"d": dup}, ["k"]).collect()} == {"a": 1, "b": None}
    with pytest.raises(T.FanOut):
        T.enrich(left, {"d": dup}, ["k"], on_fan_out="abort")
    with pytest.raises(Exception, match="repeated key"):
        T.many_to_one(left, dup, "k").collect()


def test_served_errors_and_schema(spark, small):
    t = Tables(spark, small)
    with pytest.raises(V.UnknownScenario):
        V.select_event_checked(spark, t.scenarios, t.snapshots, "nowhere")
    with pytest.raises(V.SnapshotNotAvailable):
        V.select_snapshot_checked(spark, t.snapshots, t.certificate, "storm_A", 999)
    with pytest.raises(V.InsufficientScenarios):
        V.summarize_portfolio_checked(spark, t.session_decision.filter("scenario_id = 'storm_A'"), t.certificate, t.scenarios, "session-24")
    with pytest.raises(V.PortfolioUnavailable):
        V.list_scenarios_checked(spark, t.scenarios.limit(2), t.snapshots, t.scenario_zctas)
    s = V.empty_schema(spark)
    assert s["certificate"].schema["r"].nullable is False and len(s) == 18
    row = [{"scenario_id": "a", "snapshot_t": 24}]
    once = V.seed_registry(s["scenario_snapshots"], row, ["scenario_id", "snapshot_t"])
    assert V.seed_registry(once, row, ["scenario_id", "snapshot_t"]).count() == 1


def test_streams_over_several_batches_equal_the_batch(spark, home):
    base = spark.createDataFrame([(i % 5, i, float(i % 7)) for i in range(300)], "k int, i int, v double")
    for n in range(3):
        base.filter(F.col("i") % 3 == n).coalesce(1).write.mode("append").parquet(f"{home}/in")
    stream = S.file_stream(spark, f"{home}/in", "*.parquet", per_trigger=1)
    got = {r["k"]: (r["claim_count"], r["total_loss"]) for r in S.run_upsert(S.running_totals(stream, ["k"], F.col("v")), ["k"], "t").collect()}
    want = {r["k"]: (r["n"], r["s"]) for r in base.filter("v > 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()}
    assert got == want


def test_a_repeated_batch_changes_nothing(spark, home):
    t = S.VersionedTable(spark, home, ["k"])
    a, b = spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"), spark.createDataFrame([(2, 2)], "k int, v int")
    t.put(a, 0)
    t.put(b, 1)
    t.put(spark.createDataFrame([(2, 9)], "k int, v int"), 1)
    assert {r["k"]: r["v"] for r in t.read().collect()} == {1: 1, 2: 2}
