import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.operators.balls import gabriel_graph
from plumbline.operators import spatial as S


def hav(a, b, c, d, r=6371.0):
    p, q = np.radians(a), np.radians(c)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(d - b) / 2) ** 2
    return 2 * r * np.arcsin(np.sqrt(h))


@pytest.fixture(scope="module")
def points(spark):
    """A dense city holding a third of all sites, copies of one position, and points across the date line."""
    g = np.random.default_rng(1)
    lat = np.concatenate([30 + g.normal(0, 0.01, 200), g.uniform(-80, 80, 250), np.full(120, 30.0), g.uniform(-5, 5, 30)])
    lon = np.concatenate([-90 + g.normal(0, 0.01, 200), g.uniform(-180, 180, 250), np.full(120, -90.0), np.where(g.random(30) < 0.5, 179.9, -179.9)])
    s = pd.DataFrame({"site_id": [f"s{i:04d}" for i in range(len(lat))], "lat": lat, "lon": lon, "w": g.integers(1, 9, len(lat)).astype(float), "grp": g.integers(0, 3, len(lat))})
    u = pd.DataFrame({"uid": [f"u{i:03d}" for i in range(80)], "lat": np.concatenate([30 + g.normal(0, 0.05, 40), g.uniform(-80, 80, 40)]), "lon": np.concatenate([-90 + g.normal(0, 0.05, 40), g.uniform(-180, 180, 40)]), "grp": g.integers(0, 3, 80)})
    return s, u, spark.createDataFrame(s), spark.createDataFrame(u)


@pytest.mark.parametrize("k", [1, 5])
def test_k_nearest_matches_brute_force(points, k):
    s, u, sd, ud = points
    got = S.k_nearest(ud, sd, "uid", "site_id", k).toPandas()
    for _, r in u.iterrows():
        d = sorted(zip(np.round(hav(r["lat"], r["lon"], s["lat"].to_numpy(), s["lon"].to_numpy()), 9), s["site_id"]))[:k]
        mine = got[got["uid"] == r["uid"]].sort_values("rank")
        assert np.allclose(mine["dist_km"], [x[0] for x in d], atol=1e-6)
        assert k > 1 or mine["site_id"].iloc[0] == d[0][1]


def test_nearest_of_another_group_and_radius(points):
    s, u, sd, ud = points
    got = S.k_nearest(ud, sd, "uid", "site_id", other=("grp", "grp"), max_km=400.0).toPandas().set_index("uid")["dist_km"]
    for _, r in u.iterrows():
        o = s[s["grp"] != r["grp"]]
        d = hav(r["lat"], r["lon"], o["lat"].to_numpy(), o["lon"].to_numpy()).min()
        assert (abs(got[r["uid"]] - d) < 1e-6) if d <= 400 else r["uid"] not in got.index


def test_within_radius_counts_and_sums(points):
    s, u, sd, ud = points
    got = S.within_radius(ud, sd, "uid", 12.0, "w").toPandas().set_index("uid")
    for _, r in u.iterrows():
        m = hav(r["lat"], r["lon"], s["lat"].to_numpy(), s["lon"].to_numpy()) <= 12.0
        assert got.loc[r["uid"], "n_within"] == m.sum() and abs(got.loc[r["uid"], "weight_within"] - s["w"][m].sum()) < 1e-9


def ring(pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


RING = "array<struct<x:double,y:double>>"


def test_overlay_of_concave_and_reversed_polygons(spark):
    ell = ring([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)])
    a = spark.createDataFrame([("L", ell), ("R", ell[::-1])], f"a string, ring {RING}")
    b = spark.createDataFrame([("sq", ring([(1, 1), (3, 1), (3, 3), (1, 3)])), ("tri", ring([(2, 2), (5, 2), (2, 5)])), ("far", ring([(9, 9), (10, 9), (10, 10)]))], f"b string, ring {RING}")
    got = {(r["a"], r["b"]): round(r["overlap"], 9) for r in S.overlay(a, b, "a", "b").collect()}
    assert got == {("L", "sq"): 3.0, ("R", "sq"): 3.0}
    assert a.select(S.ring_area(F.col("ring")).alias("x")).distinct().collect()[0]["x"] == 12.0


def test_overlap_of_two_concave_rings():
    import pandas as pd

    ell, other = ring([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]), ring([(1, 1), (5, 1), (5, 5), (3, 5), (3, 3), (1, 3)])
    fork, bar = ring([(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]), ring([(-1, 3), (7, 3), (7, 4), (-1, 4)])
    got = S.overlap_area.func(pd.Series([ell, ell, fork, bar, ell]), pd.Series([other, other[::-1], bar, fork, ell]))
    assert got.tolist() == [4.0, 4.0, 4.0, 4.0, 12.0]


def test_polygon_sizes_far_apart_still_meet(spark):
    big = spark.createDataFrame([("big", ring([(-100, -50), (100, -50), (100, 50), (-100, 50)]))], f"p string, ring {RING}")
    tiny = spark.createDataFrame([(f"t{i}", ring([(i, i), (i + 0.001, i), (i, i + 0.001)])) for i in range(-5, 5)], f"t string, ring {RING}")
    assert S.overlay(big, tiny, "p", "t").count() == 10
    pts = spark.createDataFrame([(i, float(i), float(i)) for i in range(-60, 60)], "id int, x double, y double")
    assert S.points_in_polygons(pts, big, "x", "y", "p").count() == 99 or S.points_in_polygons(pts, big, "x", "y", "p").count() == 100


def cycle(spark, values):
    n = len(values)
    e = spark.createDataFrame([(str(i), str((i + 1) % n), 1.0) for i in range(n)], "src string, dst string, weight double")
    return G.row_normalise(G.symmetric(e)), spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "zcta_id string, x double")


def test_moran_of_an_alternating_cycle(spark):
    e, v = cycle(spark, [1.0, -1.0, 1.0, -1.0])
    r = G.global_autocorrelation(e, v, "x").first()
    assert abs(r["moran_i"] + 1) < 1e-12 and abs(r["kappa_spatial"]) < 1e-12


def test_moran_needs_variation_and_three_units(spark):
    for vals in ([2.0] * 5, [1.0, None, None, 2.0]):
        e, v = cycle(spark, vals)
        r = G.global_autocorrelation(e, v, "x").first()
        assert r["moran_i"] is None and r["kappa_spatial"] is None


def test_pair_bins_match_all_pairs(spark):
    g = np.random.default_rng(2)
    p = pd.DataFrame({"x": np.concatenate([g.uniform(0, 10, 150), np.full(80, 3.0)]), "y": np.concatenate([g.uniform(0, 10, 150), np.full(80, 4.0)]), "v": g.normal(size=230)})
    got = G.pair_bins(spark.createDataFrame(p), "x", "y", "v", 0.7, 9, 5).toPandas().set_index("bin")
    i, j = np.triu_indices(len(p), 1)
    d = np.hypot(p["x"].to_numpy()[i] - p["x"].to_numpy()[j], p["y"].to_numpy()[i] - p["y"].to_numpy()[j])
    sq = (p["v"].to_numpy()[i] - p["v"].to_numpy()[j]) ** 2
    for b in range(9):
        m = np.floor(d / 0.7) == b
        assert got.loc[b, "n_pairs"] == m.sum() and abs(got.loc[b, "semivariance"] - sq[m].mean() / 2) < 1e-9


def test_crossings_and_gabriel(spark):
    at = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 1.0), ("c", 0.0, 1.0), ("d", 1.0, 0.0)], "id string, x double, y double")
    e = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "c")], "i string, j string")
    assert G.crossings(e, at).count() == 1
    reg = spark.createDataFrame([("p", [0.0, 0.0]), ("q", [2.0, 0.0]), ("m", [1.0, 0.1])], "id string, vec array<double>")
    assert {(r["i"], r["j"]) for r in gabriel_graph(reg, "id", "vec").collect()} == {("m", "p"), ("m", "q")}


def test_permuted_weights_move_every_chosen_id_and_stay_normalised(spark):
    e, _ = cycle(spark, [0.0] * 12)
    u = spark.createDataFrame([(str(i),) for i in range(12)], "zcta_id string")
    p = G.permute_weights(e, u, [0.0, 1.0], 1)
    base = {(r["src"], r["dst"]) for r in e.collect()}
    assert {(r["src"], r["dst"]) for r in p.filter("level = 0.0").collect()} == base
    full = p.filter("level = 1.0")
    assert full.filter("src = dst").count() == 0
    assert full.groupBy("src").agg(F.sum("weight").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_grown_blocks_cover_every_unit(spark):
    e, _ = cycle(spark, [0.0] * 30)
    u = spark.createDataFrame([(str(i),) for i in range(33)], "zcta_id string")  # three islands
    b = G.grow_blocks(e, u, 4).toPandas()
    assert len(b) == 33 and b["block"].between(0, 3).all() and b["zcta_id"].is_unique


def test_grown_blocks_equal_rounds_of_single_links_in_few_jobs(spark, monkeypatch):
    """A random graph and a chain of 300 units in many parts, against one link per round."""
    monkeypatch.setattr(G, "PART_UNITS", 40)
    cuts, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: (cuts.append(1), cut(df))[1])
    g = np.random.default_rng(11)
    for links in (g.integers(0, 200, (260, 2)), np.stack([np.arange(299), np.arange(1, 300)], 1)):
        links = np.array([(a, b) for a, b in links if a != b])
        names = [f"{i:03}" for i in range(300)]
        e = spark.createDataFrame([(names[a], names[b], 1.0) for a, b in links], "src string, dst string, weight double")
        u = spark.createDataFrame([(i,) for i in names], "zcta_id string")
        cuts.clear()
        got = {r["zcta_id"]: r["block"] for r in G.grow_blocks(e, u, 5).collect()}
        h = {r["zcta_id"]: r["h"] for r in u.select("zcta_id", G.seeded_hash(42, "zcta_id").alias("h")).collect()}
        want = {i: k for k, i in enumerate(sorted(names, key=lambda i: (h[i], i))[:5])}
        both = [(names[a], names[b]) for a, b in links] + [(names[b], names[a]) for a, b in links]
        while True:
            reach = {}
            for a, b in both:
                if a in want and b not in want:
                    reach[b] = min(want[a], reach.get(b, 9))
            if not reach:
                break
            want |= reach
        assert got == {i: want.get(i, h[i] % 5) for i in names}
        assert len(cuts) < 30


def test_block_diameter_is_the_farthest_pair(spark):
    g = np.random.default_rng(4)
    p = pd.DataFrame({"lat": g.uniform(20, 40, 300), "lon": g.uniform(-100, -80, 300), "f": g.integers(0, 3, 300)})
    got = G.block_diameters(spark.createDataFrame(p).repartition(9), "f").toPandas().set_index("fold")["diameter_km"]
    for f, s in p.groupby("f"):
        x, y = s["lon"].to_numpy() * 111.32 * math.cos(math.radians(s["lat"].mean())), s["lat"].to_numpy() * 110.57
        want = np.sqrt(np.subtract.outer(x, x) ** 2 + np.subtract.outer(y, y) ** 2).max()
        assert abs(got[str(f)] - want) < 1e-6


def test_first_polygon_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(S, "FIRST_POLYGONS", 2)
    polys = spark.createDataFrame([(f"p{i:02d}", ring([(i % 5, 0), (i % 5 + 1.5, 0), (i % 5 + 1.5, 1), (i % 5, 1)])) for i in range(30)], f"p string, ring {RING}")
    pts = spark.createDataFrame([(i, i / 4, 0.5) for i in range(40)] + [(40, 0.25, 0.5), (41, None, 0.5)], "id int, x double, y double")
    got = {r["id"]: r["p"] for r in S.first_polygon(pts, polys, "id", "x", "y", "p").collect()}
    inside = lambda x: next((f"p{i:02d}" for i in range(30) if i % 5 <= x < i % 5 + 1.5), None)
    assert got == {i: inside(i / 4) for i in range(40)} | {40: "p00", 41: None}


def test_copies_of_shapes_meet_once_and_count_often(spark, monkeypatch):
    square, met = ring([(0, 0), (2, 0), (2, 2), (0, 2)]), []
    units = spark.createDataFrame([(f"u{i}", square) for i in range(20)], f"u string, ring {RING}")
    zones = spark.createDataFrame([(f"z{i}", ring([(1, 1), (1.5, 1), (1.5, 1.5), (1, 1.5)]), "A" if i < 3 else "X500") for i in range(5)], f"z string, ring {RING}, c string")
    pairs = S.bbox_pairs
    monkeypatch.setattr(S, "bbox_pairs", lambda *a: met.append(pairs(*a)) or met[-1])
    assert S.overlay(units, zones, "u", "z").count() == 100
    assert {(r["pct_zone_a"], r["pct_zone_x500"]) for r in S.zone_percentages(units, zones, "u", "z", "c").collect()} == {(18.75, 12.5)}
    assert [m.count() for m in met] == [1, 2]


def test_overlap_of_touching_shapes_is_zero():
    import pyarrow as pa

    a, b = ring([(0.1, 0.1), (0.4, 0.1), (0.4, 0.7), (0.1, 0.7)]), ring([(0.4, 0.2), (0.9, 0.2), (0.9, 0.3), (0.4, 0.3)])
    assert S.overlap_area.func(pa.array([a, a, None]), pa.array([b, a, b])).to_pylist() == [0.0, pytest.approx(0.18), None]


def test_pair_bins_of_repeated_positions_work_on_places(spark, monkeypatch):
    """30 positions of 40 points each: all pairs counted, from sums of 30 places at the finest level."""
    seen, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: (seen.append(cut(df)), seen[-1])[1])
    g = np.random.default_rng(8)
    at = np.repeat(g.uniform(0, 5, (30, 2)), 40, axis=0)
    p = pd.DataFrame({"x": at[:, 0], "y": at[:, 1], "v": g.normal(5000, 300, 1200)})
    got = G.pair_bins(spark.createDataFrame(p), "x", "y", "v", 0.7, 9, 5).toPandas().set_index("bin")
    i, j = np.triu_indices(1200, 1)
    b = np.floor(np.hypot(*(at[i] - at[j]).T) / 0.7).astype(int)
    d = (p["v"].to_numpy()[i] - p["v"].to_numpy()[j]) ** 2
    for k in range(9):
        if (b == k).any():
            assert got.loc[k, "n_pairs"] == (b == k).sum() and abs(got.loc[k, "semivariance"] - d[b == k].mean() / 2) < 1e-5 * d.mean()
    assert seen[0].count() == 30


def test_basin_edges_make_a_pair_once_without_a_shuffle_of_pairs(spark, monkeypatch):
    """200 regions in chunks against all pairs; what reaches the last exchange is memberships, not pairs."""
    for name, size in (("CHUNK_LEAST", 8), ("STRIP", 5), ("CHUNK", 40)):
        monkeypatch.setattr(S, name, size, raising=False)
    g = np.random.default_rng(3)
    rows = [(f"r{r:03}", int(h), float(w)) for r, h, w in {(r, h): (r, h, w) for r, h, w in zip(g.integers(0, 200, 500), g.integers(0, 9, 500), g.uniform(0, 1, 500).round(3))}.values()]
    m = spark.createDataFrame(rows, "region string, huc int, overlap_frac double")
    want = {}
    for a, h, v in rows:
        for b, k, w in rows:
            if h == k and a < b:
                want[a, b] = max(want.get((a, b), 0), min(v, w))
    edges = S.shared_basin_edges(m, "region", "huc")
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == want and edges.count() == len(want)
    aggregates = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [src" not in aggregates
    flow = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0), (2, 2, 1.0), (3, 4, 1.5), (None, 4, 9.0)], "from_basin int, to_basin int, weight double")
    dom = S.dominant_membership(m, "region", "huc", 0.0)
    for dominant in (dom, dom.withColumn("is_dominant", F.lit(True))):
        d, want = {(r["region"], r["huc"]) for r in dominant.filter("is_dominant").collect()}, {}
        for f, t, w in [(0, 1, 2.0), (1, 0, 3.0), (2, 2, 1.0), (3, 4, 1.5)]:
            for a, h in d:
                for b, k in d:
                    if h == f and k == t and a != b:
                        want[min(a, b), max(a, b)] = max(want.get((min(a, b), max(a, b)), 0), w)
        edges = S.drainage_edges(dominant, flow, "region", "huc")
        got = [(r["src"], r["dst"], r["weight"]) for r in edges.collect()]
        assert len(got) == len(want) and {(a, b): w for a, b, w in got} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_walks_each_level_once_over_counted_tasks(points):
    s, u, sd, ud = points
    plan = _plan(S.k_nearest(ud.withColumnRenamed("grp", "ug"), sd, "uid", "site_id", other=("ug", "grp")))
    assert "REPARTITION_BY_NUM" in plan
    assert "Union" not in plan  # open and closed cells in one chain: a union of both repeats the walk at every level


def test_within_radius_deals_positions(points):
    s, u, sd, ud = points
    assert "REPARTITION_BY_NUM" in _plan(S.within_radius(ud, sd, "uid", 50.0, "w"))


def test_many_sites_in_one_deepest_cell(spark):
    g = np.random.default_rng(3)
    lat, lon = 30 + g.uniform(0, 2e-5, 300), -90 + g.uniform(0, 2e-5, 300)  # a patch of 2 m
    sites = spark.createDataFrame(pd.DataFrame({"site_id": [f"s{i:03d}" for i in range(300)], "lat": lat, "lon": lon}))
    units = pd.DataFrame({"uid": range(20), "lat": 30 + g.uniform(-1e-4, 1e-4, 20), "lon": -90 + g.uniform(-1e-4, 1e-4, 20)})
    for k in (1, 4):
        got = S.k_nearest(spark.createDataFrame(units), sites, "uid", "site_id", k).toPandas().sort_values(["uid", "rank"])
        want = np.sort(np.array([hav(a, b, lat, lon) for a, b in zip(units["lat"], units["lon"])]), axis=1)[:, :k]
        assert np.allclose(got["dist_km"].to_numpy().reshape(20, k), want, atol=1e-6)
