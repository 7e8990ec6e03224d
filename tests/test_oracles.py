"""Registered queries against their SQL on the smallest tables (all of them with PLUMBLINE_ALL=1)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "a01_claims_by_unit", "a03_history_before_cutoff", "a08_tide_peaks", "a17_roc_pr_auc", "a27_target_availability", "b04_product_weights", "b09_alignment_decision", "c03_coherence", "c07_residual_floor", "c08_blend_certificates",
    "c11_sequential_gates", "c17_health_cards", "c23_carry_forward", "c26_outcome_gated_score", "e05_extract_claims", "e06_verify_claims", "f01_random_split", "f3_list_zctas", "f7_portfolio_rows", "g08_local_moran", "g19_permuted_weights",
    "g21_edge_crossings", "j05_nearest_site_in_radius", "j08_nearest_training_by_fold", "j10_first_containing_polygon", "j11_overlay_pairs", "j24_knn_gaussian_edges", "p06_flood_zone_class", "q12_convention_outputs", "r05_block_bootstrap_r2",
    "r07_kendall_tau_b", "r10_holm_adjusted", "s04_storm_tracks", "s12_morton_order", "t02_windowed_totals", "t03_sessions", "w01_rolling_peaks", "w10_quantile_bins", "w12_policy_queue",
]
SQL = entry_point.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("PLUMBLINE_ALL") else SAMPLE


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, small, duck, name):
    df = entry_point.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry_point.queries())


def test_entry_has_rows(spark):
    df = entry_point.entry(spark)
    assert df.columns[0] == "zcta_id" and df.count() > 0
