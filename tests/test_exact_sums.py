"""Sums behind thresholds and ranks do not depend on the order of rows; SQL states the queries' own rules."""

import datetime
from types import SimpleNamespace

import pytest

import __spark_entry__ as entry_point
from plumbline.plans import inferring, series
from plumbline.plans.standins import Tables

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def line(order, part=1, supplier=1, number=1, quantity=3.0, flag="A"):
    return (order, part, supplier, number, quantity, 100.1, 0.1, 0.01, flag, "F", datetime.datetime(1995, 1, 1))


@pytest.fixture
def lines(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
        return str(tmp_path)

    return write


def sql_rows(duck_folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{duck_folder}/lineitem.parquet/*.parquet'")
    return con.execute(entry_point.oracle_sql()[name])


def test_certificate_base_is_exact(spark, lines):
    row = Tables(spark, lines([line(i) for i in range(10)])).cert_base.first()
    assert (row["a"], row["b"], row["c"], row["sigma"], row["loss"]) == (30.0, 120.0, 30.0, 0.0, 1001.0)  # ten times 0.1 added up is below 1


def test_means_of_errors_that_cancel_are_zero(spark):
    oof = spark.createDataFrame([("u", "A", 1.0, p) for p in (1.1, 1.2, 0.7)], "zcta string, task string, y_true double, y_pred double")
    row = inferring._units(SimpleNamespace(oof=oof)).first()
    assert row["d0"] == 0.0 and row["a0"] == 0.2


def test_means_of_shares_are_exact(spark, lines):
    row = series._levels(Tables(spark, lines([line(i) for i in range(10)]))).first()
    assert (row["m"], row["d"]) == (0.1, 0.01)


def test_signed_rank_counts_pairs_without_difference(spark, lines):
    # (31 part + 17 number + order) % 41 = 20 makes the error of a line zero
    folder = lines([line(order, 0, supplier) for order, supplier in [(3, 1), (5, 2), (9, 3), (30, 4)]])
    found = sql_rows(folder, "r08_wilcoxon_signed_rank").fetchall()
    assert [r.n_pairs for r in entry_point.queries()["r08_wilcoxon_signed_rank"](spark, folder).collect()] == [4] and found[0][1] == 4


def test_bootstrap_sql_reaches_the_leaves_of_larger_tables():
    # leaves of 32 rows: 60,000 units of one task lie eleven levels deep
    assert "d11 AS" in entry_point.oracle_sql()["r01_resampling_kernel"]
