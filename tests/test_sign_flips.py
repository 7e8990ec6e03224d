"""Signs of the sign-flip test."""

from pyspark.sql import functions as F

from plumbline.functions.core import seeded_even, seeded_hash
from plumbline.operators import resample


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_signs_are_the_last_bit_of_the_hash_and_rows_are_dealt(spark):
    d = spark.range(400)
    assert d.filter(seeded_even(42, "id") != (seeded_hash(42, "id") % 2 == 0)).count() == 0
    one = d.select("id", (F.col("id") % 7 - 2.0).alias("d")).coalesce(1)
    got = resample.sign_flip_p(one, [], "d", "id", reps=50)
    assert "conv(" not in _plan(got) and "RoundRobin" in _plan(got)
    want = one.crossJoin(spark.range(1, 51).withColumnRenamed("id", "rep")).groupBy("rep").agg(F.avg(F.when(seeded_hash(42, "rep", "id") % 2 == 0, F.abs("d")).otherwise(-F.abs("d"))).alias("m"))
    seen = one.agg(F.avg("d")).first()[0]
    assert got.first()["p_value"] == (want.filter(F.col("m") >= seen - 1e-12).count() + 1) / 51
