"""Greedy placing at the size of its bound, against the plain rule."""

import time

from plumbline.operators import folds
from pyspark.sql import functions as F


def plain_merge(sizes, minimum):
    """Blocks below the minimum, largest first, join the big block that is smallest at that moment."""
    big = sorted([b, n] for b, n in sizes if n >= minimum)
    out = {b: b for b, _ in sizes}
    if big:
        for b, n in sorted(((b, n) for b, n in sizes if n < minimum), key=lambda x: (-x[1], x[0])):
            at = min(range(len(big)), key=lambda k: (big[k][1], k))
            big[at][1] += n
            out[b] = big[at][0]
    return out


def test_merge_equals_the_plain_rule(spark):
    sizes = [(f"b{i:03d}", (i * 7919) % 13 + 1) for i in range(300)]
    df = spark.createDataFrame([(b, n, i) for i, (b, n) in enumerate(sizes)], "block string, n long, h long")
    assert {r["block"]: r["merged"] for r in folds.merge_targets(df, 5).collect()} == plain_merge(sizes, 5)
    none_big = df.withColumn("n", F.lit(1).cast("long"))
    assert all(r["block"] == r["merged"] for r in folds.merge_targets(none_big, 5).collect())


def test_hundred_thousand_blocks_take_under_a_minute(spark):
    df = spark.range(100_000).select(F.format_string("%06d", "id").alias("block"), F.when(F.col("id") % 2 == 0, 1 + F.col("id") % 4).otherwise(5 + F.col("id") % 9).alias("n"), F.xxhash64("id").alias("h"))
    start = time.time()
    merged = folds.merge_targets(df, 5)
    got = merged.groupBy("merged").agg(F.sum("n").alias("n")).agg(F.count("*").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("all")).first()
    assert got["k"] == 50_000 and got["all"] == df.agg(F.sum("n")).first()[0] and got["hi"] <= 13
    placed = folds.place_folds(merged, 5, 5).groupBy("fold").count().collect()
    assert len(placed) == 5 and time.time() - start < 60


def test_counties_go_to_the_lightest_fold_of_their_stratum(spark):
    rows = [(f"c{i}", f"s{i % 3}" if i % 7 else None, (i * 37) % 11 + 1, (i * 7919) % 101) for i in range(60)]
    got = {r["county_fips"]: r["fold"] for r in folds.balance_by_stratum(spark.createDataFrame(rows, "county_fips string, stratum string, n_zctas int, h long"), 4).collect()}
    whole, parts, want = [0] * 4, {}, {}
    for c, s, n, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        part = parts.setdefault(s, [0] * 4) if s is not None else list(whole)
        at = min(range(4), key=lambda f: (part[f], whole[f], f))
        part[at] += n
        whole[at] += n
        want[c] = at
    assert got == want
