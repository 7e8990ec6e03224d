"""Packing into optimal length buckets.

Dynamic programming over the global length histogram chooses the bucket bounds that minimise padding; inside each bucket, batches hold
as many sequences as fit a token budget when each is padded to the bucket's bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table, text_or_empty
from plumbline.session import cut_lineage

BUCKETS = 8
BUDGET = 65_536
#: lengths below this have histogram cells of their own; above it, an octave has as many cells
FINE = 1_024
#: ranks are dealt in this many shards per bucket
SHARDS = 4_096


def byte_length(text_col: str = "text") -> Column:
    """Length of the byte-level sequence with its end mark, so an empty text has length 1."""
    return (F.octet_length(text_or_empty(text_col)) + 1).cast("long")


def cell_of(n: Column, fine: int = FINE) -> Column:
    """Histogram cell of a length: exact below ``fine``, else ``fine`` cells an octave, so the number of cells is bounded by the
    logarithm of the longest length and not by the rows."""
    octave = F.greatest(F.floor(F.log2(n.cast("double") + 0.5)) - F.lit(int(np.log2(fine))), F.lit(0)).cast("int")
    return F.call_function("shiftright", n, octave) + octave.cast("long") * fine


def choose_bounds(longest: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` consecutive groups of cells with the least padding.

    Cell i holds ``count[i]`` lengths of sum ``total[i]`` up to ``longest[i]``. A group ending at j is padded to longest[j].
    Of equal paddings the smaller last split wins, fewer groups win over more."""
    n = len(longest)
    if not n:
        return []
    c, s = np.concatenate([[0], np.cumsum(count)]).astype(np.int64), np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    best = longest * c[1:] - s[1:]
    back = [np.zeros(n, np.int64)]
    for k in range(1, min(buckets, n)):
        new, arg = best.copy(), np.full(n, -1)
        for j in range(k, n):
            cost = best[:j] + longest[j] * (c[j + 1] - c[1 : j + 1]) - (s[j + 1] - s[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], arg[j] = cost[i], i
        best = new
        back.append(arg)
    bounds, j, k = [], n - 1, len(back) - 1
    while True:
        while k and back[k][j] < 0:
            k -= 1
        bounds.append(int(longest[j]))
        if not k:
            return bounds[::-1]
        j, k = int(back[k][j]), k - 1


def bucket_bounds(lengths: DataFrame, length_col: str = "n_tokens", buckets: int = BUCKETS) -> list[int]:
    """Bounds from the histogram of all rows. Only the cells come to the driver."""
    cells = lengths.groupBy(cell_of(F.col(length_col)).alias("cell")).agg(F.max(length_col).alias("m"), F.count("*").alias("c"), F.sum(length_col).alias("s")).orderBy("cell").collect()
    return choose_bounds(*(np.array([r[k] for r in cells], np.int64) for k in ("m", "c", "s")), buckets)


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per input row: (id_col, n_tokens, bucket, bound, batch, slot, padding).

    ``length`` must be positive; by default bytes and an end mark. A batch holds floor(budget / bound) sequences; one longer than
    the budget is a batch alone, never cut. Batches are numbered from 0 in each bucket, sequences by (shard, id, length), where the shard
    comes from the MD5 of the id. Null ids and repeated rows take slots of their own. An empty table gives no rows.

    A rank over a whole bucket would be one task, so ranks come from a row number inside each shard plus the counts of the shards
    before it (buckets x 4,096 rows)."""
    rows = cut_lineage(docs.select(F.col(id_col).alias("_id"), (byte_length() if length is None else length).cast("long").alias("n_tokens")))
    bounds = bucket_bounds(rows, buckets=buckets)
    bound, bucket = F.lit(None).cast("long"), F.lit(None).cast("int")
    for k in reversed(range(len(bounds))):
        bound = F.when(F.col("n_tokens") <= bounds[k], F.lit(bounds[k])).otherwise(bound)
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)
    shard = F.conv(F.substring(F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")), 1, 3), 16, 10).cast("int") % SHARDS
    rows = rows.select("*", bucket.cast("int").alias("bucket"), bound.cast("long").alias("bound"), shard.alias("shard"))
    sizes = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("_id", "n_tokens")) - 1).join(before, ["bucket", "shard"])
    rank, per = F.col("r") + F.col("before"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bound"))).cast("long")
    return ranked.select(F.col("_id").alias(id_col), "n_tokens", "bucket", "bound", F.floor(rank / per).cast("long").alias("batch"), (rank % per).cast("long").alias("slot"), (F.col("bound") - F.col("n_tokens")).alias("padding"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same dynamic programme, one table expression per number of buckets; lengths are few enough here to take them all as cells."""
    fine = int(np.log2(FINE))
    ctes = [
        "d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS n FROM documents)",
        f"o AS (SELECT n, greatest(CAST(floor(log2(n + 0.5)) AS INTEGER) - {fine}, 0) AS oct FROM d)",
        f"g AS (SELECT (n >> oct) + oct * {FINE} AS cell, max(n) AS m, count(*) AS c, sum(n) AS s FROM o GROUP BY 1)",
        "c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cell) AS j, m, CAST(sum(c) OVER (ORDER BY cell) AS BIGINT) AS c, CAST(sum(s) OVER (ORDER BY cell) AS BIGINT) AS s FROM g)",
        "b0 AS MATERIALIZED (SELECT j, m * c - s AS cost, [m] AS bounds FROM c)",
    ]
    for k in range(1, BUCKETS):
        ctes.append(f"p{k} AS (SELECT y.j, b.cost + y.m * (y.c - x.c) - (y.s - x.s) AS cost, list_append(b.bounds, y.m) AS bounds, b.j AS i FROM b{k - 1} b JOIN c x ON x.j = b.j JOIN c y ON y.j > b.j UNION ALL SELECT j, cost, bounds, 0 FROM b{k - 1})")
        ctes.append(f"b{k} AS MATERIALIZED (SELECT j, min(cost) AS cost, arg_min(bounds, (cost, i)) AS bounds FROM p{k} GROUP BY j)")
    ctes += [
        f"z AS (SELECT bounds FROM b{BUCKETS - 1} ORDER BY j DESC LIMIT 1)",
        "u AS (SELECT unnest(bounds) AS bound, generate_subscripts(bounds, 1) - 1 AS bucket FROM z)",
        f"q AS (SELECT d.doc_id, d.n, (SELECT min(bucket) FROM u WHERE u.bound >= d.n) AS bucket, CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3)) AS INTEGER) % {SHARDS} AS shard FROM d)",
        f"w AS (SELECT q.*, u.bound, row_number() OVER (PARTITION BY q.bucket ORDER BY shard, doc_id, n) - 1 AS r, greatest(1, {BUDGET} // u.bound) AS per FROM q JOIN u ON u.bucket = q.bucket)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, n AS n_tokens, CAST(bucket AS INTEGER) AS bucket, bound, CAST(r // per AS BIGINT) AS batch, CAST(r % per AS BIGINT) AS slot, bound - n AS padding FROM w"


QUERIES = {"op6_packing": op6_packing}
ORACLES = {"op6_packing": _sql()}
