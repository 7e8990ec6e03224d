from pathlib import Path

from plumbline.llm import url_filter
from plumbline.session import ensure_checkpoint_dir


def test_walks_over_a_small_graph_do_not_write_a_file_per_partition_and_round(spark):
    """A chain of 60 hosts in 64 partitions: scores of all hosts, and files of a few results only."""
    edges = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(60)], "src string, dst string, n long").repartition(64)
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h60", 0.0, 1.0)], "host string, trust double, distrust double")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    kept = {n: spark.conf.get(n) for n in names}
    files = lambda: sum(1 for _ in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("part-*"))
    before = files()
    try:
        spark.conf.set(names[0], "64")
        spark.conf.set(names[1], "false")
        got = {r["host"]: r for r in url_filter.propagate(edges, seeds).collect()}
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)
    assert len(got) == 61 and all(abs(got[f"h{k}"]["trust"] - 0.15 * 0.85**k) < 1e-9 for k in range(61))
    assert files() - before < 64 * 6
