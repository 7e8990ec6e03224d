"""Exact dedup, packing and URL filter: brute force on awkward rows, registered queries against their SQL."""

import itertools
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_point
import odd
from plumbline.llm import exact_dedup, packing, url_filter

SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op6_packing", "op7_exact_dedup", "op8_warc", "op10_url_filter", "op12_filter_audit", "op13_vector_dedup"])
def test_query_matches_sql(spark, small, duck, name):
    df = entry_point.queries()[name](spark, small)
    cols = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FIRST_BYTES", 2)  # several rounds on short texts
    monkeypatch.setattr(exact_dedup, "GROWTH", 2)
    groups = defaultdict(list)
    for r in odd.ROWS:
        groups[lower(r[1])].append(r[0])
    want = Counter((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    got = exact_dedup.exact_groups(odd.documents(spark))
    assert Counter(map(tuple, got.select("doc_id", "keep_id", "group_size").collect())) == want


def test_dropped_duplicates_keep_columns(spark):
    docs = odd.documents(spark)
    kept = exact_dedup.exact_duplicates_dropped(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [2, 4, 5, 7, 8, 9, 10, 11, 12, 15, 16, 17, 18, 19, 20, None]


def test_empty_tables(spark):
    none = odd.documents(spark).limit(0)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.exact_duplicates_dropped(none).count() == 0
    assert packing.pack(none).count() == 0
    assert url_filter.judge_urls(odd.pages(spark).limit(0)).count() == 0


def test_bounds_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        longest = np.sort(rng.choice(np.arange(1, 60), n, replace=False)).astype(np.int64)
        count = rng.integers(1, 6, n).astype(np.int64)
        total = longest * count
        k = int(rng.integers(1, 5))
        got = packing.choose_bounds(longest, count, total, k)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= m) - m) for m, c in zip(longest.tolist(), count.tolist()))

        best = min(padding([*pick, int(longest[-1])]) for r in range(k) for pick in itertools.combinations(longest[:-1].tolist(), r))
        assert len(got) <= k and padding(got) == best


def test_batches_hold_their_budget(spark):
    docs = odd.documents(spark)
    rows = packing.pack(docs, buckets=3, budget=4096).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd.ROWS)
    held = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] <= r["bound"] and r["padding"] == r["bound"] - r["n_tokens"]
        held[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), group in held.items():
        assert sorted(r["slot"] for r in group) == list(range(len(group)))
        assert len(group) == 1 or sum(r["bound"] for r in group) <= 4096
    for bucket in {b for b, _ in held}:
        numbers = sorted(n for b, n in held if b == bucket)
        assert numbers == list(range(len(numbers)))


def test_cells_keep_order(spark):
    values = [1, 2, 1023, 1024, 2047, 2048, 2049, 4095, 4096, 10**6, 10**9, 10**12]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "n long").select(packing.cell_of(packing.F.col("n"))).collect()]
    assert got == sorted(got) and len(set(got[:5])) == 5


def test_urls_by_brute_force(spark):
    rows = {r["page_id"]: r for r in url_filter.judge_urls(odd.pages(spark)).collect()}
    assert (rows[1]["host"], rows[1]["path"], rows[1]["rule"], rows[1]["verdict"]) == ("shop.example.com", "/a", "com/", "allow")
    assert (rows[2]["rule"], rows[2]["verdict"]) == ("www.example.com/en/", "allow")
    assert (rows[3]["rule"], rows[3]["verdict"], rows[3]["path"]) == ("example.com/en/", "block", "/en/2")
    assert (rows[4]["host"], rows[4]["path"], rows[4]["rule"]) == ("", "", None) and (rows[5]["host"], rows[5]["path"]) == ("", "")
    assert (rows[6]["rule"], rows[6]["verdict"]) == ("net/es/", "block")
    assert rows[7]["rule"] is None and rows[7]["verdict"] == "block"  # links to a blocked host
    assert (rows[8]["host"], rows[8]["path"], rows[8]["verdict"]) == ("solo.org", "", "allow")
    assert rows[9]["rule"] == "net/fr/" and (rows[10]["host"], rows[10]["path"]) == ("b:", "//c/d")


def test_partly_blocked_hosts_are_seeds(spark):
    urls = ["http://part.net/es/1", *[f"http://part.net/{k}" for k in range(5)], "http://sub.part.net/a", "http://far.net/a", "http://most.example.com/en/1"]
    rows = url_filter.judge_urls(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")).collect()
    got = {r["page_id"]: r for r in rows}
    assert got[0]["verdict"] == "block" and all(got[i]["rule"] is None and got[i]["distrust"] > 0 and got[i]["verdict"] == "block" for i in range(1, 7))
    assert (got[7]["distrust"], got[7]["verdict"]) == (0.0, "allow")


def test_verdicts_do_not_depend_on_the_number_of_seeds(spark):
    # a blocked host, and one four links from it through domains of 300 hosts each; other seeds only make both scores small
    urls = ["http://bad.a.q.net/es/1", "http://t.b.q.net/x", "http://a.q.net/x", "http://b.q.net/x", *[f"http://h{k}.{d}/x" for d in ("a.q.net", "b.q.net", "q.net") for k in range(300)]]
    pages = [(i, u, "") for i, u in enumerate(urls)]
    more = pages + [(10_000 + k, f"http://far.net/es/{k}", "") for k in range(2_000)]
    alone, among = ({r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(p, "page_id long, url string, html string")).collect()} for p in (pages, more))
    assert alone[1]["verdict"] == among[1]["verdict"] == "block" and among[1]["distrust"] < 1e-9
    assert abs(among[1]["distrust"] * 2_001 / alone[1]["distrust"] - 1) < 1e-2


def test_propagation_by_dense_matrix(spark):
    names = "abcde"
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1), ("e", "d", 1)]
    m = np.zeros((5, 5))
    for s, d, n in edges:
        m[names.index(s), names.index(d)] = n
    walk = lambda w, s: 0.15 * s @ np.linalg.inv(np.eye(5) - 0.85 * w / np.maximum(w.sum(1, keepdims=True), 1))
    trust, distrust = walk(m, np.array([1.0, 0, 0, 0, 0])), walk(m.T, np.array([0, 0, 1.0, 0, 0]))
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: r for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), seeds, tolerance=1e-7).collect()}
    for i, h in enumerate(names):
        for k, v in (("trust", trust[i]), ("distrust", distrust[i])):
            assert abs((got[h][k] if h in got else 0.0) - v) < 1e-5


def test_distrust_reaches_the_end_of_a_chain_in_any_quoting(spark):
    """Host k links to host k - 1, the first is blocked: 40 links, in double, single and no quotes."""
    quotes = ['<a href="http://h{}.org/">', "<a href='http://h{}.org/'>", "<a href=http://h{}.org/ x>"]
    pages = [(0, "http://h0.net/es/1", ""), *[(k, f"http://h{k}.org/", quotes[k % 3].format(k - 1).replace("//h0.org", "//h0.net")) for k in range(1, 41)], (41, "http://lone.org/", "")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[k]["verdict"] for k in range(42)] == ["block"] * 41 + ["allow"]
    assert all(got[k]["distrust"] > got[k + 1]["distrust"] > 0 for k in range(1, 40))
