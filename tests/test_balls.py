"""Gabriel graph and most similar vectors through cells, against all pairs."""

import numpy as np
import pytest
from plumbline.operators import balls


def clusters(rng, n, d, groups, spread):
    return rng.standard_normal((groups, d))[rng.integers(0, groups, n)] * 4 + spread * rng.standard_normal((n, d))


def frame(spark, x):
    return spark.createDataFrame([(f"r{i:04d}", v) for i, v in enumerate(x.tolist())], "id string, vec array<double>")


def plain_gabriel(x):
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    return {(f"r{i:04d}", f"r{j:04d}") for i in range(len(x)) for j in range(i + 1, len(x)) if not ((d2[i] + d2[j]) < d2[i, j]).any()}


@pytest.mark.parametrize("d,groups", [(2, 12), (8, 6)])
def test_gabriel_equals_all_triples(spark, monkeypatch, d, groups):
    monkeypatch.setattr(balls, "CELL", 16)
    x = clusters(np.random.default_rng(d), 500, d, groups, 0.3)
    df = frame(spark, x)
    assert {tuple(r) for r in balls.gabriel_graph(df, "id", "vec").collect()} == plain_gabriel(x)
    assert balls.gabriel_candidates(balls.ball_cells(df, "id", "vec")).count() < 500 * 64


def test_gabriel_of_lines_copies_and_few(spark):
    line = np.arange(40.0)[:, None] * np.array([[1.0, 2.0]])
    assert {tuple(r) for r in balls.gabriel_graph(frame(spark, line), "id", "vec").collect()} == {(f"r{i:04d}", f"r{i + 1:04d}") for i in range(39)}
    same = np.ones((4, 3))
    assert balls.gabriel_graph(frame(spark, same), "id", "vec").count() == 6
    assert balls.gabriel_graph(frame(spark, same[:1]), "id", "vec").count() == 0
    assert balls.gabriel_graph(frame(spark, same).limit(0), "id", "vec").count() == 0


def plain_top(q, p, k):
    out = {}
    for i, v in enumerate(q):
        s = [(-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w) + 1e-8), j) for j, w in enumerate(p) if i != j]
        out[i] = [(j, round(-c, 9)) for c, j in sorted(s)[:k]]
    return out


def top(spark, q, p, k, scored=None):
    df = lambda x: spark.createDataFrame(list(enumerate(x.tolist())), "id long, v array<double>")
    rows = balls.cosine_top_k(df(q), df(p).withColumnRenamed("id", "pid"), "id", "pid", "v", k, scored=scored).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["id"], []).append((r["match_pid"], round(r["cosine"], 9)))
    return out


def test_top_k_equals_the_full_scan_and_scores_a_share(spark, monkeypatch):
    monkeypatch.setattr(balls, "CELL", 16)
    rng = np.random.default_rng(1)
    p, scored = clusters(rng, 600, 12, 30, 0.15), []
    got = top(spark, p[:150], p, 5, scored)
    want = plain_top(p[:150], p, 5)
    assert {q: [j for j, _ in m] for q, m in got.items()} == {q: [j for j, _ in m] for q, m in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-8 for q in want for a, b in zip(got[q], want[q]))
    assert scored[0] < 0.5 * scored[1] and scored[1] == 150 * 600


def test_top_k_with_zero_vectors_ties_and_few_passages(spark):
    p = np.array([[1.0, 0], [0, 0], [1, 0], [-1, 0], [0, 2]])
    got = top(spark, np.array([[-1.0, 0], [0, 0]]), p, 10)
    assert [j for j, _ in got[0]] == [3, 1, 4, 2] and [j for j, _ in got[1]] == [0, 2, 3, 4]
    assert top(spark, p[:2], p[:0], 3) == {}


def test_popular_cells_are_served_by_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    p = rng.standard_normal((80, 4))
    want = top(spark, p, p, 3)
    monkeypatch.setattr(balls, "SERVED", 7)
    assert top(spark, p, p, 3) == want


def test_top_k_of_many_copies_searches_each_vector_once(spark):
    """Every vector 30 times: the answers are its smallest copies, and work does not grow with them."""
    rng, scored = np.random.default_rng(5), []
    p = np.tile(rng.standard_normal((40, 8)), (30, 1))
    got = top(spark, p, p, 4, scored)
    assert all([j for j, _ in m] == [j for j in range(q % 40, 1200, 40) if j != q][:4] for q, m in got.items()) and len(got) == 1200
    assert scored[1] == 40 * 40


def test_top_k_moves_a_query_once_to_a_group_where_bounds_rule_out_nothing(spark, monkeypatch):
    asked, visit = [], balls.visit
    monkeypatch.setattr(balls, "CELL", 4)
    monkeypatch.setattr(balls, "visit", lambda cells, rows, *more: (asked.append(rows.count()), visit(cells, rows, *more))[1])
    p = np.random.default_rng(6).standard_normal((400, 32))
    got, want = top(spark, p, p, 5), plain_top(p, p, 5)
    assert {q: [j for j, _ in m] for q, m in got.items()} == {q: [j for j, _ in m] for q, m in want.items()}
    assert asked[1] == 400
