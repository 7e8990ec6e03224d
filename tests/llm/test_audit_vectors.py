"""Filter audit and vector duplicates against plain versions."""

import math
import random
from fractions import Fraction
from itertools import permutations

import numpy as np
import odd
import pytest
from plumbline.llm import filter_audit, vector_dedup
from plumbline.llm.common import components

# filter audit


def plain_audit(docs, labels):
    """Applies the filters one after the other, order by order, document by document."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    white = "\x20\x09\x0a\x0b\x0c\x0d"
    fails = []
    for i, t, part in docs:
        t = t or ""
        words = "".join(" " if c in white else c for c in t).split(" ")
        words = [w for w in words if w]
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in t for c in "#$%&*|"), "E": i is not None and first[t] < i}
        fails.append((part or "", {k for k, v in bad.items() if v}, labels.get(i, (0, 0))))
    out = []
    for part in {f[0] for f in fails}:
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = [f for f in fails if f[0] == part], []
            for step, k in enumerate(order, 1):
                hit = [f for f in left if k in f[1]]
                left = [f for f in left if k not in f[1]]
                rows.append([part, "".join(order), step, len(left), len(hit), sum(k in f[1] for f in gone), sum(f[1] == {k} for f in fails if f[0] == part), sum(f[2][0] for f in hit), sum(f[2][1] for f in hit), k])
                total[k] += len(hit)
                gone += hit
        out += [(*r[:-1], total[r[-1]]) for r in rows]
    return sorted(out)


def audited(spark, docs, labels):
    masks = filter_audit.failure_masks(docs, spark.createDataFrame(labels, odd.LABELS))
    return sorted(map(tuple, filter_audit.interaction_audit(masks).collect()))


def test_audit_equals_plain_filtering(spark):
    rng = random.Random(3)
    texts = ["short", " ".join(["word"] * 250), " ".join(f"w{k}" for k in range(250)), "LOUD " * 220, "a|b", "", "Ünï " * 210, "x\x0by\x0cz " * 90, "tab\tand\nline " * 120]
    rows = [(i, rng.choice([*texts, None, " ".join(f"{rng.choice('aB$')}{rng.randint(0, 150)}" for _ in range(rng.choice([50, 230])))]), rng.choice(["en", "fr", None])) for i in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert audited(spark, docs, labels) == plain_audit(rows, {i: (q or 0, t or 0) for i, q, t in labels})


def test_audit_of_odd_rows(spark):
    docs = odd.documents(spark)
    labels = [(1, 1, 0), (1, 0, 1), (7, 1, None), (None, 1, 1), (14, None, 1), (999, 1, 1)]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert audited(spark, docs, labels) == plain_audit(rows, {1: (1, 1), 7: (1, 0), 14: (0, 1)})
    assert audited(spark, odd.documents(spark, []), labels) == []


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_least_squares_gives_the_mean_over_orders(m):
    rng = random.Random(m)
    v = filter_audit.coalition_table([rng.randint(0, 50) for _ in range(1 << m)])
    mean = [Fraction(0)] * m
    for order in permutations(range(m)):
        before = 0
        for k in order:
            mean[k] += Fraction(v[before | 1 << k] - v[before], math.factorial(m))
            before |= 1 << k
    assert filter_audit.shapley(v, m) == mean


# vectors


def plain_links(rows, cosine=0.95):
    """(n_links, component) of each id by all pairs."""
    fine = [(i, np.array(v, float) / max(map(abs, v))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for a, x in fine:
        for b, y in fine:
            if a != b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                links[a].add(b)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen) if i is not None else None)
    return out


def near(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "clash", 1.0) for i, v in rows], "vec_id long, embedding array<double>, x string, component double")
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(df, **kw).collect()}


def noisy(rng, centre, spread):
    return (centre / np.linalg.norm(centre) + spread * rng.standard_normal(len(centre)) / math.sqrt(len(centre))).tolist()


def test_links_of_groups_chains_and_strangers(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)  # workers are forked from a daemon that may predate this, so only the plan's blocks are small
    rng = np.random.default_rng(5)
    rows, d = [], 24
    for _ in range(12):
        centre = rng.standard_normal(d)
        rows += [noisy(rng, centre, 0.12) for _ in range(int(rng.integers(2, 60)))]
    a, b = np.linalg.qr(rng.standard_normal((d, 2)))[0].T
    rows += [(math.cos(t * 0.2) * a + math.sin(t * 0.2) * b).tolist() for t in range(30)]  # a chain: each links with its neighbours only
    rows += [rows[0]] * 40 + [(3.0 * np.array(rows[1])).tolist(), (1e200 * np.array(rows[1])).tolist(), (1e-200 * np.array(rows[1])).tolist()]
    rows += rng.standard_normal((60, d)).tolist()
    rows = [(i, v) for i, v in enumerate(rows)]
    assert {i: r[:2] for i, r in near(spark, rows, recall=0.9999).items()} == plain_links(rows)


def test_vectors_that_cannot_link(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, float("nan"), 3.0]), (8, [float("inf"), 2.0, 3.0]), (9, [1.0, 2.0]), (10, [2.0, 4.0]), (None, v), (12, [2.0, 4.0, 6.0]), (12, [-1.0, 4.0, 6.0]), (13, [-1.0, 4.0, 6.0])]
    got = near(spark, rows)
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False) and got[9] == (1, 9, True) and got[10] == (1, 9, False)
    assert got[12] == (1, 12, True) and got[13] == (1, 12, False)  # the smallest vector of id 12 counts
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8)) and got[None] == (0, None, True)
    assert near(spark, [(3, None)]) == {3: (0, 3, True)}
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.951 to 0.97 among strangers: at least 0.9 of them are found, as the plan of tables says, and nothing else."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.standard_normal((400, 64))
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    angle = np.arccos(rng.uniform(0.951, 0.97, 400))[:, None]
    rows = list(enumerate([*x.tolist(), *(np.cos(angle) * x + np.sin(angle) * away).tolist()]))
    want, got = plain_links(rows), near(spark, rows)
    found = sum(got[i][0] for i in got)
    assert 0.9 * sum(n for n, _ in want.values()) <= found and all(got[i][0] <= want[i][0] for i in want)


def test_chance_to_meet_by_sampling():
    rng = np.random.default_rng(2)
    for distance in (0.3, 1.4):
        x, y = np.zeros(8), np.zeros(8)
        y[0] = distance
        a, shift = rng.standard_normal((8, 200_000)), rng.uniform(0, 2, 200_000)
        assert abs((np.floor((x @ a + shift) / 2) == np.floor((y @ a + shift) / 2)).mean() - vector_dedup.meeting_chance(distance)) < 0.005


# components


def test_components_of_a_long_path(spark):
    n = 1 << 14
    links = spark.range(n).selectExpr("(id * 7919) % 16384 as a", "((id + 1) * 7919) % 16384 as b")
    got = components(links)
    assert got.count() == n and got.filter("component <> 0").count() == 0
