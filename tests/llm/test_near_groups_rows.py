"""Blocks of the Jaccard join return fewer rows than they hold sets, whatever the number of close pairs."""

import numpy as np

from plumbline.llm import ngram_join as J


def _sets(n: int, own: int, shared: int = 400, seed: int = 3) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 63, shared).astype(np.uint64)
    return [np.unique(np.concatenate([base, rng.integers(1, 1 << 63, own).astype(np.uint64)])) for _ in range(n)]


def _parts(pairs, n: int) -> set[frozenset]:
    part = {i: {i} for i in range(n)}
    for a, b in pairs:
        whole = part[a] | part[b]
        for x in whole:
            part[x] = whole
    return {frozenset(p) for p in part.values()}


def _linked(sets: list[np.ndarray], percent: int):
    inter = lambda a, b: len(np.intersect1d(a, b))
    return [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * inter(sets[i], sets[j]) >= percent * (len(sets[i]) + len(sets[j]) - inter(sets[i], sets[j]))]


def test_close_sets_make_one_row_each():
    n = 300
    sets = _sets(n, 52)  # 400 / 504 is just below 0.8: bitmaps leave pairs open, none is linked
    size, bits = np.array([len(s) for s in sets]), [J.sketch(s) for s in sets]
    stars = J.close_stars(list(range(n)), list(range(n)), size, bits, 80)
    assert 0 < len(stars) < n
    assert J.tree_links(list(range(n)), list(range(n)), [0] * n, sets, 80) == []


def test_tree_links_connect_what_is_linked():
    sets = _sets(60, 45, seed=5) + _sets(40, 60, seed=6) + _sets(3, 2, 9, seed=7)
    rng = np.random.default_rng(9)
    sets = [sets[i] for i in rng.permutation(len(sets))]
    n, want = len(sets), _parts(_linked(sets, 80), len(sets))
    links = J.tree_links(list(range(n)), list(range(n)), [0] * n, sets, 80)
    assert _parts(links, n) == want and len(links) == n - len(want)
    size, bits = np.array([len(s) for s in sets]), [J.sketch(s) for s in sets]
    cluster = {x: p for p in _parts(J.close_stars(list(range(n)), list(range(n)), size, bits, 80), n) for x in p}
    assert all(cluster[a] is cluster[b] for a, b in _linked(sets, 80))
    # two sides: only pairs across them
    sides = [i % 2 for i in range(n)]
    across = _parts([(a, b) for a, b in _linked(sets, 80) if sides[a] != sides[b]], n)
    assert _parts(J.tree_links(list(range(n)), list(range(n)), sides, sets, 80), n) == across
