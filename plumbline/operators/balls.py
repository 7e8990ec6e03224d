"""Vectors in balls: nearest-pivot cells with radii, and searches that leave out whole cells by their bounds.

Pivots are a bounded number of the points themselves, drawn by a hash of their ids, so dense regions have more of them and cells stay even. The directory of cells (pivot, radius) is all
that every task holds; points live in one task per cell, and a popular cell is served by several. Bounds only steer the work: results are those of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.core import seeded_hash
from plumbline.session import cut_lineage

#: points aimed at per cell; most cells (with 64 dimensions a directory of 2 MB); requests that one task of a cell serves
CELL, MOST, SERVED = 64, 4096, 4096
#: nearest points and pivots that are tried as blockers of whole cells; cells looked at before bounds are known
BLOCKERS, FIRST_CELLS = 16, 4
#: most points of a group of cells that one task holds in a search; rows looked at against all cells at once
GROUP, PIECE = 65_536, 1_024
SLACK = 1e-9


@dataclass(frozen=True)
class Cells:
    """Points (id, x, cell) and the directory: pivot and radius of each cell; radii are Euclidean."""

    points: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    kind: str


def _vector(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.float64)


def _matrix(column) -> np.ndarray:
    return np.stack([_vector(x) for x in column])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, from their differences."""
    return np.stack([((b - row) ** 2).sum(axis=1) for row in a]) if len(a) else np.zeros((0, len(b)))


def ball_cells(rows: DataFrame, id_col: str, vector: str, unit: bool = False, seed: int = 17) -> Cells:
    """Cells of vectors of one length; with ``unit`` they are scaled to length 1 first, and zero vectors stay zero. Null ids and vectors are left out."""
    kind = dict(rows.dtypes)[id_col]
    rows = rows.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def pack(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                if unit:
                    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    x = x / np.where(length > 0, length, 1)
                yield pd.DataFrame({"id": pdf["id"], "x": [r.tobytes() for r in x]})

    packed = cut_lineage(rows.mapInPandas(pack, f"id {kind}, x binary"))
    count = min(MOST, -(-packed.count() // CELL))
    # the first ids in hash order: a bounded draw that does not depend on partitions
    chosen = packed.orderBy(seeded_hash(seed, "id"), "id").limit(count).select("x").distinct().collect() if count else []
    pivots = np.unique(np.stack([_vector(r["x"]) for r in chosen]), axis=0) if chosen else np.zeros((0, 0))

    def assign(batches):
        for pdf in _pieces(batches):
            if len(pdf):
                x = _matrix(pdf["x"])
                near = np.argmin(-2 * x @ pivots.T + (pivots * pivots).sum(axis=1), axis=1)
                yield pdf.assign(cell=near, far=np.sqrt(((x - pivots[near]) ** 2).sum(axis=1)))

    points = cut_lineage(packed.mapInPandas(assign, f"id {kind}, x binary, cell int, far double"))
    radii = np.zeros(len(pivots))
    for r in points.groupBy("cell").agg(F.max("far").alias("far")).collect():
        radii[r["cell"]] = r["far"]
    return Cells(points.select("id", "x", "cell"), pivots, radii, kind)


def visit(cells: Cells, asked: DataFrame, serve: Callable, schema: str, served: int | None = None) -> DataFrame:
    """``serve(ids, x, requests)`` for the points of each cell and the requests (cell, ...) to it, in frames of bounded size.

    A cell with many requests is served by several tasks that all hold its points."""
    names = [c for c in asked.columns if c != "cell"]
    loads = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (served or SERVED)).cast("int").alias("_tasks"))
    loads = cut_lineage(loads)
    points = cells.points.join(loads, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("_task"), F.col("id").alias("_id"), F.col("x").alias("_x"), *[F.lit(None).cast(t).alias(c) for c, t in asked.drop("cell").dtypes])
    none = [F.lit(None).cast(cells.kind).alias("_id"), F.lit(None).cast("binary").alias("_x")]
    wanted = asked.join(loads, "cell").select("cell", F.pmod(F.xxhash64(*names), "_tasks").cast("int").alias("_task"), *none, *names)
    rows = points.unionByName(wanted).repartition("cell", "_task").sortWithinPartitions("cell", "_task", F.col("_x").isNull(), "_id")

    def run(batches):
        now, ids, xs, x = None, [], [], None
        for pdf in batches:
            for key, part in pdf.groupby(["cell", "_task"], sort=False):
                if key != now:
                    now, ids, xs, x = key, [], [], None
                own = part["_x"].notna().to_numpy()
                ids += part["_id"][own].tolist()
                xs += part["_x"][own].tolist()
                if not own.all():
                    x = _matrix(xs) if x is None else x
                    out = serve(ids, x, part[~own][names].reset_index(drop=True))
                    if len(out):
                        yield out

    return rows.mapInPandas(run, schema)


# ---- Gabriel graph ------------------------------------------------------------------------------


def _blocked_cells(i: np.ndarray, by: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Which balls lie wholly behind one of the points ``by`` as seen from i, that is in the half-space where the angle at it is obtuse."""
    to = i - by
    behind = to @ centres.T - (to * by).sum(axis=1, keepdims=True) + np.sqrt((to * to).sum(axis=1, keepdims=True)) * radii
    return (behind < -SLACK * (1 + np.abs(centres).max(initial=0) ** 2)).any(axis=0)


def gabriel_candidates(cells: Cells) -> DataFrame:
    """(i, j, xi, xj) with i < j: pairs that near points of either end do not rule out.

    A point asks the cells that its nearest points in its own cell and the nearest pivots leave visible; there, its nearest points of that cell rule out the rest. A pair
    is a candidate when it is left from both ends."""
    kind, pivots, radii = cells.kind, cells.pivots, cells.radii

    def ask(ids, x, requests):
        out = []
        for name, data in zip(requests["i"], requests["xi"]):
            i = _vector(data)
            near = np.argsort(((x - i) ** 2).sum(axis=1))[: BLOCKERS + 1]
            ways = np.argsort(((pivots - i) ** 2).sum(axis=1))[:BLOCKERS]
            by = np.concatenate([x[near], pivots[ways]])
            by = by[(by != i).any(axis=1)]
            seen = np.flatnonzero(~_blocked_cells(i, by, pivots, radii)) if len(by) else np.arange(len(pivots))
            out += [(int(c), name, data) for c in seen]
        return pd.DataFrame(out, columns=["cell", "i", "xi"])

    asked = visit(cells, cells.points.select("cell", F.col("id").alias("i"), F.col("x").alias("xi")), ask, f"cell int, i {kind}, xi binary")

    def look(ids, x, requests):
        out = []
        for name, data in zip(requests["i"], requests["xi"]):
            i = _vector(data)
            by = x[np.argsort(((x - i) ** 2).sum(axis=1))[: BLOCKERS + 1]]
            by = by[(by != i).any(axis=1)]
            left = np.flatnonzero(~_blocked_cells(i, by, x, np.zeros(len(x)))) if len(by) else np.arange(len(x))
            out += [(name, ids[j], data, x[j].tobytes()) if name < ids[j] else (ids[j], name, x[j].tobytes(), data) for j in left if ids[j] != name]
        return pd.DataFrame(out, columns=["i", "j", "xi", "xj"])

    pairs = visit(cells, cut_lineage(asked), look, f"i {kind}, j {kind}, xi binary, xj binary")
    return pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("ends"), F.first("xi").alias("xi"), F.first("xj").alias("xj")).filter("ends = 2").drop("ends")


def gabriel_graph(regions: DataFrame, rid: str, vector: str) -> DataFrame:
    """(i, j) with i < j: regions with no third one inside the ball that has them as poles.

    Candidates are checked in the cells that their ball reaches, the one nearest its middle first, so most of the others are never asked. Ids are
    distinct; regions of equal vectors are linked, as nothing lies inside a ball of no size."""
    cells = ball_cells(regions, rid, vector)
    kind, pivots, radii = cells.kind, cells.pivots, cells.radii
    pairs = cut_lineage(gabriel_candidates(cells))

    def reached(first: bool):
        def run(batches):
            for pdf in batches:
                out = []
                for i, j, xi, xj in zip(pdf["i"], pdf["j"], pdf["xi"], pdf["xj"]):
                    a, b = _vector(xi), _vector(xj)
                    away = np.sqrt(((pivots - (a + b) / 2) ** 2).sum(axis=1))
                    hit = [int(np.argmin(away))] if first else np.flatnonzero(away - radii <= np.sqrt(((a - b) ** 2).sum()) / 2 * (1 + SLACK) + SLACK).tolist()
                    out += [(c, i, j, xi, xj) for c in hit]
                yield pd.DataFrame(out, columns=["cell", "i", "j", "xi", "xj"])

        return run

    def inside(ids, x, requests):
        a, b = _matrix(requests["xi"]), _matrix(requests["xj"])
        full = ((a - b) ** 2).sum(axis=1)
        hit = (_squared(a, x) + _squared(b, x) < full[:, None]).any(axis=1)
        return requests.loc[hit, ["i", "j"]]

    for first in (True, False):
        asked = pairs.mapInPandas(reached(first), f"cell int, i {kind}, j {kind}, xi binary, xj binary")
        gone = visit(cells, asked, inside, f"i {kind}, j {kind}").distinct()
        pairs = cut_lineage(pairs.join(gone, ["i", "j"], "left_anti"))
    return pairs.select("i", "j")


# ---- most similar vectors -----------------------------------------------------------------------


def _neighbourhoods(pivots: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Group of each cell: cells are halved across their widest dimension until a group has at most ``most`` points or one cell."""
    group, todo, made = np.zeros(len(pivots), np.int64), [np.arange(len(pivots))], 0
    while todo:
        own = todo.pop()
        if len(own) == 1 or counts[own].sum() <= most:
            group[own], made = made, made + 1
            continue
        own = own[np.argsort(pivots[own, int(np.argmax(np.ptp(pivots[own], axis=0)))], kind="stable")]
        half = min(max(int(np.searchsorted(np.cumsum(counts[own]), counts[own].sum() / 2)), 1), len(own) - 1)
        todo += [own[:half], own[half:]]
    return group


def _pieces(batches):
    """Frames of at most ``PIECE`` rows: what is computed for all cells at once stays small."""
    for pdf in batches:
        for at in range(0, len(pdf), PIECE):
            yield pdf.iloc[at : at + PIECE]


def cosine_top_k(queries: DataFrame, passages: DataFrame, qid: str, pid: str, vector: str, k: int = 5, eps: float = 1e-8, scored: list | None = None) -> DataFrame:
    """The k most similar passages of every query, exact: (qid, match_<pid>, cosine, rank); ties go to the smaller passage, a passage does not match its own id.

    Equal vectors are searched once, and of equal passages the k + 1 smallest ids can be among the answers. Passages lie in cells of unit vectors with an angular radius, which bounds
    the cosine of everything inside; neighbouring cells form groups of bounded size, and one task holds a group. A query looks at its best cells first; the k-th score found there rules out all
    cells of a lower bound. In a second pass it goes once to every group that holds another cell, so what is moved is at most the queries times the groups, also where bounds
    rule out nothing. Zero vectors have a cosine of 0. ``scored`` is a list to which the number of scored pairs and of all pairs are added."""
    kp = dict(passages.dtypes)[pid]
    told = F.col(vector).cast("array<double>").alias("v")
    ask = queries.filter(F.col(qid).isNotNull() & F.col(vector).isNotNull()).select(F.col(qid).alias("q"), told)
    have = passages.filter(F.col(pid).isNotNull() & F.col(vector).isNotNull()).select(F.col(pid).alias("p"), told)
    have = have.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("p"))).filter(F.col("at") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    # in the order of their smallest ids, so that the smaller number wins a tie
    have = cut_lineage(have.orderBy(F.col("ps")[0])).withColumn("d", F.monotonically_increasing_id())
    asks = cut_lineage(ask.select("v").distinct()).withColumn("qd", F.monotonically_increasing_id())
    cells = ball_cells(have, "d", "v", unit=True)
    pivots = cells.pivots
    if not len(pivots):
        return queries.limit(0).select(F.col(qid), F.lit(None).cast(kp).alias(f"match_{pid}"), F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("int").alias("rank"))
    angles = 2 * np.arcsin(np.clip(cells.radii / 2, 0, 1))  # a zero vector is 1 away from a unit pivot, and its cosine of 0 is within that angle and a right one
    angles = np.where((pivots * pivots).sum(axis=1) > 0.5, np.where(cells.radii >= 1 - 1e-9, np.maximum(angles, math.pi / 2), angles), math.pi)
    counts = np.zeros(len(pivots), np.int64)
    for r in cells.points.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    group = _neighbourhoods(pivots, counts, int(np.clip(counts.sum() // 12, GROUP // 16, GROUP)))
    width = pivots.shape[1]

    def bounds(v: np.ndarray, own=slice(None)) -> np.ndarray:
        gap = np.arccos(np.clip(v @ pivots[own].T, -1, 1)) - angles[own]
        return np.cos(np.maximum(gap, 0)) + 1e-7

    def best_cells(v: np.ndarray) -> np.ndarray:
        return np.argsort(-bounds(v), axis=1, kind="stable")[:, :FIRST_CELLS]

    def opened(v: np.ndarray, kth: np.ndarray, own=slice(None)) -> np.ndarray:
        """Which cells can hold a score of ``kth``; adding ``eps`` draws negative scores towards 0."""
        b = bounds(v, own)
        return np.where(b < 0, 1e-6, b) >= kth[:, None] - 1e-6

    def unit(batches):
        for pdf in _pieces(batches):
            v = np.stack(pdf["v"].to_numpy())
            n = np.sqrt((v * v).sum(axis=1))
            yield pd.DataFrame({"q": pdf["qd"], "v": [r.tobytes() for r in v / np.where(n > 0, n, 1)[:, None]], "qn": n})

    def placed(batches):
        for pdf in _pieces(batches):
            x = np.column_stack([_matrix(pdf["x"]), pdf["pn"], pdf["cell"]])
            yield pd.DataFrame({"id": pdf["id"], "x": [r.tobytes() for r in x], "cell": group[pdf["cell"].to_numpy()]})

    asks_unit = asks.mapInPandas(unit, "q long, v binary, qn double")
    points = cells.points.join(have.select(F.col("d").alias("id"), _length("v").alias("pn")), "id").mapInPandas(placed, "id long, x binary, cell int")
    groups = Cells(cut_lineage(points), pivots, cells.radii, "bigint")

    def search(ids, x, requests):
        """The k + 1 best vectors of a group for each request, cell by cell."""
        names, own = np.array(ids, np.int64), x[:, width + 1].astype(np.int64)
        order = np.lexsort((names, own))
        cuts = np.flatnonzero(np.diff(own[order], prepend=-1))
        here = own[order][cuts]
        out = []
        for part in _pieces([requests]):
            v, qn, kth = _matrix(part["v"]), part["qn"].to_numpy(), part["kth"].to_numpy(np.float64)
            first = np.isnan(kth)
            kth = np.where(first, -9.0, kth)
            look = opened(v, kth, here)
            if first.any():
                look[first] = (best_cells(v[first])[:, :, None] == here).any(axis=1)
            score, name = np.full((len(v), k + 1), -np.inf), np.full((len(v), k + 1), np.iinfo(np.int64).max)
            for c, (lo, hi) in enumerate(zip(cuts, np.append(cuts[1:], len(order)))):
                rows, at = np.flatnonzero(look[:, c]), order[lo:hi]
                if not len(rows):
                    continue
                both = qn[rows, None] * x[at, width]
                s = (v[rows] @ x[at, :width].T) * both / (both + eps)
                better = s.max(axis=1) >= np.maximum(score[rows, -1], kth[rows] - 1e-6)
                rows, s = rows[better], s[better]
                s, n = np.hstack([score[rows], s]), np.hstack([name[rows], np.broadcast_to(names[at], s.shape)])
                top = np.lexsort((n, -s), axis=1)[:, : k + 1]
                score[rows], name[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(n, top, 1)
            row, col = np.nonzero(score > -np.inf)
            out.append(pd.DataFrame({"q": part["q"].to_numpy()[row], "d": name[row, col], "s": score[row, col]}))
        return pd.concat(out)

    def best(batches):
        for pdf in _pieces(batches):
            to = group[best_cells(_matrix(pdf["v"]))]
            row, g = np.unique(np.stack([np.repeat(np.arange(len(to)), to.shape[1]), to.ravel()]), axis=1)
            yield pd.DataFrame({"cell": g, "q": pdf["q"].to_numpy()[row], "v": pdf["v"].to_numpy()[row], "qn": pdf["qn"].to_numpy()[row], "kth": np.nan})

    def rest(batches):
        for pdf in _pieces(batches):
            open_ = opened(_matrix(pdf["v"]), pdf["kth"].to_numpy())
            hit = np.zeros((len(pdf), int(group.max()) + 1), bool)
            for c in range(open_.shape[1]):
                hit[:, group[c]] |= open_[:, c]
            row, g = np.nonzero(hit)
            yield pd.DataFrame({"cell": g, **{n: pdf[n].to_numpy()[row] for n in ("q", "v", "qn", "kth")}})

    asked = "cell int, q long, v binary, qn double, kth double"
    found = visit(groups, asks_unit.mapInPandas(best, asked), search, "q long, d long, s double", 8 * SERVED)
    floor = found.groupBy("q").agg(F.get(F.sort_array(F.collect_list("s"), asc=False), F.lit(k)).alias("kth"))  # k + 1 scores of a few groups; one may be the query's own
    floor = cut_lineage(asks_unit.join(floor, "q", "left").select("q", "v", "qn", F.coalesce("kth", F.lit(-2.0)).alias("kth")))
    if scored is not None:
        share = lambda batches: (pd.DataFrame({"m": [int((opened(_matrix(d["v"]), d["kth"].to_numpy()) @ counts).sum())]}) for d in _pieces(batches))
        scored += [floor.mapInPandas(share, "m long").agg(F.sum("m")).first()[0] or 0, asks.count() * int(counts.sum())]
    found = visit(groups, floor.mapInPandas(rest, asked), search, "q long, d long, s double", 8 * SERVED)
    lead = lambda n, *by: F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), *by))), 1, n)
    near = found.groupBy("q").agg(lead(k + 1, "d").alias("top")).select("q", F.explode("top").alias("x")).select("q", "x.d", (-F.col("x.s")).alias("s"))  # at most k + 1 of each group
    near = near.join(have.select("d", "ps"), "d").select("q", "s", F.explode("ps").alias("p")).groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "p"))), 1, k + 1).alias("top"))
    top = ask.join(asks.select("v", F.col("qd")), "v").select(F.col("q").alias("id"), F.col("qd").alias("q")).join(near, "q")
    top = top.select("id", F.slice(F.filter("top", lambda e: ~e["p"].eqNullSafe(F.col("id"))), 1, k).alias("top")).select("id", F.posexplode("top").alias("at", "x"))
    return top.select(F.col("id").alias(qid), F.col("x.p").alias(f"match_{pid}"), (-F.col("x.s")).alias("cosine"), (F.col("at") + 1).alias("rank"))


def _length(vector: str):
    return F.sqrt(F.aggregate(F.transform(F.col(vector).cast("array<double>"), lambda e: e * e), F.lit(0.0), lambda t, e: t + e))
