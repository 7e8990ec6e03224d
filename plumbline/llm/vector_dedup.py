"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and quantised; a table's bucket is the tuple of so many quantised projections. Vectors that share a bucket
of any table are candidates. Bit signatures rule out most false ones before any vector is shipped; cosines decide the rest, in double precision.

Links are first followed only as far as connectivity needs: every vector meets the smallest id of each of its buckets, and buckets that still hold several components are
compared in blocks. Then links are counted inside components, block by block. Blocks carry a centre and a radius, so pairs of blocks that are wholly linked or wholly
apart are settled by the triangle inequality of angles, and no pair of vectors is ever a row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import components, map_batches, stored, table
from plumbline.session import cut_lineage

COSINE = 0.95
#: quantisation width; expected share of the links at the threshold itself that share a bucket (closer ones: more); false candidates per vector and table
WIDTH, RECALL, FALSE = 2.0, 0.95, 0.125
#: bits of a signature, and how many of them two linked vectors may differ in (over 6 standard deviations for 0.95)
BITS, SIGMAS = 128, 6.5
#: vectors of a block
BLOCK = 1_024
SEED = 20_240_501


def meeting_chance(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at a Euclidean distance fall into one cell of a quantised Gaussian projection."""
    r = width / distance
    below = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a bucket, tables) for ``n`` vectors: unrelated vectors, at a right angle, rarely share a bucket, those at the threshold do in one table at least."""
    near, far = meeting_chance(math.sqrt(max(2 - 2 * cosine, 1e-12))), meeting_chance(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2) / FALSE) / -math.log(far)))
    hit = near**k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < recall else 1


def signature_reach(cosine: float = COSINE) -> int:
    p = math.acos(cosine) / math.pi
    return math.ceil(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p)))


class Hasher:
    """Bucket keys and signatures of unit vectors, with directions drawn from a seed per number of dimensions."""

    def __init__(self, k: int, tables: int):
        self.k, self.tables, self.drawn = k, tables, {}

    def directions(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if d not in self.drawn:
            rng = np.random.default_rng([SEED, d])
            signs = rng.standard_normal((d, BITS))
            mixers = rng.integers(1, 1 << 63, size=(self.tables, self.k), dtype=np.uint64) | np.uint64(1)
            self.drawn[d] = rng.standard_normal((d, self.tables * self.k)), rng.uniform(0, WIDTH, self.tables * self.k), mixers, signs
        return self.drawn[d]

    def __call__(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, one per table; signatures as two 64-bit words) of rows of equal length."""
        a, shift, mixers, signs = self.directions(units.shape[1])
        cells = np.floor((units @ a + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(units), self.tables, self.k)
        h = (cells * mixers).sum(axis=2, dtype=np.uint64) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(units.shape[1])
        for shift_by, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift_by))) * np.uint64(factor)
        bits = np.packbits((units @ signs > 0).astype(np.uint8), axis=1)
        return (h ^ (h >> np.uint64(33))).view(np.int64), bits.view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_length(vectors) -> dict[int, np.ndarray]:
    """Positions of the vectors of each number of dimensions."""
    sizes = np.array([len(v) for v in vectors])
    return {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}


def _matrix(vectors, at) -> np.ndarray:
    return unit(np.stack([np.frombuffer(vectors[i], np.float64) for i in at]))


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): vectors that can link, as packed doubles; one row per id, the smallest of the vectors that share it."""
    v = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null").filter(F.coalesce(fine, F.lit(False)))
    again = cut_lineage(rows.groupBy("id").count().filter("count > 1").select("id"))
    if not again.isEmpty():
        rows = rows.join(again, "id", "left_anti").unionByName(rows.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "x": [np.asarray(v, np.float64).tobytes() for v in pdf["v"]]})

    return stored(map_batches(rows, pack, "id long, x binary"), "vectors")


def _hashed(vectors: DataFrame, hasher: Hasher) -> DataFrame:
    """(id, keys, s0, s1)."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2_000):
                part = pdf.iloc[at : at + 2_000]
                ids, xs = part["id"].to_numpy(), part["x"].tolist()
                for rows in by_length(xs).values():
                    keys, bits = hasher(_matrix(xs, rows))
                    yield pd.DataFrame({"id": ids[rows], "keys": list(keys), "s0": bits[:, 0], "s1": bits[:, 1]})

    return map_batches(vectors, run, "id long, keys array<long>, s0 long, s1 long")


def _star_links(pairs: DataFrame, sketches: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Linked pairs (a, b) of distinct candidate pairs: by signatures, then by cosines."""
    side = lambda d, k: d.select(F.col("id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in d.columns if c != "id"])
    apart = F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))) + F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b")))
    near = pairs.join(side(sketches, "a"), "a").join(side(sketches, "b"), "b").filter(apart <= signature_reach(cosine)).select("a", "b")
    rows = cut_lineage(near).join(side(vectors, "a"), "a").join(side(vectors, "b"), "b").select("a", "b", "xa", "xb")

    def check(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2_000):
                part = pdf.iloc[at : at + 2_000]
                a, b, xa, xb = part["a"].to_numpy(), part["b"].to_numpy(), part["xa"].tolist(), part["xb"].tolist()
                for d, rows in by_length(xa).items():
                    rows = np.array([i for i in rows if len(xb[i]) == d], np.int64)
                    if len(rows):
                        linked = np.einsum("ij,ij->i", _matrix(xa, rows), _matrix(xb, rows)) >= cosine
                        yield pd.DataFrame({"a": a[rows[linked]], "b": b[rows[linked]]})

    return cut_lineage(map_batches(rows, check, "a long, b long"))


def _blocks(batches, names: list[str]):
    """Consecutive rows of equal ``names``, as (values of names, frame)."""
    now, held = None, []
    for pdf in batches:
        for key, part in pdf.groupby(names, sort=False):
            if key != now:
                if held:
                    yield now, pd.concat(held, ignore_index=True)
                now, held = key, []
            held.append(part)
    if held:
        yield now, pd.concat(held, ignore_index=True)


def cosines(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Cosine of every x with every y; -2 where the numbers of dimensions differ."""
    out = np.full((len(xs), len(ys)), -2.0)
    left, right = by_length(xs), by_length(ys)
    for d in left.keys() & right.keys():
        out[np.ix_(left[d], right[d])] = _matrix(xs, left[d]) @ _matrix(ys, right[d]).T
    return out


def _block_links(mixed: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Linked pairs that join the components of rows (key, id, component) within their keys; a spanning set of them.

    A key of many rows is cut into sub-blocks that meet two at a time."""
    subs = mixed.groupBy("key").agg(F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("subs"))
    rows = mixed.join(subs, "key").withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    rows = rows.select("key", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "id", "component").join(vectors, "id")

    def compare(batches):
        for _, block in _blocks(batches, ["key", "i", "j"]):
            ids, xs, root = block["id"].to_numpy(), block["x"].tolist(), pd.factorize(block["component"])[0]
            linked, found = cosines(xs, xs) >= cosine, []
            for k in range(1, len(ids)):  # joins the components of k and of all before it that it links with
                for j in np.flatnonzero(linked[k, :k] & (root[:k] != root[k])):
                    if root[j] != root[k]:
                        found.append((min(ids[j], ids[k]), max(ids[j], ids[k])))
                        root[root == root[k]] = root[j]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return cut_lineage(map_batches(rows, compare, "a long, b long").distinct())


def linked_groups(vectors: DataFrame, cosine: float, recall: float) -> DataFrame:
    """(node, component) of the vectors (id, x) that link with another one."""
    hasher = Hasher(*plan_tables(vectors.count(), cosine, recall))
    hashed = _hashed(vectors, hasher)
    sketches = stored(hashed.select("id", "s0", "s1"), "signatures")
    rows = hashed.select("id", F.explode("keys").alias("key"))
    # the smallest id of a bucket is found map-side first; a bucket that holds a third of all rows then joins as one row
    leaders = rows.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader <> last").select("key", "leader")
    met = stored(rows.join(leaders, "key").filter("id <> leader").select("key", "id", "leader"), "buckets")
    links = _star_links(met.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), sketches, vectors, cosine)
    groups = cut_lineage(components(links))
    placed = cut_lineage(met.join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    more = _block_links(placed.join(several, "key"), vectors, cosine)
    return groups if more.isEmpty() else cut_lineage(components(links.union(more)))


def link_counts(groups: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """(id, n_links): how many vectors of its component each vector links with.

    Members are dealt to blocks of about ``BLOCK``. A block's own pairs are counted in its task. Two blocks of one component meet by centre and radius first: where all pairs are
    linked, each side counts the other's size; where none is, nothing; else their vectors meet."""
    reach = math.acos(cosine)
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"))
    members = groups.join(sizes, "component").select(F.col("node").alias("id"), "component", F.pmod(F.xxhash64("node"), "subs").cast("int").alias("sub"), "subs")
    members = members.join(vectors, "id")

    def inside(batches):
        for (component, sub, subs), block in _blocks(batches, ["component", "sub", "subs"]):
            xs = block["x"].tolist()
            n = (cosines(xs, xs) >= cosine).sum(axis=1) - 1
            out = pd.DataFrame({"component": component, "sub": sub, "id": block["id"].astype("Int64"), "n": n, "centre": None, "radius": np.nan})
            if subs > 1:
                u = _matrix(xs, range(len(xs)))  # a component has one number of dimensions
                centre = unit(u.mean(axis=0, keepdims=True) + 0.0) if np.abs(u.mean(axis=0)).max() > 1e-9 else u[:1]
                radius = float(np.arccos(np.clip(u @ centre[0], -1, 1)).max())
                out = pd.concat([out, pd.DataFrame({"component": [component], "sub": [sub], "id": pd.array([None], "Int64"), "n": [len(xs)], "centre": [centre.tobytes()], "radius": [radius]})])
            yield out

    rows = members.select("component", "sub", "subs", "id", "x").repartition("component", "sub").sortWithinPartitions("component", "sub", "id")
    told = stored(map_batches(rows, inside, "component long, sub int, id long, n long, centre binary, radius double"), "vector-blocks")
    own = told.filter("id is not null").select("id", "component", "sub", "n")
    heads = told.filter("id is null").drop("id")
    if heads.isEmpty():
        return own.select("id", F.col("n").alias("n_links"))
    other = heads.select("component", F.col("sub").alias("j"), F.col("n").alias("nj"), F.col("centre").alias("cj"), F.col("radius").alias("rj"))
    meets = heads.withColumnRenamed("sub", "i").join(other, "component").filter("i < j")

    def settle(batches):
        for pdf in batches:
            c = np.array([float(np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64)) for a, b in zip(pdf["centre"], pdf["cj"])])
            gap, spread = np.arccos(np.clip(c, -1, 1)), (pdf["radius"] + pdf["rj"]).to_numpy()
            kind = np.where(gap + spread <= reach - 1e-6, 1, np.where(gap - spread > reach + 1e-6, 0, 2))
            yield pdf[["component", "i", "j", "n", "nj"]].assign(kind=kind)

    meets = cut_lineage(map_batches(meets, settle, "component long, i int, j int, n long, nj long, kind int"))
    whole = meets.filter("kind = 1").select("component", F.explode(F.array(F.struct(F.col("i").alias("sub"), F.col("nj").alias("more")), F.struct(F.col("j").alias("sub"), F.col("n").alias("more")))).alias("s"))
    whole = whole.groupBy("component", "s.sub").agg(F.sum("s.more").alias("more"))
    partly = meets.filter("kind = 2").select("component", "i", "j", F.explode(F.array("i", "j")).alias("sub"))
    rows = partly.join(members.select("component", "sub", "id", "x"), ["component", "sub"]).select("component", "i", "j", "sub", "id", "x")

    def across(batches):
        for (_, i, _), block in _blocks(batches, ["component", "i", "j"]):
            first = (block["sub"] == i).to_numpy()
            linked = cosines(block["x"][first].tolist(), block["x"][~first].tolist()) >= cosine
            yield pd.DataFrame({"id": np.concatenate([block["id"][first], block["id"][~first]]), "n": np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])})

    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "sub", "id")
    counts = own.join(whole, ["component", "sub"], "left").select("id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")).unionByName(map_batches(rows, across, "id long, n long"))
    return counts.groupBy("id").agg(F.sum("n").alias("n_links"))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per input row: (id_col, n_links, component_id, kept).

    Vectors link when their cosine in double precision is at least ``cosine``; of the pairs at that very cosine a share of ``recall`` or more is expected to be found, of closer
    ones more, and none below it is taken. ``n_links`` counts the linked vectors of the component, ``component_id`` is the smallest id reachable, itself included, ``kept`` marks it.
    Null or empty vectors, all-zero ones and those with null or non-finite components link with nothing, nor do vectors of different lengths. Rows that repeat an id
    are one vector, the smallest of theirs that can link; a null id links with nothing, has a null component and is kept. An empty table gives no rows; other columns are not read."""
    vectors = usable_vectors(df, id_col, vector_col)
    groups = linked_groups(vectors, cosine, recall)
    found = link_counts(groups, vectors, cosine).join(groups.withColumnRenamed("node", "id"), "id")
    out = df.select(F.col(id_col).alias("_id")).join(found, F.col("_id") == F.col("id"), "left")
    out = out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", F.col("_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_vector_dedup": op13_vector_dedup}
ORACLES = {
    "op13_vector_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, x, len(x) AS d, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS r FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE list_inner_product(a.x, b.x) / (a.r * b.r) >= {COSINE}),
reach AS (SELECT a AS node, a AS seen FROM l UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.seen),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, v.vec_id) AS component_id, v.vec_id = coalesce(c.component, v.vec_id) AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.node = v.vec_id""",
}
