"""N-gram Jaccard self-join over prefix trees.

A document is the set of hashes of its word n-grams in one global order (by hash), which is a path in a trie. Two sets of Jaccard similarity t or more differ in at most
D of their elements, D known from their sizes, so when the order is cut in more than D ranges they agree on a whole range: the path segment of that range is
the key under which they meet. Within what meets, sets are compared by walking the trie of one side: paths are sorted, the part a path shares with
the one before is not counted again, and a path is left as soon as the elements that remain on either side cannot reach the overlap it needs.

Links are only needed up to connectivity, which keeps dense groups linear: first every set meets the smallest id under each of its keys; then the sets of
keys that still hold several components meet in blocks. Bitmaps rule out most pairs before sets are shipped and walked. Sets in one component are not compared again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import components, discard, map_batches, release_shuffles, stored, table, text_or_empty
from plumbline.session import cut_lineage

WORDS, PERCENT = 5, 80
#: characters of text per numpy step; paths of a trie; bitmaps of a block; elements of a block's paths; words of bitmaps compared at once
CHUNK, BLOCK, BITMAPS, PATHS, STEP = 500_000, 64, 4_096, 2_000_000, 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: white space that separates words: 0x20 and 0x09-0x0D
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_sets(texts: list[str], width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-grams of each text. A text of fewer words has one gram, the whole sequence; one without words has none."""
    if not texts:
        return []
    raw = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    doc_end = np.cumsum([len(r) for r in raw])
    b = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    blank = _BLANK[b]
    begin = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    stop = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    if not len(begin):
        return [np.zeros(0, np.uint64)] * len(texts)
    # a word's hash is the sum of a mixed value of each byte and its place
    size = stop - begin
    at = np.repeat(begin, size) + (place := np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    h = (b[at].astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * _GOLD + np.uint64(0xD1B54A32D192ED03))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    words = mix(np.add.reduceat(h, np.cumsum(size) - size) + size.astype(np.uint64))
    counts = np.diff(np.append(0, np.searchsorted(begin, doc_end)))
    n = len(words)
    grams = np.zeros(n, np.uint64)
    for k in range(width):
        grams[: n - k] = (grams[: n - k] + words[k:]) * (_GOLD + np.uint64(2 * k)) if n > k else grams[: n - k]
    grams = mix(grams)
    out, a = [], 0
    for c in counts.tolist():
        if c >= width:
            g = np.sort(grams[a : a + c - width + 1])
            out.append(g[np.append(True, g[1:] != g[:-1])])
        elif c:
            whole = np.array([c], np.uint64)
            for k in range(a, a + c):
                whole = mix((whole + words[k : k + 1]) * _GOLD)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        a += c
    return out


class Keys:
    """Keys of sets for a similarity of ``percent`` / 100 or more.

    Sizes fall in classes such that linked sets are in the same or neighbouring classes. Index j serves classes j and j - 1 and cuts the order in
    ``parts(j)`` ranges: one more than linked sets can differ in, and some to spare. Ranges that are empty in both sets agree too, but are no use as keys; as long as a
    set has no more of them than there are spare ranges, one of the others must agree. Sets with more empty ranges use those as keys as well."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [1]

    def cls(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // self.percent))
        return int(np.searchsorted(self.tops, n))

    def parts(self, j: int) -> tuple[int, int]:
        """(ranges, spare ranges) of index j; 0 ranges when linked sets must be equal there."""
        self.cls(self.tops[-1] + 1) if j >= len(self.tops) else None
        differ = 2 * self.tops[j] * (100 - self.percent) // (100 + self.percent)
        spare = 2 + differ // 32
        return (differ + 1 + spare, spare) if differ else (0, 0)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Signed keys: one even key of the whole set, odd keys of its ranges. None for an empty set."""
        n = len(grams)
        if not n:
            return np.zeros(0, np.int64)
        run = np.append(np.uint64(0), np.cumsum(mix(grams + _GOLD)))
        keys = [mix(run[-1:] + np.uint64(n)) & ~np.uint64(1)]
        c = self.cls(n)
        for j in (c, c + 1):
            m, spare = self.parts(j)
            if not m:
                continue
            edges = (np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m))
            cut = np.concatenate([[0], np.searchsorted(grams, edges), [n]])
            size = np.diff(cut)
            seed = np.uint64(j * 1_000_003) + np.arange(m, dtype=np.uint64) * np.uint64(7919)
            key = mix((run[cut[1:]] - run[cut[:-1]]) ^ mix(seed * _GOLD + size.astype(np.uint64))) | np.uint64(1)
            keys.append(key if (size == 0).sum() > spare else key[size > 0])
        return np.concatenate(keys).astype(np.int64)


def needed(a: int, b: int, percent: int) -> int:
    """Least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


class Walk:
    """Overlaps of one set with the paths of a trie that come in sorted order."""

    STEP = 128

    def __init__(self, query: np.ndarray, percent: int):
        self.query, self.percent = query, percent
        self.path = np.zeros(0, np.uint64)
        self.overlap = np.zeros(1, np.int64)  # by depth on the current path, as far as it was walked

    def meet(self, path: np.ndarray, whole: bool = False) -> tuple[bool, int]:
        """(linked, overlap). Unless the ``whole`` overlap is wanted, the walk ends where it can no longer reach a link."""
        q, n = len(self.query), len(path)
        need = needed(q, n, self.percent)
        same = min(len(self.path), n)
        differ = np.flatnonzero(self.path[:same] != path[:same])
        depth = min(int(differ[0]) if len(differ) else same, len(self.overlap) - 1)
        known = [self.overlap[: depth + 1]]
        got = int(self.overlap[depth])
        self.path = path
        passed = int(np.searchsorted(self.query, path[depth - 1], side="right")) if depth else 0
        while depth < n and (whole or got + min(n - depth, q - passed) >= need):
            piece = path[depth : depth + self.STEP]
            at = np.searchsorted(self.query, piece)
            hit = (at < q) & (self.query[np.minimum(at, q - 1)] == piece)
            sums = got + np.cumsum(hit)
            known.append(sums)
            got, depth, passed = int(sums[-1]), depth + len(piece), int(at[-1] + hit[-1])
        self.overlap = np.concatenate(known)
        return depth == n and got >= need, got


def _pack(grams: np.ndarray) -> bytes:
    """Big-endian, so that binary order is path order."""
    return grams.astype(">u8").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u8").astype(np.uint64)


def _meetings(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, id, leader, many, n): the smallest id under each key, and whether there are three or more, for keys that several ids have; and every document's whole-set
    row with its n."""

    def keys(batches):
        maker = Keys(percent)
        for pdf in batches:
            for _, part in pdf.groupby((pdf["text"].str.len() + 1).cumsum() // CHUNK, sort=False):
                sets = gram_sets(part["text"].tolist(), width)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": [len(s) for s in sets], "keys": [maker.of(s) for s in sets]})

    found = map_batches(rows, keys, "id long, n long, keys array<long>")
    flat = found.select("id", "n", F.explode_outer("keys").alias("key"))
    flat = flat.select("key", "id", F.when(F.col("key").isNull() | (F.col("key") % 2 == 0), F.col("n")).alias("n"))
    # an id appears once under a key, so a key's rows are never more than the distinct ids, and an id's rows are spread over all its keys
    some = flat.filter("key is not null")
    w = Window.partitionBy("key").orderBy("id")
    place, ahead = F.row_number().over(w), lambda k: F.lead("id", k).over(w)
    met = some.select("key", "id", "n", F.first("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("leader"), place.alias("place"), ahead(1).alias("after"), ahead(2).alias("later"))
    many = (F.col("place") > 2) | F.when(F.col("place") == 1, F.col("later")).otherwise(F.col("after")).isNotNull()
    met = met.filter("n is not null or place > 1").select("key", "id", "leader", many.alias("many"), "n")
    return stored(met, "ngram-keys")


def _made(rows: DataFrame, ids: DataFrame, width: int, purpose: str, column: str, encode) -> DataFrame:
    """(id, n, column) of the documents in ``ids`` (distinct): size of the set, and what ``encode`` makes of it."""

    def make(batches):
        for pdf in batches:
            for _, part in pdf.groupby((pdf["text"].str.len() + 1).cumsum() // CHUNK, sort=False):
                sets = gram_sets(part["text"].tolist(), width)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": [len(s) for s in sets], column: [encode(s) for s in sets]})

    return stored(map_batches(rows.join(ids, "id", "left_semi"), make, f"id long, n long, {column} binary"), purpose)


def _sketches(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, n, bits): sizes and bitmaps."""
    return _made(rows, ids, width, "ngram-sketches", "bits", lambda s: sketch(s).tobytes())


def _paths(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, n, grams): sizes and paths. Paths take eight bytes a word and do not compress, so only those are made that bitmaps leave to be compared."""
    return _made(rows, ids, width, "ngram-paths", "grams", _pack)


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Linked pairs (a, b) of candidate pairs. The paths of all b of one a form a trie; a popular a has several, of about ``BLOCK`` paths."""
    tries = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("tries"))
    pairs = pairs.join(tries, "a").select("a", "b", F.pmod(F.xxhash64("b"), "tries").alias("trie"))
    heads = pairs.select("a", "trie").distinct().join(sets.select(F.col("id").alias("a"), "grams"), "a").select("a", "trie", F.lit(None).cast("long").alias("b"), "grams")
    paths = pairs.join(sets.select(F.col("id").alias("b"), "grams"), "b").select("a", "trie", "b", "grams")

    def walk(batches):
        now, state = None, None
        for pdf in batches:
            out = []
            for a, trie, b, grams in zip(pdf["a"], pdf["trie"], pdf["b"], pdf["grams"]):
                if (a, trie) != now:  # the row without b comes first
                    now, state = (a, trie), Walk(_unpack(grams), percent)
                elif state.meet(_unpack(grams))[0]:
                    out.append((a, int(b)))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = heads.union(paths).repartition("a", "trie").sortWithinPartitions("a", "trie", F.col("b").isNotNull(), "grams")
    return cut_lineage(map_batches(rows, walk, "a long, b long"))


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parity bitmap: a bit for each residue of the hashes, set when an odd number of elements has it. Two bitmaps differ in no more bits than their sets in elements.
    It has at least one bit per element, a power of two, and folds to half its length by exclusive or."""
    bits = 64
    while bits < len(grams):
        bits *= 2
    odd = np.bincount((grams % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def close_stars(ids: list[int], groups: list[int], sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (smallest id, other id) of what hangs together over pairs of different groups that sizes and bitmaps do not rule out: at most one row for each id."""
    maps = np.stack([fold(x, min(map(len, sketches))) for x in sketches])
    group, label, places = np.array(groups), np.arange(len(ids)), np.arange(len(ids))
    step = max(1, STEP // maps.size)
    for top in range(0, len(ids) - 1, step):
        some, rest = slice(top, top + step), slice(top + 1, None)
        a, b = sizes[some, None], sizes[None, rest]
        most = a + b - 2 * -(-percent * (a + b) // (100 + percent))
        fits = (group[some, None] != group[None, rest]) & (places[some, None] < places[None, rest]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        fits &= np.bitwise_count(maps[some, None] ^ maps[None, rest]).sum(axis=2, dtype=np.int64) <= most
        for k in np.flatnonzero(fits.any(axis=1)).tolist():
            other = label[rest][fits[k]]
            other = other[other != label[top + k]]
            if len(other):
                label[np.isin(label, other)] = label[top + k]
    named = np.array(ids, np.int64)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, named)
    return [(a, b) for a, b in zip(least[label].tolist(), named.tolist()) if a != b]


def tree_links(ids: list[int], groups: list[int], sides: list[int], paths: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (smaller id first) that connect what is linked among sets, fewer than the sets. Sets of one group are connected already; when there are two sides, only sets
    of different sides are compared. Overlaps are counted over the whole sets."""
    out: list[tuple[int, int]] = []
    size = np.array([len(p) for p in paths])
    start = np.cumsum(size) - size
    grams, at = np.unique(np.concatenate(paths), return_inverse=True)
    sketches = [sketch(p) for p in paths]
    maps = np.stack([fold(x, min(map(len, sketches))) for x in sketches])
    label, side = np.unique(groups, return_inverse=True)[1], np.array(sides)
    two, mine = len(set(sides)) > 1, np.zeros(len(grams), bool)
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        both = size[i] + size[rest]
        need = -(-percent * both // (100 + percent))
        fits = (label[rest] != label[i]) & (100 * np.minimum(size[i], size[rest]) >= percent * np.maximum(size[i], size[rest]))
        if two:
            fits &= side[rest] != side[i]
        near = np.flatnonzero(fits)
        near = near[np.bitwise_count(maps[near + i + 1] ^ maps[i]).sum(axis=1, dtype=np.int64) <= (both - 2 * need)[near]]
        if not len(near):
            continue
        other = near + i + 1
        mine[at[start[i] : start[i] + size[i]]] = True
        ends = np.cumsum(size[other])
        hit = mine[at[np.arange(ends[-1]) + np.repeat(start[other] - ends + size[other], size[other])]]
        overlap = np.add.reduceat(hit.astype(np.int64), ends - size[other])
        mine[at[start[i] : start[i] + size[i]]] = False
        linked = other[overlap >= need[near]]
        for name, j in zip(*np.unique(label[linked], return_index=True)):
            out.append((min(ids[i], ids[linked[j]]), max(ids[i], ids[linked[j]])))
            label[label == name] = label[i]
    return out


def _block_runs(function, names: list[str], keys: int):
    """A function over batches of sorted rows that gives each run of equal first ``keys`` columns, as a list of rows, to ``function`` and yields its pairs (a, b)."""

    def run(batches):
        now, held = None, []
        pairs = lambda: pd.DataFrame(function(held) if len(held) > 1 else [], columns=["a", "b"], dtype="int64")
        for pdf in batches:
            for row in zip(*(pdf[c] for c in names)):
                if row[:keys] != now:
                    yield pairs()
                    now, held = row[:keys], []
                held.append(row[keys:])
        yield pairs()

    return run


def _block_stars(mixed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of different components under keys (key, id, component) that hold several: a linked pair that shares a key hangs together over them.

    A key of many sets is cut in sub-blocks that meet two at a time, so a block has about ``BITMAPS`` sets at most. Blocks of the same sets are compared once. A block
    returns fewer rows than it has sets, however many of its pairs are close."""
    subs = mixed.groupBy("key").agg(F.ceil(F.count("*") / (BITMAPS // 2)).cast("int").alias("subs"))
    rows = mixed.join(subs, "key").withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    rows = rows.groupBy("key", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j")).agg(F.sort_array(F.collect_set(F.struct("id", "component"))).alias("members"))
    blocks = rows.filter(F.size(F.array_distinct(F.col("members.component"))) > 1).select("members").distinct()
    flat = blocks.select(F.xxhash64("members.id").alias("block"), F.explode("members").alias("m")).select("block", "m.id", "m.component").join(sketches, "id")

    def compare(held):
        return close_stars([int(h[0]) for h in held], [int(h[1]) for h in held], np.array([h[2] for h in held]), [np.frombuffer(h[3], np.uint64) for h in held], percent)

    names = ["block", "id", "component", "n", "bits"]
    rows = flat.select(*names).repartition("block").sortWithinPartitions("block", "id")
    return cut_lineage(map_batches(rows, _block_runs(compare, names, 1), "a long, b long").distinct())


def _cluster_links(clusters: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked inside clusters (node, component) of candidates; ``members`` (id, component) tells what is connected already.

    A set is in one cluster, so its path is shipped once; a cluster of more than ``BITMAPS`` sets or ``PATHS`` elements is cut in sub-blocks that meet two at a time."""
    rows = clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(members, "id").join(sets.select("id", "n", "grams"), "id")
    sizes = rows.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / (BITMAPS // 2)), F.ceil(F.sum("n") / (PATHS // 2))).cast("int").alias("subs"))
    rows = rows.join(sizes, "cluster").withColumn("sub", F.pmod(F.xxhash64("id"), "subs").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumns({"i": F.least("sub", "other"), "j": F.greatest("sub", "other")})

    def compare(held):
        return tree_links([int(h[1]) for h in held], [int(h[2]) for h in held], [int(h[0]) for h in held], [_unpack(h[3]) for h in held], percent)

    names = ["cluster", "i", "j", "sub", "id", "component", "grams"]
    rows = rows.select(*names).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
    return cut_lineage(map_batches(rows, _block_runs(compare, names, 3), "a long, b long"))


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of so many 64-bit words, at most its own."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _bounds(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, near, apart, reach) of candidate pairs: whether sizes and bitmaps leave a link possible; in how many bits b differs from a at half the length of a's
    bitmap; and the most bits in which two linked sets under a key led by a can differ there."""

    def compare(batches):
        for pdf in batches:
            out = []
            for a, b, na, nb, xa, xb in zip(pdf["a"], pdf["b"], pdf["na"], pdf["nb"], pdf["xa"], pdf["xb"]):
                x, y = np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)
                same = min(len(x), len(y))
                most = na + nb - 2 * needed(na, nb, percent)
                near = 100 * min(na, nb) >= percent * max(na, nb) and int(np.bitwise_count(fold(x, same) ^ fold(y, same)).sum()) <= most
                half = max(1, len(x) // 2)
                # sets under a key are at most a factor (100 / percent) ** 2 larger than its smallest
                out.append((a, b, near, int(np.bitwise_count(fold(x, half) ^ fold(y, half)).sum()), 2 * (na * 10_000 // (percent * percent) + 1) * (100 - percent) // (100 + percent)))
            yield pd.DataFrame(out, columns=["a", "b", "near", "apart", "reach"])

    side = lambda k: sketches.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb")
    return cut_lineage(map_batches(rows, compare, "a long, b long, near boolean, apart long, reach long"))


def _links(starred: DataFrame, sketches: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect what is linked among sets that share a key: (key, id, leader, many), the leader being the key's smallest id and not among the rows.

    Each set is compared with its leader, by bitmaps first. Bits that differ are a metric: sets whose distances from the leader differ by more than linked sets
    can cannot be linked, so a key falls apart where the sorted distances have such a gap. Parts that lie in one component are done, the others are compared in blocks."""
    spark = sketches.sparkSession
    bounds = _bounds(starred.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), sketches, percent)
    release_shuffles(spark)
    near = bounds.filter("near").select("a", "b")
    paths = _paths(rows, near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), width)
    release_shuffles(spark)
    links = _star_links(near, paths, percent)
    discard(paths)
    groups = cut_lineage(components(links))
    release_shuffles(spark)
    placed = bounds.join(groups.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("leader"), F.col("b").alias("id"), "apart", "reach", F.coalesce("component", "b").alias("component"))
    far = starred.filter("many").join(placed, ["leader", "id"])
    by_distance = Window.partitionBy("key").orderBy("apart", "id")
    gap = F.coalesce((F.col("apart") - F.lag("apart").over(by_distance) > F.col("reach")).cast("int"), F.lit(0))
    far = far.withColumn("gap", gap).withColumn("part", F.sum("gap").over(by_distance.rowsBetween(Window.unboundedPreceding, 0))).select(F.xxhash64("key", "part").alias("key"), "id", "component")
    far = cut_lineage(far)
    several = far.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    mixed = far.join(several, "key")
    stars = _block_stars(mixed, sketches, percent)
    if stars.isEmpty():
        return links
    clusters = cut_lineage(components(stars))
    release_shuffles(spark)
    paths = _paths(rows, clusters.select(F.col("node").alias("id")), width)
    release_shuffles(spark)
    found = _cluster_links(clusters, mixed.select("id", "component").distinct(), paths, percent)
    discard(paths)
    return links.union(found)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: (id_col, n_shingles, component_id).

    Words are runs of anything but 0x20 and 0x09-0x0D, after lower-casing A-Z. Documents link when 100 * intersection >= percent * union of their n-gram
    sets; ``component_id`` is the smallest id reachable over links. Documents without words, and null texts, have no n-grams and link with nothing.
    Rows that repeat an id are one document, of their distinct texts one after the other. A row with a null id links
    with nothing, counts no n-grams and has a null component. An empty table gives no rows. N-grams are compared by 64-bit hashes."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = texts.filter("id is not null")
    again = cut_lineage(rows.groupBy("id").count().filter("count > 1").select("id"))
    if not again.isEmpty():
        told = rows.join(again, "id", "left_semi").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("text"))
        rows = rows.join(again, "id", "left_anti").unionByName(told)
    met = _meetings(rows, width, percent)
    copies = cut_lineage(met.filter("n is not null and id <> leader").groupBy("id").agg(F.min("leader").alias("rep")))
    # equal sets have the same keys, so a key's smallest id is never a copy
    starred = stored(met.filter("n is null").join(copies.select("id"), "id", "left_anti").select("key", "id", "leader", "many"), "ngram-stars")
    sizes = stored(met.filter("n is not null").select("id", "n"), "ngram-sizes")
    discard(met)
    release_shuffles(docs.sparkSession)
    sketches = _sketches(rows, starred.select("id").union(starred.select("leader")).distinct(), width)
    release_shuffles(docs.sparkSession)
    groups = cut_lineage(components(_links(starred, sketches, rows, width, percent)))
    discard(starred)
    discard(sketches)
    release_shuffles(docs.sparkSession)
    known = sizes.join(copies, "id", "left").select("id", "n", F.coalesce("rep", "id").alias("rep")).join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("id", "n", F.coalesce("component", "rep").alias("component"))
    out = docs.select(F.col(id_col).cast("long").alias("id")).join(known, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, all columns kept; null ids stay. Only the ids that go are joined back."""
    found = near_groups(docs, id_col, text_col, width, percent)
    gone = cut_lineage(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct())
    release_shuffles(docs.sparkSession)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


QUERIES = {"op4_ngram_join": op4_ngram_join}
ORACLES: dict[str, str] = {}
