"""Cross-tokenizer alignment with exact-text deduplication.

Texts are shuffled by themselves, counted map-side first, so each distinct text is tokenised and aligned once. Its pair counts weigh as often as the text occurs, and its
measures are joined back to the document ids.

The corpus-wide counts of id pairs meet the texts again in buckets of B ids: a task holds the counts of one bucket, whose size is bounded by the product of the vocabularies,
and looks up the packed pairs of many texts at once. No pair occurrence is a row.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import map_batches, stored, table, text_or_empty

#: characters of texts whose pairs are packed together; buckets of B ids; packed bytes of a bucket that one task looks up
CHUNK, BUCKETS, TASK_BYTES = 1_000_000, 64, 64 << 20
#: units that a worker remembers; distinct pairs it sums up before it passes them on
UNITS, PAIRS = 300_000, 2_000_000
B_BITS = 16


def byte_level() -> dict[str, int]:
    """Character of a byte-level vocabulary to its byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Texts to aligned ids of a byte-level vocabulary (A, fed with space and text) and a sentence-piece one (B, which adds the space itself).

    Tokens of either never reach over a single space that follows anything but a space and precedes anything but white space, on to what comes before it. So
    a text falls into units there, tokens of both end at every unit's end, and a unit that was seen before is not tokenised or aligned again."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = byte_level()
        vocab = self.a.get_vocab()
        self.bytes_a = {i: bytes(map(chars.__getitem__, t)) if all(c in chars for c in t) else t.encode() for t, i in vocab.items()}
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = {i: piece(i) for i in range(self.b.get_piece_size())}
        self.cut = re.compile(r"(?<=[^ ]) (?=\S)")
        lengths = lambda held: np.array([len(held.get(i, b"")) for i in range(max(held) + 1)])
        self.lengths_a, self.lengths_b = lengths(self.bytes_a), lengths(self.bytes_b)
        #: decimal ids with what follows them: within a group, at the end of its A ids, at the end of its B ids
        size = max(len(self.lengths_a), len(self.lengths_b))
        self.size, self.told = size, [f"{i}{end}" for end in ",|;" for i in range(size)]
        self.store: dict[str, tuple | None] = {}

    def align(self, units: list[str], a: np.ndarray, b: np.ndarray, size: np.ndarray) -> None:
        """Remember units from the tokens of all of them, one after the other, and their bytes with the space.

        The ends of all tokens cut the bytes into segments; each lies in one token of A and one of B, and two tokens that overlap share just one."""
        stop, ends_a, ends_b = np.cumsum(size), np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        common, ends = np.intersect1d(ends_a, ends_b, assume_unique=True), np.union1d(ends_a, ends_b)
        pairs = (a[np.searchsorted(ends_a, ends)] << B_BITS | b[np.searchsorted(ends_b, ends)]).astype(np.uint32).tobytes()
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last = lambda g: np.append(g[1:] != g[:-1], True)
        told = np.empty(len(a) + len(b), np.int64)  # the tokens of A and then of B, group by group
        told[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + self.size * last(group_a)
        told[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + 2 * self.size * last(group_b)
        told = list(map(self.told.__getitem__, told.tolist()))
        cut = lambda ends: np.searchsorted(ends, stop, "right")
        counts = lambda at: np.diff(at, prepend=0).tolist()
        at_a, at_b, at_pair, at_group = cut(ends_a), cut(ends_b), cut(ends), cut(common)
        i = j = 0
        for u, n_a, n_b, n, p, w in zip(units, counts(at_a), counts(at_b), counts(at_group), (4 * at_pair).tolist(), (at_a + at_b).tolist()):
            self.store[u] = n_a, n_b, n, pairs[i:p], "".join(told[j:w])[:-1]
            i, j = p, w

    def learn(self, units: list[str]) -> None:
        """Tokenise and align new units. Those that start with no white space and end with no space go to the libraries as one text, which falls apart at them again."""
        plain = [u for u in units if u and u[-1] != " " and not u[0].isspace()]
        apart = set(units).difference(plain)
        for at in range(0, len(plain), 2_000):
            part = plain[at : at + 2_000]
            text = " ".join(part)
            a = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
            b = np.array(self.b.encode(text), np.int64)
            if b"".join(map(self.bytes_a.__getitem__, a.tolist())) == b"".join(map(self.bytes_b.__getitem__, b.tolist())) == (" " + text).encode():
                self.align(part, a, b, np.array([len(u.encode()) + 1 for u in part]))
            else:
                apart.update(part)
        apart = sorted(apart)
        for at in range(0, len(apart), 2_000):
            part = apart[at : at + 2_000]
            fine, a, b = [], [], []
            for u, e, y in zip(part, self.a.encode_batch_fast([" " + u for u in part], add_special_tokens=False), self.b.encode(part, num_threads=1)):
                if b"".join(map(self.bytes_a.__getitem__, e.ids)) == b"".join(map(self.bytes_b.__getitem__, y)) == b" " + u.encode():
                    fine.append(u)
                    a += e.ids
                    b += y
                else:
                    self.store[u] = None
            if fine:
                self.align(fine, np.array(a, np.int64), np.array(b, np.int64), np.array([len(u.encode()) + 1 for u in fine]))

    def __call__(self, texts: list[str]) -> list[tuple[int, int, int, bytes, str] | None]:
        """(tokens of A, of B, groups, packed pairs, groups as text) of each text; None when the bytes of its tokens differ from the text's. No text may be empty."""
        split = [self.cut.split(t) for t in texts]
        if len(self.store) > UNITS:
            self.store.clear()
        self.learn(list(set().union(*split).difference(self.store)))
        out = []
        for units in split:
            held = list(map(self.store.__getitem__, units))
            if None in held:
                out.append(None)
                continue
            n_a, n_b, groups, pairs, told = zip(*held)
            out.append((sum(n_a), sum(n_b), sum(groups), b"".join(pairs), ";".join(told)))
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of two vocabulary files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


class PairSums:
    """Weighted counts of id pairs over the batches of a task, passed on when they grow too many."""

    def __init__(self):
        self.keys, self.sums, self.loose = [], [], 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.loose += len(keys)

    def compact(self) -> int:
        keys, at = np.unique(np.concatenate(self.keys or [np.zeros(0, np.int64)]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate(self.sums or [np.zeros(0, np.int64)]))
        self.keys, self.sums, self.loose = [keys], [sums], 0
        return len(keys)

    def drain(self):
        if self.compact():
            for at in range(0, len(self.keys[0]), 100_000):
                yield pd.DataFrame({"pair": self.keys[0][at : at + 100_000], "n": self.sums[0][at : at + 100_000]})
        self.keys, self.sums = [], []


def bucket_of(pairs):
    return (pairs & ((1 << B_BITS) - 1)) % BUCKETS


def pack_pairs(keys: np.ndarray, places: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys as differences, then places and times, each an array of unsigned 32-bit integers."""
    return np.concatenate([np.diff(keys, prepend=0), places, times]).astype("<u4").tobytes()


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(data, "<u4").reshape(3, -1).astype(np.int64)
    return np.cumsum(a[0]), a[1], a[2]


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One stored table of three kinds of rows from distinct texts (text, copies): measures of a text (``sha``), packed pairs of a batch in a bucket (``data``), and
    pair counts weighted by copies (``pair``, ``n``)."""
    schema = "batch long, place int, sha string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, data binary, pair long, n long"
    empty = {f.split()[0]: None for f in schema.split(", ")}
    rows = lambda d: d.assign(**{c: None for c in empty if c not in d})[list(empty)]

    def run(batches):
        align, sums = aligner(path_a, path_b), PairSums()
        task, batch = TaskContext.get().partitionId() << 32, 0
        for pdf in batches:
            for _, part in pdf.groupby((pdf["text"].str.len() + 1).cumsum() // CHUNK, sort=False):
                texts, copies = part["text"].tolist(), part["copies"].to_numpy()
                found = align(texts)
                batch += 1
                told = [(task + batch, k, hashlib.sha256(t.encode()).hexdigest(), *((f[0], f[1], f[2], len(f[3]) // 4, hashlib.sha256(f[4].encode()).hexdigest()) if f else (0, 0, 0, 0, ""))) for k, (t, f) in enumerate(zip(texts, found))]
                yield rows(pd.DataFrame(told, columns=list(empty)[:8]))
                links = np.frombuffer(b"".join(f[3] for f in found if f), np.uint32).astype(np.int64)
                if not len(links):
                    continue
                place = np.repeat(np.arange(len(texts)), [len(f[3]) // 4 if f else 0 for f in found])
                both, times = np.unique(bucket_of(links) << 52 | links << 20 | place, return_counts=True)  # at most CHUNK texts, so 20 bits
                bucket, keys, place = both >> 52, both >> 20 & 0xFFFFFFFF, both & 0xFFFFF
                cut = np.searchsorted(bucket, np.arange(BUCKETS + 1))
                used = np.flatnonzero(np.diff(cut))
                data = [pack_pairs(keys[cut[k] : cut[k + 1]], place[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]]) for k in used]
                yield rows(pd.DataFrame({"batch": task + batch, "bucket": used, "data": data}))
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                sums.add(keys[first], np.add.reduceat(times * copies[place], first))
                if sums.loose > PAIRS and sums.compact() > PAIRS:
                    yield from map(rows, sums.drain())
        yield from map(rows, sums.drain())

    return stored(map_batches(texts, run, schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): corpus-wide count of each linked id pair, and whether it is the highest of its B id, ties included."""
    counts = aligned.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    return counts.withColumn("b", b).select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy("b"))).alias("best"))


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(batch, place, n_best, count_sum): the packed pairs of all texts met with the counts of their buckets.

    A bucket's packed pairs are dealt over as many tasks as their bytes ask for; the bucket's counts go to each of them."""
    blocks = aligned.filter("data is not null").select("bucket", "batch", "data")
    sizes = blocks.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("data")) / TASK_BYTES).cast("int").alias("tasks"))
    sizes = stored(sizes, "bucket-sizes")

    def pack(batches):
        for pdf in batches:
            for bucket, part in pdf.groupby("bucket", sort=False):
                yield pd.DataFrame({"bucket": [bucket], "first": [part["pair"].iloc[0]], "pairs": [part["pair"].to_numpy(np.int64).tobytes()], "n": [part["n"].to_numpy(np.int64).tobytes()], "best": [part["best"].to_numpy(bool).tobytes()]})

    held = counts.withColumn("bucket", F.pmod(F.col("pair").bitwiseAND((1 << B_BITS) - 1), F.lit(BUCKETS)).cast("int"))
    held = map_batches(held.repartition("bucket").sortWithinPartitions("bucket", "pair"), pack, "bucket int, first long, pairs binary, n binary, best binary")
    held = stored(held, "pair-counts").join(sizes, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "first", "pairs", "n", "best", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("binary").alias("data"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    asked = blocks.join(sizes, "bucket").select("bucket", F.pmod(F.xxhash64("batch"), "tasks").cast("int").alias("task"), none("first", "long"), none("pairs", "binary"), none("n", "binary"), none("best", "binary"), "batch", "data")
    rows = held.union(asked).repartition("bucket", "task").sortWithinPartitions("bucket", "task", F.col("first").isNull(), "first", "batch")

    def look_up(batches):
        now, slices, known = None, [], None
        for pdf in batches:
            out = []
            for bucket, task, pairs, n, best, batch, data in zip(pdf["bucket"], pdf["task"], pdf["pairs"], pdf["n"], pdf["best"], pdf["batch"], pdf["data"]):
                if (bucket, task) != now:
                    now, slices, known = (bucket, task), [], None
                if data is None:  # counts come first, in order
                    slices.append((np.frombuffer(pairs, np.int64), np.frombuffer(n, np.int64), np.frombuffer(best, bool)))
                    continue
                if known is None:
                    known, slices = tuple(map(np.concatenate, zip(*slices))), []
                keys, place, times = unpack_pairs(data)
                at = np.searchsorted(known[0], keys)
                places, where = np.unique(place, return_inverse=True)
                total, top = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
                np.add.at(total, where, times * known[1][at])
                np.add.at(top, where, times * known[2][at])
                out.append((int(batch), np.concatenate([places, top, total]).astype("<i8").tobytes()))
            yield pd.DataFrame(out, columns=["batch", "data"])

    parts = map_batches(rows, look_up, "batch long, data binary")

    def combine(batches):
        now, held = None, []

        def flush():
            a = np.concatenate([np.frombuffer(d, "<i8").reshape(3, -1) for d in held], axis=1)
            places, where = np.unique(a[0], return_inverse=True)
            out = np.zeros((2, len(places)), np.int64)
            np.add.at(out[0], where, a[1])
            np.add.at(out[1], where, a[2])
            return pd.DataFrame({"batch": now, "place": places, "n_best": out[0], "count_sum": out[1]})

        for pdf in batches:
            for batch, data in zip(pdf["batch"], pdf["data"]):
                if batch != now:
                    if held:
                        yield flush()
                    now, held = batch, []
                held.append(data)
        if held:
            yield flush()

    return map_batches(parts.repartition("batch").sortWithinPartitions("batch"), combine, "batch long, place int, n_best long, count_sum long")


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Special tokens' strings are plain text. Null and empty texts, and those whose tokens' joined bytes are not a space and the text for both vocabularies, have no tokens: zeros and an
    empty string; they count towards no pair. Equal texts have equal values; every row counts, also rows that repeat an id or have none. Other columns are not read; an empty table gives no rows.
    Documents meet the measures of their text by SHA-256."""
    text = text_or_empty(text_col)
    distinct = docs.select(text.alias("text")).filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    aligned = aligned_texts(distinct, path_a, path_b)
    found = _looked_up(aligned, pair_counts(aligned))
    measures = aligned.filter("sha is not null").select("batch", "place", "sha", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(found, ["batch", "place"], "left").drop("batch", "place")
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(text.cast("binary"), 256).alias("_sha")).join(measures, F.col("_sha") == F.col("sha"), "left")
    return rows.select(F.col("_id").alias(id_col), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}
