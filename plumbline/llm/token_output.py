"""Token-id files in Simple-8b: selectors pack varying counts of ids into 64-bit words.

A word's top four bits are its selector, the other sixty hold the ids. Ids are coded in blocks of ``BLOCK``; each file carries the word offset of every block,
so any block can be decoded alone, and all words of one selector decode in one vector step.
"""

from __future__ import annotations

import os
import re
import struct
import uuid

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import filesystem, shared_folder, table, text_or_empty, write_manifest
from plumbline.llm.warc import range_shards, sharded

#: fixed values of the code: ids per word and bits per id by selector. Selectors 0 and 1 are runs of zeros. The last is the
#: escape: one id too wide for the others, in a word of its own.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
SHORT_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)
BLOCK = 1_024
MAGIC = b"S8B1"
SHARD_BYTES = 32 << 20
END_ID = 1
#: distinct words whose ids a worker keeps
CACHE_WORDS = 800_000
#: marks whose runs are one pre-token each, so a run after a letter is kept apart from its word
MARKS = ".,!#$%&*"


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    ids = np.asarray(ids)
    if ids.max() < 1 << 16:
        return SHORT_BITS[ids]
    ids = ids.astype(np.uint64)
    high = (ids >> np.uint64(32)).astype(np.float64)  # each half is exact as a float, whose exponent is its bit length
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.int8)


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, block_offsets) of unsigned ids below 2**60. Every block takes the fullest selector at each step; blocks go in step.

    For each position the longest run that fits each selector is known from the bit widths; the walk from word to word is done for all blocks at once."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    ids, bits = np.asarray(ids, np.uint64), _bit_lengths(ids)
    if bits.max() > 60:
        raise ValueError("an id needs more than 60 bits")
    room = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n)).astype(np.int16)
    choice = np.full(n, 15, np.int8)
    widest, span = bits, 1  # bit length of the widest of the next ``span`` ids
    for s in range(14, -1, -1):
        c, width = int(COUNTS[s]), WIDTHS[s]
        while span * 2 <= min(c, n):
            widest = np.append(np.maximum(widest[:-span], widest[span:]), np.full(span, 64, np.int8))
            span *= 2
        if c <= n:
            fits = np.maximum(widest[: n - c + 1], widest[c - span : n - span + 1]) <= width
            fits &= room[: n - c + 1] >= c
            np.putmask(choice[: n - c + 1], fits, np.int8(s))
    blocks = -(-n // BLOCK)
    at, last = np.arange(blocks) * BLOCK, np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    starts = np.zeros(n, bool)
    while len(at):
        starts[at] = True
        at = at + COUNTS[choice[at]]
        live = at < last
        at, last = at[live], last[live]
    at = np.flatnonzero(starts)
    sel = choice[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        hit = np.flatnonzero(sel == s)
        for k in range(COUNTS[s]) if len(hit) else ():
            words[hit] |= ids[at[hit] + k] << np.uint64(k * WIDTHS[s])
    offsets = np.searchsorted(at, np.append(np.arange(blocks) * BLOCK, n))
    return words, offsets.astype(np.int64)


def decode_ids(words: np.ndarray) -> np.ndarray:
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in range(2, 16):
        hit = np.flatnonzero(sel == s)
        if len(hit):
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            out[(ends[hit] - COUNTS[s])[:, None] + np.arange(COUNTS[s])] = (words[hit][:, None] >> shifts) & mask
    return out


def pack_file(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: header, document ids (with a mark for null ids), tokens per document, block offsets, words; the numbers of documents and ids lead."""
    words, offsets = encode_ids(ids)
    head = MAGIC + struct.pack("<IQQQ", BLOCK, len(doc_ids), len(ids), len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), counts.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, known, counts, block offsets, words) of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    block, docs, ids, n_words = struct.unpack_from("<IQQQ", data, 4)
    at, parts = 32, []
    for kind, n in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", -(-ids // block) + 1), ("<u8", n_words)):
        parts.append(np.frombuffer(data, kind, n, at))
        at += parts[-1].nbytes
    return tuple(parts)


def decode_range(offsets: np.ndarray, words: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a file, decoding only the blocks that hold them."""
    if stop <= start:
        return np.zeros(0, np.uint64)
    a, b = start // BLOCK, (stop - 1) // BLOCK + 1
    return decode_ids(words[offsets[a] : offsets[b]])[start - a * BLOCK : stop - a * BLOCK]


class WordEncoder:
    """Texts without added tokens (their spellings are plain text here) to little-endian u32 ids of a vocabulary whose tokens never reach across white space and never join letters with other characters.

    So each blank-separated piece is encoded by the library once and remembered (the store is emptied when full), and a run of marks after a letter
    apart from its word. New pieces of letters only are one pre-token each: they go to the library as one text, and the end-of-word tokens show where
    each ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.store: dict[str, bytes] = {"": b""}

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        for i in range(0, len(letters), 5_000):
            part = letters[i : i + 5_000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) == len(part):
                data = ids.tobytes()
                self.store.update(zip(part, map(data.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist()))))
        rest = [w for w in words if w not in self.store]
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
            self.store[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        # lower-casing is the vocabulary's own first step; sigma is left to it, whose lower case Python makes depend on the place
        low = pa.array([(t if "\u03a3" in t else t.lower()).replace("\n", " ") for t in texts], pa.large_string())
        split = pc.split_pattern(low, " ")
        coded = split.values.dictionary_encode()  # each distinct word of the batch is looked up once
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        store = self.store
        if len(store) > CACHE_WORDS:
            store.clear()
            store[""] = b""
        # the lower case of U+0130 ends in a mark, which joins what follows
        fresh = set(words).difference(store)
        tails = {w: b for w in fresh if w[-1] in MARKS and (b := w.rstrip(MARKS))[-1:].isalpha() and b[-1] != "\u0130"}
        bare = fresh.difference(tails).union(tails.values(), [w[len(b) :] for w, b in tails.items()]).difference(store)
        self._learn(list(bare))
        store.update({w: store[b] + store[w[len(b) :]] for w, b in tails.items()})
        pieces = list(map(store.__getitem__, words))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.append(0, np.cumsum(n))
        at = np.repeat((np.cumsum(size) - size)[code] - ends[:-1], n)
        at += np.arange(len(at))
        data, cuts = np.frombuffer(b"".join(pieces), "<u4")[at].tobytes(), (4 * ends[split.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class TextEncoder:
    """Texts to the ids of the library's ``encode(text, add_special_tokens=False)`` with its settings as loaded.

    A text that holds one of the vocabulary's added tokens, raw or in lower case, goes to the library whole, which finds them before all other steps; the others
    go through the word store."""

    def __init__(self, path: str):
        self.words = WordEncoder(path)
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(added | {t.lower() for t in added}, key=len, reverse=True)))) if added else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, t in enumerate(texts) if self.added.search(t) or self.added.search(t.lower())] if self.added else []
        if not whole:
            return self.words(texts)
        held = set(whole)
        out = self.words(["" if k in held else t for k, t in enumerate(texts)])
        for k, e in zip(whole, self.tok.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out


_ENCODERS: dict[str, TextEncoder] = {}


def text_encoder(path: str) -> TextEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append ``end_id``, and write the ids in ascending id order; returns the manifest (name, shard, part, docs, ids, bytes).

    Null text is empty and has the end id only; null ids come first; rows that repeat an id follow each other in no stated order. A shard is an id range; its files
    hold about 4 million ids each. Commit as in the WARC writer: temporary names, manifest, rename."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    bounds = range_shards(rows, "id", (F.octet_length("text") + 8).cast("long"), shard_bytes)

    def write(batches):
        store, root = filesystem(folder)
        store.create_dir(root)
        encode, tail = text_encoder(path), struct.pack("<I", end_id)
        open_shard, part, held, size, done = None, 0, [], 0, []

        def close():
            nonlocal held, size, part
            if not held:
                return
            ids = np.frombuffer(b"".join(b for _, b in held), "<u4")
            known = np.array([i is not None for i, _ in held])
            data = pack_file(np.array([i or 0 for i, _ in held], np.int64), known, np.array([len(b) // 4 for _, b in held]), ids)
            temp = f"_temp-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{temp}", compression=None) as f:
                f.write(data)
            done.append((temp, f"shard-{open_shard:06d}-{part:05d}.s8b", open_shard, part, len(held), len(ids), len(data)))
            held, size, part = [], 0, part + 1

        for pdf in batches:
            for i in range(0, len(pdf), 1_000):
                piece = pdf.iloc[i : i + 1_000]
                for key, shard, data in zip(piece["id"], piece["shard"], encode(piece["text"].tolist())):
                    if shard != open_shard or size > 16 << 20:
                        close()
                        if shard != open_shard:
                            open_shard, part = int(shard), 0
                    held.append((None if pd.isna(key) else int(key), data + tail))
                    size += len(data) + 4
        close()
        yield pd.DataFrame(done, columns=["temp", "name", "shard", "part", "docs", "ids", "bytes"])

    schema = "temp string, name string, shard int, part int, docs long, ids long, bytes long"
    sharded(rows, "id", bounds).mapInPandas(write, schema).write.parquet(f"{folder}/_attempts")
    return write_manifest(docs.sparkSession.read.parquet(f"{folder}/_attempts"), folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a committed folder: (doc_id, start, ids binary). ``start`` counts the ids of all documents before it.

    File starts come from a running sum over the manifest (one row per file), so files are read independently."""
    files = spark.read.parquet(f"{folder}/manifest")
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("name", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("first"))
    n = max(1, files.count())

    def read(batches):
        store, root = filesystem(folder)
        for pdf in batches:
            for name, first in zip(pdf["name"], pdf["first"]):
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    doc_ids, known, counts, offsets, words = unpack_file(f.read())
                ends = np.cumsum(counts)
                for a in range(0, len(counts), 2_000):
                    b = min(a + 2_000, len(counts))
                    base = int(ends[a] - counts[a])
                    data = decode_range(offsets, words, base, int(ends[b - 1])).astype("<u4").tobytes()
                    cut = np.append(ends[a:b] - counts[a:b], ends[b - 1]) - base
                    yield pd.DataFrame({"doc_id": pd.array(doc_ids[a:b], "Int64").copy(), "known": known[a:b] > 0, "start": first + ends[a:b] - counts[a:b], "ids": [data[4 * x : 4 * y] for x, y in zip(cut[:-1], cut[1:])]})

    out = files.repartition(n, "name").mapInPandas(read, "doc_id long, known boolean, start long, ids binary")
    return out.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "start", "ids")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op9_token_output": op9_token_output}
ORACLES: dict[str, str] = {}
