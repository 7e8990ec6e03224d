"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte pieces. A bucket per merge rank holds the list positions whose pair has that rank; a three-level
bitmap marks the buckets in use, and find-first-set on it yields the next rank. A position whose pair has changed since it was queued is stale and skipped. A
push or pop touches three machine words, however long the pre-token is.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cached_property

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, table, text_or_empty

#: pieces and pre-tokens whose ids a worker keeps; emptied when full
CACHE_PIECES = 150_000
#: characters of text that are encoded together
CHUNK = 4_000_000
#: two white-space characters in a row, or white space other than blanks at a piece's edge: such texts are split by the pattern as a whole
_RUN = re.compile(r"\s\s|^\s|\s$")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f))}


class Merger:
    """Merges of one vocabulary, for many pre-tokens at once.

    All pre-tokens of a call share one linked list (no links across their ends) and one queue. They do not touch each other, and the lowest rank in the queue is
    the lowest of every pre-token that has it, so popping ranks from one queue merges each pre-token as if it were alone.
    The bitmap has a bit per rank in ``low``, one per word of ``low`` in ``mid``, one per word of ``mid`` in ``top``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.top_rank = max(ranks.values())

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 without one."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian u32 ids of each pre-token: the pair of lowest rank is merged first, the leftmost of equal ranks first.

        All positions of a popped rank are merged together. That is the order of one at a time unless such a merge makes a pair of lower rank while the
        same pre-token has other positions in the bucket; these pre-tokens, if any, are merged again with one position a time."""
        return self._run(pieces, False)

    def _run(self, pieces: list[bytes], single_step: bool) -> list[bytes]:
        size = np.array([len(p) for p in pieces], np.int64)
        n = int(size.sum())
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(pieces)), size)
        tok = np.append(self.single[np.frombuffer(b"".join(pieces), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        full = size > 0
        after[ends[full] - 1] = n
        before[(ends - size)[full]] = n
        rank = np.append(self.rank_of(tok[:n], tok[np.minimum(after[:n], n)]), -1)
        rank[after == n] = -1
        low, mid, top = [0] * ((self.top_rank >> 6) + 1), [0] * ((self.top_rank >> 12) + 1), 0
        bucket: dict[int, list[np.ndarray]] = {}
        again = np.zeros(len(pieces), bool)

        def push(at: np.ndarray) -> None:
            """Queue positions under their current rank."""
            nonlocal top
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            starts = [0, *cuts.tolist(), len(r)]
            for x, y in zip(starts, starts[1:]):
                q = int(r[x])
                held = bucket.get(q)
                if held is not None:
                    held.append(at[x:y])
                    continue
                bucket[q] = [at[x:y]]
                leaf = q >> 6
                if not low[leaf]:
                    node = leaf >> 6
                    if not mid[node]:
                        top |= 1 << node
                    mid[node] |= 1 << (leaf & 63)
                low[leaf] |= 1 << (q & 63)

        first = np.flatnonzero(rank >= 0)
        if len(first):
            push(first)
        while top:
            node = (top & -top).bit_length() - 1
            words = mid[node]
            leaf = node << 6 | ((words & -words).bit_length() - 1)
            bits = low[leaf]
            r = leaf << 6 | ((bits & -bits).bit_length() - 1)
            low[leaf] = bits = bits & (bits - 1)
            if not bits:
                mid[node] = words = words & (words - 1)
                if not words:
                    top &= top - 1
            held = bucket.pop(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[rank[at] == r]  # the others are stale
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.append(True, at[1:] != at[:-1])]
                if single_step:
                    later = np.append(False, owner[at[1:]] == owner[at[:-1]])
                    wait, at = at[later], at[~later]
                    if len(wait):
                        push(wait)
                else:
                    touching = np.append(False, after[at[:-1]] == at[1:])
                    if touching.any():  # of a run of pairs that overlap, every other one
                        index = np.arange(len(at))
                        at = at[(index - np.maximum.accumulate(np.where(touching, 0, index))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            tok[at], tok[gone], rank[gone] = r, -1, -1
            after[at] = right
            inside = right < n
            before[right[inside]] = at[inside]
            left = before[at]
            rank[at] = np.where(inside, self.rank_of(tok[at], tok[right]), -1)
            left = left[left < n]
            rank[left] = self.rank_of(tok[left], tok[after[left]])
            fresh = np.concatenate([at, left])
            fresh = fresh[rank[fresh] >= 0]
            if len(fresh):
                if not single_step:
                    under = fresh[rank[fresh] < r]
                    if len(under):
                        again[owner[under]] = True
                push(fresh)
        tok, owner = tok[:n], owner[tok[:n] >= 0]
        flat, cuts = tok[tok >= 0].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        out = [flat[a:b] for a, b in zip([0, *cuts], cuts)]
        if again.any():
            which = np.flatnonzero(again).tolist()
            for i, ids in zip(which, self._run([pieces[i] for i in which], True)):
                out[i] = ids
        return out


class Encoder:
    """Text to ids, one pattern match at a time; repeated matches are encoded once."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        #: ids by word after a blank, and by match
        self.words: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        width = max(self.tokens) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(width)], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(width)), np.uint8)

    @cached_property
    def merger(self) -> Merger:
        return Merger(self.ranks)

    def _learn(self, matches: set[str]) -> None:
        """Ids of new matches of the pattern: a match that is a token as it is, or all others in one call of the merger."""
        if len(self.matches) > CACHE_PIECES:
            self.matches.clear()
        new = [m for m in matches if m not in self.matches]
        pieces = [m.encode("utf-8", "surrogatepass") for m in new]
        whole = [self.ranks.get(p) for p in pieces]
        self.matches.update({m: array("I", (r,)).tobytes() for m, r in zip(new, whole) if r is not None})
        rest = [(m, p) for m, p, r in zip(new, pieces, whole) if r is None]
        for (m, _), ids in zip(rest, self.merger.merge([p for _, p in rest])):
            self.matches[m] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian u32 ids of each text. A blank between two non-blanks always opens a match of the pattern, so texts whose white space stands alone are cut there
        and the pieces looked up; other texts are matched as a whole."""
        find = self.pattern.findall
        plain = [not _RUN.search(t) for t in texts]
        split = [t.split(" ") if p else find(t) for t, p in zip(texts, plain)]
        if len(self.words) > CACHE_PIECES:
            self.words.clear()
        heads = [find(s[0]) if p else s for s, p in zip(split, plain)]
        fresh = set().union(*[s[1:] for s, p in zip(split, plain) if p]).difference(self.words)
        fresh = list(fresh)
        flat = find(" " + " ".join(fresh)) if fresh else []  # a match that opens with a blank opens the next word
        opens = [k for k, m in enumerate(flat) if m[0] == " "] + [len(flat)]
        self._learn(set().union(flat, *heads))
        match, word = self.matches.__getitem__, self.words.__getitem__
        self.words.update({w: b"".join(map(match, flat[a:b])) for w, a, b in zip(fresh, opens, opens[1:])})
        return [b"".join(map(match, h)) + (b"".join(map(word, s[1:])) if p else b"") for h, s, p in zip(heads, split, plain)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: one gather over the token table."""
        ids = ids.astype(np.int64)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.arange(total) + np.repeat(self.starts[ids] - (ends - size), size)].tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, ids binary of little-endian u32). Null text gives no ids; special-token strings are ordinary text.
    Rows are independent: no shuffle."""

    def run(batches):
        enc = encoder(path)
        for pdf in batches:
            chunk = (pdf["_text"].str.len() + 1).cumsum() // CHUNK
            for _, part in pdf.groupby(chunk, sort=False):
                yield pd.DataFrame({id_col: part[id_col], "ids": enc.encode(part["_text"].tolist())})

    rows = docs.select(id_col, text_or_empty(text_col).alias("_text"))
    return map_batches(rows, run, f"{id_col} {dict(rows.dtypes)[id_col]}, ids binary")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, decoded binary) from the ids of ``encode_texts``."""

    def run(batches):
        enc = encoder(path)
        for pdf in batches:
            yield pdf.assign(decoded=[enc.decode(np.frombuffer(b, "<u4")) for b in pdf["ids"]])

    return map_batches(encoded, run, f"{id_col} {dict(encoded.dtypes)[id_col]}, ids binary, decoded binary")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
