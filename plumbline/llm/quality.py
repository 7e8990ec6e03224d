"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score uses its own features and those of the lines before and after it, and neighbouring labels are tied by
transition weights. Forward-backward gives each line's probability of being good; their mean weighted by line length, after a calibration on the
training documents, is the document's score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, table, text_or_empty
from plumbline.llm.language_id import sample_rows

#: about so many labelled documents fit the model; those of more lines are left out of the fit
TRAIN_DOCS, TRAIN_LINES = 6_000, 256
STEPS, RATE, PENALTY = 200, 0.1, 2e-4
THRESHOLD = 0.3
#: characters of text scored together
CHUNK = 500_000

#: byte classes: 0 other, 1 A-Z, 2 a-z and beyond ASCII, 3 digit, 4 white space, 5 stop or comma, 6 ! or ?, 7 bar, 8 symbol
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
for _chars, _k in ((b" \t\n\r\x0b\x0c", 4), (b".,;:'\"-()", 5), (b"!?", 6), (b"|", 7), (b"#$%&*@^~=+<>_/\\{}[]`", 8)):
    _CLASS[list(_chars)] = _k
FEATURES = 13


@dataclass(frozen=True)
class LineModel:
    """Emission weights (own, previous and next line, bias), 2x2 transition scores, calibration of the document's log-odds."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, bytes of each line, lines of each text). An empty text has one empty line."""
    raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    if not raw:
        return np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.flatnonzero(b == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    doc_ends = np.cumsum([len(r) for r in raw])
    lines = np.diff(np.append(0, np.searchsorted(ends, doc_ends)))
    line_of = np.repeat(np.arange(len(ends)), size + 1)
    n = len(ends)
    c = np.bincount(line_of * 9 + _CLASS[b], minlength=9 * n).reshape(n, 9).astype(np.float64)
    c[:, 4] -= 1  # the line end

    # a hash of every word, and from these how often a word repeats the one before it
    blank = _CLASS[b] == 4
    begin = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    stop = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    word_at = np.cumsum(np.bincount(begin, minlength=len(b))) - 1
    place = (np.arange(len(b)) - begin[np.maximum(word_at, 0)]).astype(np.uint64) if len(begin) else np.zeros(len(b), np.uint64)
    mixed = (b.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
    mixed ^= mixed >> np.uint64(29)
    run = np.append(np.uint64(0), np.cumsum(mixed * np.uint64(0xBF58476D1CE4E5B9)))
    words = run[stop] - run[begin]
    word_line = line_of[begin] if len(begin) else np.zeros(0, np.int64)
    same = np.append(False, (words[1:] == words[:-1]) & (word_line[1:] == word_line[:-1])) if len(words) else np.zeros(0, bool)
    n_words = np.bincount(word_line, minlength=n).astype(np.float64)
    repeats = np.bincount(word_line, weights=same, minlength=n)

    # lines that occur more than once in their text
    line_hash = (run[ends] - run[starts]) * np.uint64(31) + size.astype(np.uint64)
    doc_of = np.repeat(np.arange(len(texts)), lines)
    order = np.lexsort((line_hash, doc_of))
    twin = (line_hash[order][1:] == line_hash[order][:-1]) & (doc_of[order][1:] == doc_of[order][:-1])
    again = np.zeros(n, bool)
    again[order[1:]] |= twin
    again[order[:-1]] |= twin

    total, letters = np.maximum(size, 1), np.maximum(c[:, 1] + c[:, 2], 1)
    share = lambda k, by: np.minimum(1.0, by * c[:, k] / total)
    last = b[np.maximum(ends - 1, 0)]
    features = np.column_stack([
        np.log1p(size) / 5, c[:, 1] / letters, share(3, 3), share(8, 5), share(6, 5), share(7, 10), share(5, 5), share(4, 3),
        repeats / np.maximum(n_words, 1), np.minimum(1.0, (size - c[:, 4]) / np.maximum(n_words, 1) / 12), again & (size > 0), (size > 0) & np.isin(last, list(b".!?")), n_words < 3,
    ]).astype(np.float64)
    return features, size, lines


def with_neighbours(features: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features and a one; zeros beyond a text's ends."""
    n = len(features)
    first = np.zeros(n + 1, bool)
    first[np.append(0, np.cumsum(lines))] = True
    before = np.vstack([np.zeros((1, FEATURES)), features[:-1]]) if n else features
    after = np.vstack([features[1:], np.zeros((1, FEATURES))]) if n else features
    return np.hstack([features, np.where(first[:n, None], 0, before), np.where(first[1:, None], 0, after), np.ones((n, 1))])


def _step(odds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log-odds of the next label given those of this one."""
    return np.logaddexp(odds + moves[1, 1], moves[0, 1]) - np.logaddexp(odds + moves[1, 0], moves[0, 0])


def forward_backward(scores: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (with the line's own score) and backward log-odds (without) of good against bad.

    The texts of a batch go in step, longest first, so the loop is as long as the longest text and each turn is one vector operation."""
    start = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    start, count = start[order], lines[order]
    forward, backward = np.zeros(len(scores)), np.zeros(len(scores))
    longest = int(count[0]) if len(count) else 0
    live = len(count) - np.searchsorted(count[::-1], np.arange(longest), side="right")
    for t in range(longest):
        at = start[: live[t]] + t
        forward[at] = scores[at] + (_step(forward[at - 1], moves) if t else 0)
    for t in range(longest - 2, -1, -1):
        at = start[: live[t + 1]] + t
        backward[at] = _step(scores[at + 1] + backward[at + 1], moves.T)
    return forward, backward


def fit_lines(features: np.ndarray, lines: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores of the chain that make each document's label, given to all its lines, likeliest (Adam).

    Documents weigh alike, whatever their number of lines."""
    x = with_neighbours(features, lines)
    y, weight = np.repeat(good, lines).astype(np.float64), np.repeat(1 / lines, lines)
    head = np.zeros(len(x), bool)
    head[np.cumsum(lines) - lines] = True
    pair = np.flatnonzero(~head)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.array([[((1 - y) * weight)[pair].sum(), 0.0], [0.0, (y * weight)[pair].sum()]])
    for k in range(1, STEPS + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        scores = x @ w
        forward, backward = forward_backward(scores, lines, moves)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
        u, z = forward[pair - 1], scores[pair] + backward[pair]
        logs = np.stack([np.full(len(pair), moves[0, 0]), moves[0, 1] + z, moves[1, 0] + u, moves[1, 1] + u + z])
        expected = (np.exp(logs - np.logaddexp.reduce(logs, axis=0)) * weight[pair]).sum(axis=1).reshape(2, 2)
        grad = np.append(x.T @ ((y - p) * weight), seen - expected) / len(lines) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def document_odds(features: np.ndarray, size: np.ndarray, lines: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of the length-weighted mean probability, bad lines) of each text."""
    if not len(lines):
        return np.zeros(0), np.zeros(0, np.int64)
    forward, backward = forward_backward(with_neighbours(features, lines) @ weights, lines, moves)
    p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
    at = np.cumsum(lines) - lines
    mean = np.add.reduceat(p * (size + 1), at) / np.add.reduceat(size + 1.0, at)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean)), np.add.reduceat((p < 0.5).astype(np.int64), at)


def _calibrate(odds: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and shift of a logistic curve by Newton's method, slightly drawn towards slope 1 and shift 0."""
    a, b = 1.0, 0.0
    x = np.column_stack([odds, np.ones(len(odds))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ (a, b), -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        a, b = np.array([a, b]) + np.linalg.solve(h, x.T @ (good - p) - (a - 1.0, b))
    return max(float(a), 0.0), float(b)


def held_out(id_col: str = "doc_id") -> Column:
    """True for documents that no fit may see; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineModel:
    """Fit on about ``TRAIN_DOCS`` labelled documents that are not held out. Of repeated labels the larger counts; null labels are none.

    The sample is drawn from the labels alone, so it is small by its parameter when it is broadcast to the texts. Without two classes
    the model is flat and its score the smoothed share of good labels."""
    known = labels.filter("quality is not null").filter(~held_out(id_col)).groupBy(id_col).agg((F.max("quality") > 0).alias("_good"))
    picked = sample_rows(known, id_col, TRAIN_DOCS).select(F.col(id_col).alias("_id"), "_good")
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(picked), "_id").select("_text", "_good")

    def take(batches):
        for pdf in batches:
            for _, part in pdf.groupby((pdf["_text"].str.len() + 1).cumsum() // CHUNK, sort=False):
                features, size, lines = line_features(part["_text"].tolist())
                ends = np.cumsum(lines)
                keep = np.flatnonzero(lines <= TRAIN_LINES)
                cut = [slice(ends[i] - lines[i], ends[i]) for i in keep]
                yield pd.DataFrame({"features": [features[c].tobytes() for c in cut], "size": [size[c].tobytes() for c in cut], "good": part["_good"].to_numpy()[keep]})

    got = map_batches(rows, take, "features binary, size binary, good boolean").collect()
    got = sorted(map(tuple, got))  # the fit does not depend on the order of rows
    good = np.array([g for _, _, g in got], bool)
    if len(set(good.tolist())) < 2:
        share = (good.sum() + 1) / (len(good) + 2)
        return LineModel(np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    features = np.frombuffer(b"".join(bytes(f) for f, _, _ in got)).reshape(-1, FEATURES)
    size = np.frombuffer(b"".join(bytes(s) for _, s, _ in got), np.int64)
    lines = np.array([len(s) // 8 for _, s, _ in got])
    weights, moves = fit_lines(features, lines, good)
    return LineModel(weights, moves, *_calibrate(document_odds(features, size, lines, weights, moves)[0], good))


def score(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: (id_col, *extra, score, lines, bad_lines). The score is in [0, 1], higher for good.

    Only the text enters the score; null text counts as empty. Rows are scored apart, so there is no shuffle and order, repetition and other columns
    do not matter."""
    extra = extra or {}
    rows = docs.select(id_col, *[c.alias(k) for k, c in extra.items()], text_or_empty(text_col).alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]

    def run(batches):
        for pdf in batches:
            chunk = (pdf["_text"].str.len() + 1).cumsum() // CHUNK
            for _, part in pdf.groupby(chunk, sort=False):
                features, size, lines = line_features(part["_text"].tolist())
                odds, bad = document_odds(features, size, lines, model.weights, model.moves)
                yield part.drop(columns="_text").assign(score=1 / (1 + np.exp(-np.clip(model.slope * odds + model.shift, -500, 500))), lines=lines, bad_lines=bad)

    return map_batches(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, lines long, bad_lines long")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept; only the rejected are joined back."""
    model = fit(docs, labels)
    scored = score(docs, model, extra={"h": F.xxhash64("text")})
    gone = scored.filter(F.col("score") < threshold).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_h"]), "left_anti")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), extra={"held_out": held_out()})
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "lines", "bad_lines")


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
