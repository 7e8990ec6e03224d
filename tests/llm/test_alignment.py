"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import odd
import public_tokenizers
import pytest
import sentencepiece
from plumbline.llm import token_alignment
from plumbline.llm.common import table
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {i: t for t, i in a.get_vocab().items()}


def plain(texts, libraries):
    """The contract read literally: byte offsets of whole texts, every pair of overlapping tokens, one count per id pair."""
    a, b, names = libraries
    chars = token_alignment.byte_level()
    links, told = [], []
    for text in texts:
        links.append([])
        told.append((0, 0, 0, ""))
        if not text:
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(chars[c] for c in names[i]) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            continue
        ea, eb = [sum(map(len, ta[: i + 1])) for i in range(len(ta))], [sum(map(len, tb[: i + 1])) for i in range(len(tb))]
        for i, x in enumerate(ia):
            for j, y in enumerate(ib):
                if max(ea[i] - len(ta[i]), eb[j] - len(tb[j])) < min(ea[i], eb[j]):
                    links[-1].append((x, y))
        cuts, groups, last = sorted(set(ea) & set(eb)), [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, e in zip(ia, ea) if last < e <= c) + "|" + ",".join(str(y) for y, e in zip(ib, eb) if last < e <= c))
            last = c
        told[-1] = (len(ia), len(ib), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    counts = Counter(p for ls in links for p in ls)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(na, nb, g, len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for ls, (na, nb, g, sha) in zip(links, told)]


def held(spark, docs):
    found = token_alignment.align_documents(docs, A, B)
    return sorted(map(tuple, found.select("doc_id", *COLUMNS).collect()), key=str)


STRANGE = [" ", "  two  spaces ", "\n", "a\n b", "a \n b\n\n  c", "tab\t x", "  x y", "　漢字 x", "▁ x", "x▁", "<s> </s> <unk> <0x41>", "<|endoftext|> x", "it's  we'll 's", "x" * 300, "naïve ſ ퟿ \U0001f600",
           "\x00 a", "\x1c \x1d b", "  c  ", "é é", "1 2  3   4    5     6", "trailing   ", "a  \n  b", "﻿bom", " lead", "..., !? (x)"]


def test_equals_the_plain_version(spark, small, libraries):
    rng = random.Random(1)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", " ", "é", "漢", "1", "'s", ".", "▁", "Z"]
    texts = [r["text"] for r in table(spark, small, "documents").limit(40).collect() if len(r["text"]) < 3000]
    texts += STRANGE + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(300)] + texts[:10] + [None, "", "only once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert held(spark, docs) == sorted([(i, *p) for i, p in enumerate(plain(texts, libraries))], key=str)


def test_odd_rows(spark, libraries):
    docs = odd.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 10_000]
    assert held(spark, docs.filter("coalesce(length(text), 0) < 10000")) == sorted([(i, *p) for (i, _), p in zip(short, plain([t for _, t in short], libraries))], key=str)
    whole = held(spark, docs)
    assert len(whole) == len(rows)
    assert len({r[1:] for r in whole if r[0] in (6, 7)}) == 1 and all(r[1] > 6_000 for r in whole if r[0] == 6)


def test_empty_table(spark):
    assert held(spark, odd.documents(spark, [])) == []
    assert held(spark, odd.documents(spark, [(1, None, "en", "a"), (2, "", "en", "a")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_counts_passed_on_early_and_many_tasks_of_a_bucket(spark, small, libraries, monkeypatch):
    texts = [r["text"] for r in table(spark, small, "documents").limit(60).collect() if len(r["text"]) < 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = held(spark, docs)
    assert whole == sorted([(i, *p) for i, p in enumerate(plain(texts, libraries))], key=str)
    monkeypatch.setattr(token_alignment, "TASK_BYTES", 500)
    assert held(spark, docs) == whole


def test_packed_pairs_come_back():
    import numpy as np

    keys, places, times = np.array([3, 3, 9, 4_000_000_000]), np.array([0, 5, 1, 1_000_000]), np.array([1, 2, 70_000, 1])
    for x, y in zip(token_alignment.unpack_pairs(token_alignment.pack_pairs(keys, places, times)), (keys, places, times)):
        assert x.tolist() == y.tolist()
