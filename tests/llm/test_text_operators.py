"""Language ID, quality, byte BPE and the Jaccard join against libraries, plain versions and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import odd
from plumbline.llm import byte_bpe, language_id, ngram_join, quality
from plumbline.llm.common import components, table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


# language ID


@pytest.fixture(scope="module")
def judged(spark, small):
    rows = entry_point.queries()["op1_language_id"](spark, small).collect()
    return {("doc", r["doc_id"]) if r["page_id"] is None else ("page", r["page_id"]): r for r in rows}


def test_languages_of_the_documents(spark, small, judged):
    docs = {r["doc_id"]: r["lang"] for r in table(spark, small, "documents").collect()}
    assert np.mean([judged["doc", i]["lang"] == lang for i, lang in docs.items()]) > 0.97
    assert np.mean([judged["doc", i]["accepted"] for i in docs]) > 0.97


def test_every_page_and_document_is_judged(spark, small, judged):
    assert len(judged) == table(spark, small, "documents").count() + table(spark, small, "pages").count()


def model_of(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog are on the hill", "en"), ("le chat et le chien sont sur la colline", "fr")] * 20)]
    return language_id.fit_text_model(spark.createDataFrame(rows, "id long, text string, label string"))


def test_rare_labels_are_drawn_in_full(spark):
    rows = spark.range(20_000).selectExpr("id", "concat(if(id % 2000 = 0, 'zz ', 'aa '), id) as text", "if(id % 2000 = 0, 'rare', 'common') as label")
    got = Counter(r["column"] for r in language_id.training_rows(rows, 100, 5).select("column").collect())
    assert got["rare"] == 10 and 50 < got["common"] < 160
    assert language_id.fit_text_model(rows, bound=100).languages == ("common", "rare", "und")


def test_languages_beyond_the_columns_stay(spark):
    r = random.Random(3)
    words = {f"l{k:02d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang, None) for i, lang in enumerate(sorted(words) * 4)]
    d = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    for most in (language_id.LANGUAGES, 20):
        model = language_id.fit_text_model(d.withColumnRenamed("declared", "label"), most=most)
        assert len(model.languages) == (71 if most > 70 else 22)
        got = {r["id"]: r for r in language_id.fuse(d, model).collect()}
        assert all(got[i]["accepted"] and got[i]["lang"] == lang for i, _, lang, _ in rows)


def test_fusion_by_hand(spark):
    model = model_of(spark)
    rows = [(1, "the dog and the cat", "en", "a.org"), (2, "le chien et le chat", None, "a.org"), (3, "", "fr", "b.fr"), (4, None, None, None), (5, "### 123", "en", "a.org"), (6, "the hill", "fr", "b.fr"), (6, "the hill", "fr", "b.fr")]
    d = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    got = Counter()
    answers = {}
    for r in language_id.fuse(d, model).collect():
        got[r["id"]] += 1
        assert answers.setdefault(r["id"], (r["lang"], r["accepted"])) == (r["lang"], r["accepted"])
    assert got == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2})
    assert answers[1] == ("en", True) and answers[2] == ("fr", True)
    assert not answers[3][1] and not answers[4][1] and not answers[5][1]  # no letters

    # the posterior, in plain numpy
    langs, texts = model.languages, [r[1] or "" for r in rows]
    ll = language_id.text_evidence(model, texts)
    q = np.exp(ll - ll.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    whole = q.sum(0) + 1
    whole /= whole.sum()
    host, declared = [r[3] or "" for r in rows], [r[2] or "" for r in rows]

    def shares(values, parent):
        out = {}
        for v in set(values) - {""}:
            c = q[[i for i, x in enumerate(values) if x == v]].sum(0) + 10 * parent(v)
            out[v] = c / c.sum()
        return out

    domain = shares(host, lambda v: whole)
    hosts = shares(host, lambda v: domain[v])

    def likelihood(values):
        keys = sorted(set(values) - {""})
        sums = {v: q[[i for i, x in enumerate(values) if x == v]].sum(0) for v in keys}
        total = sum(sums.values())
        return {v: np.log((sums[v] + 1) / (total + len(keys))) for v in keys}

    suffix_of = [h.split(".")[-1] if "." in h else "" for h in host]
    by_suffix, by_declared = likelihood(suffix_of), likelihood(declared)
    want = {}
    for i, r in enumerate(rows):
        z = np.log(hosts.get(host[i], whole)) + by_suffix.get(suffix_of[i], 0) + by_declared.get(declared[i], 0) + ll[i]
        p = np.exp(z - z.max())
        want[r[0]] = (langs[int(np.argmax(p))], float(p.max() / p.sum()))
    for r in language_id.fuse(d, model).collect():
        assert r["lang"] == want[r["id"]][0] and abs(r["posterior"] - want[r["id"]][1]) < 1e-9


def test_markup(spark):
    html = '<!doctype html><HTML class=x lang="fr-CA"><script>var en = "<p>";</script><p>bon&amp;jour</p><!-- hello --></html>'
    r = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(language_id.markup_language(F.col("html")).alias("l"), language_id.visible_text(F.col("html")).alias("t")).collect()
    assert r[0]["l"] == "fr" and r[0]["t"].split() == ["bon", "jour"] and r[1]["l"] == r[2]["l"] == "" and r[1]["t"] == ""


def test_accepted_documents_keep_columns(spark):
    docs = odd.documents(spark)
    kept = language_id.accepted_documents(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(7) == 2 and not {3, 4, 5, 16} & set(ids) and {1, 2, 6} <= set(ids)
    assert language_id.accepted_documents(docs.limit(0)).count() == 0


# quality


def test_chain_by_enumeration():
    rng = np.random.default_rng(2)
    lines, moves = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    scores = rng.normal(size=8)
    f, b = quality.forward_backward(scores, lines, moves)
    got = 1 / (1 + np.exp(-(f + b)))
    at = 0
    for n in lines:
        weight, good = 0.0, np.zeros(n)
        for k in range(2**n):
            y = [(k >> i) & 1 for i in range(n)]
            w = np.exp(sum(s for s, v in zip(scores[at : at + n], y) if v) + sum(moves[a, c] for a, c in zip(y, y[1:])))
            weight += w
            good += w * np.array(y)
        assert np.allclose(got[at : at + n], good / weight)
        at += n


def test_features_of_lines():
    f, size, lines = quality.line_features(["", "a b\nTHE THE THE!\nsame\nsame", "é"])
    assert lines.tolist() == [1, 4, 1] and size.tolist() == [0, 3, 12, 4, 4, 2]
    assert f[2, 8] == pytest.approx(1 / 3) and f[3, 10] == f[4, 10] == 1 and f[1, 10] == 0
    assert quality.line_features([])[0].shape == (0, quality.FEATURES)


def test_held_out_accuracy(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    rows = entry_point.queries()["op2_quality"](spark, folder).join(table(spark, folder, "labels"), "doc_id").collect()
    away = [r for r in rows if r["held_out"]]
    assert len(away) > 30 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in away]) > 0.93


def test_quality_of_odd_rows(spark):
    docs = odd.documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (16, 0, 0), (16, None, 1), (None, 1, 0), (11, 1, 0), (12, 0, 0), (8, 1, 0), (99, 0, 0)], odd.LABELS)
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd.ROWS) and all(0 <= r["score"] <= 1 for r in got)
    flat = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r["score"] for r in flat} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns


# byte BPE


@pytest.fixture(scope="module")
def bpe():
    enc = byte_bpe.Encoder(PATH)
    return enc, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_equal_the_library(bpe):
    enc, library = bpe
    r = random.Random(1)
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    letters = blanks + list("abcXYZéñß漢字'sdm.,!?0123<|endoftext|>") + [" "] * 20 + ["́", "​", "\U0001f600", "'s", "'ll", "\x1c"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)] + [x[1] or "" for x in odd.ROWS]
    texts += ["a" * 3000, "ab" * 2000, "".join(r.choice("abcde") for _ in range(9000)), "<|endoftext|>", "it's  we'll\n\n\tok "]
    for text, got in zip(texts, enc.encode(texts)):
        assert ids_of(got) == library.encode_ordinary(text), text
        assert enc.decode(np.frombuffer(got, "<u4")) == text.encode()


def test_merging_one_at_a_time_agrees(bpe):
    pieces = [w.encode() for w in ("aaaaaaa", "thandthandthand", "ünïcödé", "zzzzzz", "x", "")]
    for a, b in zip(bpe[0].merger.merge(pieces), bpe[0].merger._run(pieces, True)):
        assert a == b


def test_bpe_query(spark, small, bpe):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    rows = entry_point.queries()["op5_byte_bpe"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = bpe[1].encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_bpe_of_odd_rows(spark):
    docs = odd.documents(spark)
    got = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, PATH), PATH).collect()
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == Counter((r[0], r[1] or "") for r in odd.ROWS)
    assert byte_bpe.encode_texts(docs.limit(0), PATH).count() == 0


# Jaccard join


def plain_groups(rows, width, percent):
    """Every pair by sets of word tuples."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, set()).add(t or "")
    sets = {}
    for i, ts in texts.items():
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in "\n".join(sorted(ts)))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near(spark, rows, width, percent):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(d, width=width, percent=percent).collect()}


def test_join_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entry_point.queries()["op4_ngram_join"](spark, small).collect()}
    assert got == plain_groups(rows, 4, 85)


@pytest.mark.parametrize("width,percent", [(1, 80), (3, 85)])
def test_join_of_edited_copies(spark, width, percent):
    r = random.Random(width)
    words = [f"w{i}" for i in range(60)]
    rows, base = [], []
    for k in range(12):
        base = [r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 7, 20, 40, 90]))]
        for _ in range(12):
            text = list(base)
            for _ in range(r.randint(0, 6)):
                if text:
                    text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows), " ".join(text)))
            base = text if r.random() < 0.5 else base  # chains that drift
    shared = " ".join(words)
    rows += [(len(rows) + k, shared + " " + " ".join(r.choice(words) + str(k) for _ in range(r.randint(5, 90)))) for k in range(60)]  # a passage many share
    assert near(spark, rows, width, percent) == plain_groups(rows, width, percent)


def test_join_of_odd_rows(spark):
    got = Counter(map(tuple, ngram_join.near_groups(odd.documents(spark)).collect()))
    plain = plain_groups([(r[0], r[1]) for r in odd.ROWS], 5, 80)
    assert got == Counter((i, *plain[i]) if i is not None else (None, 0, None) for i, *_ in odd.ROWS)
    assert near(spark, [(1, "a b c"), (1, "d e f"), (2, "a b c\nd e f")], 2, 80)[2] == (5, 1)
    kept = ngram_join.one_of_each(odd.documents(spark))
    assert kept.columns == odd.documents(spark).columns and {6, 8} <= {r["doc_id"] for r in kept.collect()} and not {7, 9, 10} & {r["doc_id"] for r in kept.collect()}
    assert ngram_join.near_groups(odd.documents(spark).limit(0)).count() == 0


def test_keys_meet_for_all_linked_sets():
    rng = np.random.default_rng(3)
    for percent in (80, 85, 95):
        maker = ngram_join.Keys(percent)
        for n in [1, 2, 5, 6, 7, 9, 13, 30, 100, 400]:
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
                b = a[rng.random(len(a)) < rng.choice([0.8, 0.9, 0.97])]
                b = np.unique(np.append(b, rng.integers(0, 1 << 63, rng.integers(0, 2 + n // 12)).astype(np.uint64)))
                both = len(np.intersect1d(a, b))
                if both and 100 * both >= percent * (len(a) + len(b) - both):
                    assert set(maker.of(a).tolist()) & set(maker.of(b).tolist()), (n, percent)
                x, y = ngram_join.sketch(a), ngram_join.sketch(b)
                while len(x) != len(y):
                    x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
                assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both


def test_walk_counts_overlaps():
    rng = np.random.default_rng(4)
    paths = sorted((np.unique(rng.integers(0, 400, 200)).astype(np.uint64) for _ in range(30)), key=lambda p: p.tolist())
    query = paths[11]
    for whole in (True, False):
        walk = ngram_join.Walk(query, 60)
        for p in paths:
            both = len(np.intersect1d(p, query))
            linked, got = walk.meet(p, whole)
            assert linked == (100 * both >= 60 * (len(p) + len(query) - both)) and (not whole or got == both)


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(200 + k, 201 + k) for k in range(30)] + [(None, 3), (5, 5)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}
