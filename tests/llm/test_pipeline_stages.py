"""The pipeline: every stage on what the one before kept, against the plain operators."""

import corpus_pipeline
import odd
from plumbline.llm.common import table
from test_text_operators import plain_groups


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_by_plain_rules(spark, small):
    docs = table(spark, small, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = corpus_pipeline.known_language(spark, docs, small)
    assert one.columns == docs.columns and len(ids(one)) > 0.95 * len(texts)
    two = corpus_pipeline.good_quality(spark, one, small)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, small, "labels").collect()}
    kept = set(ids(two))
    assert two.columns == docs.columns and kept <= set(ids(one)) and all(i in kept for i in ids(one) if labels.get(i) == 1)
    three = corpus_pipeline.distinct(spark, two, small)
    largest = {}
    for i in kept:
        key = exact_key(texts[i])
        largest[key] = max(i, largest.get(key, -1))
    assert ids(three) == sorted(largest.values())
    four = corpus_pipeline.no_near_copies(spark, three, small)
    groups = plain_groups([(i, texts[i]) for i in ids(three)], 5, 80)
    assert ids(four) == sorted(i for i, (_, root) in groups.items() if i == root)
    five = corpus_pipeline.packed(spark, four, small)
    assert ids(five) == ids(four)


def exact_key(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_run_and_empty_input(spark, small):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "exact dedup", "n-gram Jaccard join", "packing"]
    assert corpus_pipeline.run(spark, small).count() > 0
    docs = odd.documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_stages_take_odd_rows(spark, small):
    docs = odd.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == odd.documents(spark).columns
    corpus_pipeline.packed(spark, docs, small).collect()
