"""Small tables with the awkward cases: nulls in any column, empty and very long texts, ties, repeated rows, columns whose names clash with internal ones."""

from pyspark.sql import types as T

CLASH = ["id", "n", "h", "key", "size", "bucket", "component", "score", "shard", "first", "_id", "_text", "_group", "_gone", "keep_id", "host", "n_tokens"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])

LONG = " ".join(f"word{i} of a very long text, line {i % 97}.\n" for i in range(6_000))
WORDS = "the quick brown fox jumps over the lazy dog and runs away from all the hounds of the old house".split()
NEAR = " ".join(WORDS * 6)
ROWS = [
    (1, "Plain text of a few words.", "en", "a"), (2, "plain TEXT of a few words.", "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, "   \n\t ", "fr", "b"),
    (6, LONG, "en", "hot"), (7, LONG, "en", "hot"), (7, LONG, "en", "hot"), (None, "No id here.", "en", None), (None, None, None, None),
    (8, NEAR, "en", "hot"), (9, NEAR + " tail", "en", "hot"), (10, "head " + NEAR, "en", "hot"), (11, "Ünïcödé ſtraße 漢字 İ Σ", "de", "c"), (12, "a\x1cb\x00c\u2028d", "es", "c"),
    (13, "one", "en", "a"), (14, "one", "en", "a"), (15, "ONE", "fr", "a"), (16, "$$$ ### !!! 123", "xx", "d"), (17, "É", "fr", "a"), (18, "é", "fr", "a"), (19, "x" * 5000, "en", "a"), (20, "x" * 5000 + "y", "en", "a"),
]


def documents(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), *[f"{c}{i}" for c in CLASH]) for i, r in enumerate(rows)], DOCS)


def pages(spark):
    rows = [
        (1, "http://Shop.Example.com/a?b", '<html lang="en"><a href="http://www.example.com/en/1">x</a>'), (2, "https://www.example.com/en/1", "<p>same</p>"), (3, "https://example.com/en/2#x", "<p>same</p>"),
        (4, None, None), (5, "no scheme/at/all", ""), (6, "http://bad.example.net/es/1", "<a HREF = \"//friend.example.org/q\">"), (6, "http://bad.example.net/es/1", "<a HREF = \"//friend.example.org/q\">"), (None, "http://x.org", "<p>same</p>"),
        (7, "http://friend.example.org/q", '<a href="https://bad.example.net/es/9">'), (8, "http://solo.org?x", "h" * 200_000), (9, "http://net/fr/", None), (10, "a://b://c/d?e#f", "é" * 100),
    ]
    return spark.createDataFrame([(*r, *[f"{c}{i}" for c in CLASH]) for i, r in enumerate(rows)], PAGES)
