"""URL filter: rules first, and for the rest link-graph propagation of trust and distrust over hosts.

Trust is a personalised PageRank from trusted hosts along links; distrust runs from blocked hosts against the links, so
a host that links to blocked hosts inherits distrust. Everything is DataFrame code: no Python on the executors.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.session import cut_lineage

#: (action, host, path); the longest fitting rule decides.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DAMPING = 0.85
#: rounds end when no score grows by more than this share of itself; distrust must exceed trust by more than this share
TOLERANCE, MARGIN = 1e-3, 1e-2
#: rounds between two cuts of lineage; rows of the walks that one task moves
CUT_EVERY, ROWS = 2, 200_000
#: an href value in double, single or no quotes
LINK = r"""(?i)href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and action of the longest rule (host and path together) that fits; null without one.

    A rule fits its host and all subdomains when the path starts with the rule's. Of equally long rules the first listed wins."""
    text = action = None
    for act, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, action)


def parent_of(host: Column) -> Column:
    """The host without its first label while two labels remain, else null."""
    return F.when(F.size(F.split(host, r"\.")) >= 3, F.regexp_extract(host, r"^[^.]*\.(.*)$", 1))


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, summed before the shuffle, and each host with its parent domain both ways.

    ``pages`` has ``host``. Relative links stay on the host and make no edge."""
    links = pages.filter("host <> ''").select("host", F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))).alias("href"))
    links = links.select("host", F.regexp_replace("href", "^[\"']|[\"']$", "").alias("href"))
    target = url_parts(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href")))[0]
    links = links.select(F.col("host").alias("src"), target.alias("dst")).filter("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    own = pages.filter("host <> ''").select("host").distinct().select("host", parent_of(F.col("host")).alias("up")).filter("up is not null")
    tree = own.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.*", F.lit(1).cast("long").alias("n"))
    return links.union(tree).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows``, lineage cut, in as many partitions as their number asks for, at most those they have."""
    rows = cut_lineage(rows)
    return rows.coalesce(-(-rows.count() // ROWS) or 1)


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from ``edges`` (src, dst, n) and ``seeds`` (host, trust, distrust; each sums to 1 or 0).

    Both walks go through the same joins, told apart by ``kind``; distrust uses the reversed edges. What a host
    without outgoing edges holds leaves the walk. A score is the sum of what arrives over walks of 0, 1, 2, ... links, each length weighing ``damping`` times
    the one before. A round moves what arrived last by one equi-join on the source and one sum that is combined before its shuffle. Rounds go on until no host's score
    grew by more than ``tolerance`` of itself, so a host however far from the seeds is reached; as what moves shrinks by ``damping`` or more per round, they end.
    Every other round, lineage is cut and one number comes to the driver. Tasks are as many as the counted edges and scores need, so that a small graph is not
    dealt over the many partitions of its pages, each a file per round; one task needs no shuffle."""
    edges = _dealt(edges)
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("w"))
    steps = _dealt(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.lit(damping) * F.col("n") / F.col("w")).alias("p")))
    start = seeds.unpivot(["host"], ["trust", "distrust"], "kind", "s").filter("s > 0")
    rank = _dealt(start.select("kind", "host", ((1 - damping) * F.col("s")).alias("r"), ((1 - damping) * F.col("s")).alias("last")))
    tasks = max(steps.rdd.getNumPartitions(), rank.rdd.getNumPartitions())
    grown = None if rank.isEmpty() else 1.0
    while grown is not None and grown > tolerance:
        for _ in range(CUT_EVERY):
            moved = rank.filter("last > 0").withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.lit(0.0).alias("r"), (F.col("last") * F.col("p")).alias("last"))
            rank = moved.union(rank.select("kind", "host", "r", F.lit(0.0).alias("last"))).coalesce(tasks).groupBy("kind", "host").agg((F.sum("r") + F.sum("last")).alias("r"), F.sum("last").alias("last"))
        rank = cut_lineage(rank.coalesce(tasks))
        grown = rank.agg(F.max(F.col("last") / F.col("r"))).first()[0]
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(score("trust"), score("distrust"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """One row per page: (id_col, host, path, rule, verdict, trust, distrust).

    The verdict is the longest rule's; where none fits, the host is blocked if its distrust exceeds its trust by more than the share ``MARGIN``, far above what is left of either walk. Every host with allowed (blocked) pages is a
    seed of trust (distrust) in proportion to their number. Hosts out
    of reach of every seed, and pages without a host, are allowed. Other columns of ``pages`` are not read; repeated rows are judged
    alike; an empty table gives no rows; null html has no links."""
    host, path = url_parts(F.col(url_col))
    flat = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    flat = flat.withColumn("rule", rule).withColumn("action", action)
    by_host = _dealt(flat.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("good"), F.count_if(F.col("action") == "block").alias("bad")))
    sums = by_host.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    share = lambda c, s: F.col(c) / F.lit(float(s or 1))
    scores = propagate(host_edges(flat), by_host.select("host", share("good", sums["g"]).alias("trust"), share("bad", sums["b"]).alias("distrust")))
    joined = flat.drop("html").join(scores, "host", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    method = F.when(zero("distrust") > zero("trust") * (1 + MARGIN), "block").otherwise("allow")
    return joined.select(id_col, "host", "path", "rule", F.coalesce("action", method).alias("verdict"), zero("trust").alias("trust"), zero("distrust").alias("distrust"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same walks as a recursive common table expression, 400 rounds of them."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked) + " END"
    action = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, h, p in ranked) + " END"
    low = lambda x: f"translate({x}, '{ascii_uppercase}', '{ascii_lowercase}')"
    host_of = lambda u: low(f"regexp_extract(CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END, '^([^/?#]*)', 1)")
    ctes = [
        "u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"f0 AS (SELECT page_id, html, {low('regexp_extract(rest, ' + chr(39) + '^([^/?#]*)' + chr(39) + ', 1)')} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"f AS (SELECT *, {rule} AS rule, {action} AS action FROM f0)",
        "h AS (SELECT host, count(*) AS n, count(*) FILTER (action = 'allow') AS good, count(*) FILTER (action = 'block') AS bad FROM f WHERE host <> '' GROUP BY host)",
        "s AS (SELECT 'trust' AS kind, host, good / (SELECT CAST(sum(good) AS DOUBLE) FROM h) AS r FROM h WHERE good > 0 UNION ALL SELECT 'distrust', host, bad / (SELECT CAST(sum(bad) AS DOUBLE) FROM h) FROM h WHERE bad > 0)",
        f"l0 AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{LINK.replace(chr(39), chr(39) * 2)}', 1)) AS raw FROM f WHERE host <> '')",
        "lq AS (SELECT src, regexp_replace(raw, '^[\"'']|[\"'']$', '', 'g') AS href FROM l0)",
        "l1 AS (SELECT src, CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END AS u FROM lq)",
        f"l2 AS (SELECT src, {host_of('u')} AS dst FROM l1)",
        "t AS (SELECT host, regexp_extract(host, '^[^.]*\\.(.*)$', 1) AS up FROM h WHERE len(string_split(host, '.')) >= 3)",
        "e0 AS (SELECT src, dst FROM l2 WHERE dst <> '' AND dst <> src UNION ALL SELECT host, up FROM t UNION ALL SELECT up, host FROM t)",
        "e1 AS (SELECT src, dst, count(*) AS n FROM e0 GROUP BY src, dst)",
        "e2 AS (SELECT 'trust' AS kind, src, dst, n FROM e1 UNION ALL SELECT 'distrust', dst, src, n FROM e1)",
        f"e AS MATERIALIZED (SELECT kind, src, dst, {DAMPING} * n / sum(n) OVER (PARTITION BY kind, src) AS p FROM e2)",
        f"r AS (SELECT 0 AS k, kind, host, {1 - DAMPING} * r AS r FROM s UNION ALL SELECT k + 1, kind, host, sum(r) FROM (SELECT r.k, e.kind, e.dst AS host, r.r * e.p AS r FROM r JOIN e ON e.kind = r.kind AND e.src = r.host WHERE r.k < 400) GROUP BY k, kind, host)",
        "z AS (SELECT host, coalesce(sum(r) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(r) FILTER (kind = 'distrust'), 0) AS distrust FROM r GROUP BY host)",
    ]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT page_id, f.host, path, rule, coalesce(action, CASE WHEN distrust > trust * {1 + MARGIN} THEN 'block' ELSE 'allow' END) AS verdict FROM f LEFT JOIN z ON z.host = f.host"


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLES = {"op10_url_filter": _sql()}
