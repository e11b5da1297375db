"""Retrieval queries over the evidence view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locatext.functions import lexing as L
from locatext.functions.vocab import LIMITS
from locatext.operators import search as S
from locatext.registry import EV, evidence, query
from locatext.session import table

#: The question of these queries; its terms in order.
QUESTION = "show the token and email of the license under the call"
TERMS = ["token", "email", "license", "under", "call"]
_IN = ", ".join(f"'{t}'" for t in TERMS)
_KEYED = "k AS (SELECT *, CAST(doc_id AS VARCHAR) || ':' || CAST(ord AS VARCHAR) AS evidence_id FROM ev)"
HITS_SQL = f"""WITH {EV}, {_KEYED},
w AS (SELECT evidence_id, doc_id, ord, family, file_name, raw_text, unnest(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS term FROM k),
h AS (SELECT evidence_id, doc_id, ord, family, file_name, raw_text, term, count(*) AS tf FROM w WHERE term IN ({_IN}) GROUP BY ALL),
s AS (SELECT evidence_id, doc_id, ord, family, file_name, raw_text, count(*) AS hits,
  CAST(sum(2 + least(3, tf)) + least(6, count(*)) + CASE WHEN count(*) = {len(TERMS)} THEN 8 ELSE 0 END AS BIGINT) AS score FROM h GROUP BY ALL)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).withColumn("evidence_id", F.concat_ws(":", "doc_id", "ord"))
    found = S.term_counts(rows, "raw_text", TERMS)
    points = sum((F.when(F.col("tf")[i] > 0, S.concept_points(F.lit(t), F.lit(True), F.col("tf")[i])).otherwise(0) for i, t in enumerate(TERMS)), F.lit(0))
    out = found.withColumns({"hits": F.size(F.filter("tf", lambda x: x > 0)).cast("long"), "points": points})
    keys = ["evidence_id", "doc_id", "ord", "family", "file_name", "raw_text"]
    return out.select(*keys, "hits", (F.col("points") + S.coverage_bonus(F.col("hits"), len(TERMS))).cast("long").alias("score"))


_ORDER = [F.desc, "score"], [F.desc, "hits"], [F.asc, "evidence_id"]


def order():
    return [f(c) for f, c in _ORDER]


@query(f"{HITS_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, raw_text ORDER BY score DESC, hits DESC, evidence_id) AS c FROM s) SELECT evidence_id, file_name, hits, score FROM d WHERE c = 1 ORDER BY score DESC, hits DESC, evidence_id LIMIT 8")
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the eight best evidence rows for one question."""
    rows = scored(spark, sf_dir)
    # Rows of equal content score alike: the least id is the best of them.
    best = rows.groupBy("doc_id", F.sha2("raw_text", 256).alias("content"), "file_name", "hits", "score").agg(F.min("evidence_id").alias("evidence_id"))
    return S.rank_rows(best).limit(LIMITS["results"]).select("evidence_id", "file_name", "hits", "score")


_BM25 = f"""WITH {EV},
l AS (SELECT doc_id, ord, len(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS len FROM ev),
g AS (SELECT count(*) AS n_rows, avg(len) AS avg_len FROM l),
w AS (SELECT doc_id, ord, unnest(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS term FROM ev),
h AS (SELECT doc_id, ord, term, count(*) AS tf FROM w WHERE term IN ({_IN}) GROUP BY ALL),
f AS (SELECT term, count(*) AS n_q FROM h GROUP BY term),
i AS (SELECT term, CASE WHEN ln((n_rows - n_q + 0.5) / (n_q + 0.5)) > 0 THEN ln((n_rows - n_q + 0.5) / (n_q + 0.5)) ELSE 1e-6 END AS idf, avg_len FROM f, g),
s AS (SELECT h.doc_id, h.ord, round(-sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM h JOIN i USING (term) JOIN l ON l.doc_id = h.doc_id AND l.ord = h.ord GROUP BY ALL)"""


@query(f"{_BM25} SELECT * FROM s ORDER BY score, doc_id, ord LIMIT 160")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the question; statistics over the whole index, as documented."""
    out = S.bm25(evidence(spark, sf_dir), ["doc_id", "ord"], "raw_text", TERMS).withColumn("score", F.round("score", 6))
    return out.orderBy("score", "doc_id", "ord").limit(LIMITS["candidates"])


@query(f"WITH {EV}, l AS (SELECT family, len(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS len FROM ev) SELECT family, count(*) AS n_rows, round(avg(len), 6) AS avg_len FROM l GROUP BY family")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.corpus_statistics(evidence(spark, sf_dir), "raw_text", ["family"]).withColumn("avg_len", F.round("avg_len", 6))


@query(f"{HITS_SQL}, n AS (SELECT family, evidence_id, score, row_number() OVER (PARTITION BY family ORDER BY score DESC, hits DESC, evidence_id) AS n FROM s) SELECT family, evidence_id, score, n FROM n WHERE n <= 12")
def family_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_per_group(scored(spark, sf_dir), ["family"], order(), LIMITS["family_candidates"]).select("family", "evidence_id", "score", F.col("n").cast("long").alias("n"))


@query(f"{HITS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY file_name, family ORDER BY score DESC, hits DESC, evidence_id) AS nth FROM s) SELECT evidence_id, file_name, nth FROM n ORDER BY (nth > 1), score DESC, hits DESC, evidence_id LIMIT 100")
def diversify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.diversify(scored(spark, sf_dir), ["file_name", "family"], order())
    return rows.orderBy(F.col("nth") > 1, *order()).limit(100).select("evidence_id", "file_name", F.col("nth").cast("long").alias("nth"))


@query(f"{HITS_SQL}, a AS (SELECT evidence_id, doc_id, ord FROM s ORDER BY score DESC, hits DESC, evidence_id LIMIT 8), n AS (SELECT a.evidence_id AS anchor, k.evidence_id AS near, abs(k.ord - a.ord) AS gap, row_number() OVER (PARTITION BY a.evidence_id ORDER BY abs(k.ord - a.ord), k.ord) AS n FROM a JOIN k ON k.doc_id = a.doc_id AND k.ord <> a.ord) SELECT anchor, near, gap, n FROM n WHERE n <= 3")
def nearest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest rows of the page for each of eight anchors (eight rows: broadcast)."""
    anchors = S.rank_rows(scored(spark, sf_dir)).limit(LIMITS["anchors"]).select(F.col("evidence_id").alias("anchor"), F.col("doc_id").alias("d"), F.col("ord").alias("o"))
    rows = evidence(spark, sf_dir).withColumn("near", F.concat_ws(":", "doc_id", "ord"))
    joined = rows.join(F.broadcast(anchors), (F.col("doc_id") == F.col("d")) & (F.col("ord") != F.col("o"))).withColumn("gap", F.abs(F.col("ord") - F.col("o")))
    return S.top_per_group(joined, ["anchor"], [F.asc("gap"), F.asc("ord")], LIMITS["anchor_rows"]).select("anchor", "near", "gap", F.col("n").cast("long").alias("n"))


@query(f"""WITH {EV}, t AS (SELECT doc_id, ord, CAST((ord - 1) // 5 AS BIGINT) AS tab FROM ev), m AS (SELECT DISTINCT doc_id, tab FROM t JOIN ev USING (doc_id, ord) WHERE contains(raw_text, 'token ='))
SELECT t.doc_id, t.tab, count(*) AS siblings, min(t.ord) AS first_ord FROM t JOIN m ON t.doc_id = m.doc_id AND t.tab = m.tab GROUP BY ALL""")
def sibling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same table as a matched row (five lines are one table here)."""
    rows = evidence(spark, sf_dir).withColumn("tab", F.floor((F.col("ord") - 1) / 5))
    matched = rows.where(F.col("raw_text").contains("token =")).select("doc_id", "tab").distinct()
    return rows.join(matched, ["doc_id", "tab"], "left_semi").groupBy("doc_id", "tab").agg(F.count("*").alias("siblings"), F.min("ord").alias("first_ord"))


@query(f"""WITH {EV}, w AS (SELECT doc_id, ord, file_name, unnest(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS term FROM ev),
r AS (SELECT doc_id, file_name, term, least(2, count(*)) AS c FROM w WHERE term IN ({_IN}) GROUP BY doc_id, ord, file_name, term),
b AS (SELECT doc_id, file_name, term, 6 * least(2, sum(c)) AS body FROM r GROUP BY doc_id, file_name, term), p AS (SELECT doc_id, file_name, body + CASE WHEN contains(lower(file_name), term) THEN 12 ELSE 0 END AS pts FROM b)
SELECT doc_id, file_name, CAST(sum(pts) AS BIGINT) AS score FROM p GROUP BY ALL""")
def page_group_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page score: a document is a page, a line a row; body hits capped at two."""
    from locatext.operators.pages import page_scores

    return page_scores(evidence(spark, sf_dir), TERMS)


@query(f"""WITH {EV}, w AS (SELECT doc_id, ord, file_name, unnest(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS term FROM ev),
r AS (SELECT doc_id, file_name, term, least(2, count(*)) AS c FROM w WHERE term IN ({_IN}) GROUP BY doc_id, ord, file_name, term),
b AS (SELECT doc_id, file_name, term, 6 * least(2, sum(c)) AS body FROM r GROUP BY doc_id, file_name, term), p AS (SELECT doc_id, file_name, body + CASE WHEN contains(lower(file_name), term) THEN 12 ELSE 0 END AS pts FROM b),
t AS (SELECT doc_id, file_name, CAST(sum(pts) AS BIGINT) AS score FROM p GROUP BY ALL) SELECT doc_id, file_name, score FROM t WHERE score > 0 ORDER BY score DESC, lower(file_name), doc_id LIMIT 256""")
def page_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from locatext.operators.pages import page_order, page_scores

    return page_order(page_scores(evidence(spark, sf_dir), TERMS)).limit(LIMITS["page_candidates"])


@query(f"{HITS_SQL}, n AS (SELECT doc_id, ord, hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord) AS focus FROM s) SELECT doc_id, ord, hits, focus FROM n")
def row_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    focus = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("hits"), "ord"))
    return scored(spark, sf_dir).select("doc_id", "ord", "hits", focus.cast("long").alias("focus"))


@query(f"""WITH {EV}, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS term FROM ev), t AS (SELECT doc_id, count(*) AS found FROM w WHERE term IN ('token', 'email', 'license') GROUP BY doc_id)
SELECT doc_id, found FROM t WHERE found >= 1""")
def identifier_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the wanted identifiers each scope has (relational division at n = all)."""
    wanted = ["token", "email", "license"]
    return S.postings(evidence(spark, sf_dir), ["doc_id"], "raw_text", wanted).groupBy("doc_id").agg(F.count("*").alias("found"))


@query("""WITH b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{6,}'))) AS atom FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{6,}'))) AS atom FROM documents),
a AS (SELECT b.item_id, b.atom, count(d.doc_id) AS docs FROM b LEFT JOIN d USING (atom) GROUP BY ALL)
SELECT item_id, count(*) AS atoms, count(*) FILTER (WHERE docs > 0) AS found, min(docs) > 0 AS complete FROM a GROUP BY item_id""")
def retrieval_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = lambda: F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{6,}"), F.lit(0)))).alias("atom")
    items = table(spark, sf_dir, "benchmark").select("item_id", atoms())
    docs = table(spark, sf_dir, "documents").select("doc_id", atoms()).groupBy("atom").agg(F.count("*").alias("docs"))
    joined = items.join(docs, "atom", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    return joined.groupBy("item_id").agg(F.count("*").alias("atoms"), F.count_if(F.col("docs") > 0).alias("found"), (F.min("docs") > 0).alias("complete"))


@query(f"""WITH {EV}, b AS (SELECT doc_id, ord, list_sort(list_distinct(regexp_extract_all(raw_text, 'mail[0-9]'))) AS ids FROM ev) SELECT CASE WHEN len(ids) = 0 THEN 'unlabelled' WHEN list_contains(ids, 'mail7') THEN 'named' ELSE 'other only' END AS scope, count(*) AS n FROM b GROUP BY ALL""")
def building_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name the wanted entity or none at all stay in scope."""
    ids = F.array_distinct(F.regexp_extract_all("raw_text", F.lit("mail[0-9]"), F.lit(0)))
    scope = F.when(F.size(ids) == 0, "unlabelled").when(F.arrays_overlap(ids, F.array(F.lit("mail7"))), "named").otherwise("other only")
    return evidence(spark, sf_dir).groupBy(scope.alias("scope")).agg(F.count("*").alias("n"))
