"""Queries over project rows: eligibility, scopes, quantities, identities and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.operators import projects as P
from locatext.operators import search as S
from locatext.registry import EV, evidence, query
from locatext.session import table

_SECTIONS = ["EMAIL > Headers", "EMAIL > QUOTED HISTORY > 2", "Submittal 4 > STATUS: REJECTED", "RFI 42 > QUESTION", "RFI 42 > RESPONSE > STATUS: CLOSED", "Section 03 30 00 > Part 2", "Submittal 5 > Status: Approved"]
_REASONS = ["EMAIL_HEADER", "EMAIL_QUOTED_HISTORY", "REJECTED_SUBMITTAL", "RFI_QUESTION", None, None, None]


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(f"SELECT event_id, r AS reason, r IS NULL AS kept FROM (SELECT event_id, ({_sql_list(_REASONS)})[CAST(event_id % 7 AS INTEGER) + 1] AS r FROM events)")
def eligible_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", _pick(_SECTIONS, F.col("event_id") % 7).alias("section"))
    return rows.select("event_id", P.ineligible(F.col("section")).alias("reason")).withColumn("kept", F.col("reason").isNull())


#: category, action, object, allowed.
_ATOMS = [("TEST", "Hydrostatic test", "piping", True), ("TEST", "Provide", "test of piping", False), ("REPORT", "Submit", "the inspection report", True), ("REPORT", "Submit", "a certified cost report", False), ("INSPECTION", "Inspect", "Shop drawings", False), ("OTHER", "Verify", "alignment of shafts", True), ("OTHER", "Provide", "anchor bolts", False)]


@query(f"SELECT p_partkey, ({[a[3] for a in _ATOMS]})[CAST(p_partkey % 7 AS INTEGER) + 1] AS allowed FROM part".replace("True", "true").replace("False", "false"))
def inspection_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    parts = [_pick([a[i] for a in _ATOMS], k) for i in range(3)]
    return table(spark, sf_dir, "part").select("p_partkey", P.inspection_allowed(parts[0], parts[1], F.lit("contractor"), parts[2]).alias("allowed"))


@query("""WITH r AS (SELECT l_partkey AS g, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_shipdate END AS d, CASE WHEN l_linenumber = 4 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 3 END AS v, CASE WHEN l_suppkey % 2 = 0 THEN 'ea' END AS u FROM lineitem),
m AS (SELECT *, max(d) OVER (PARTITION BY g) AS latest FROM r),
s AS (SELECT g, count(*) AS n, count(v) AS given, count(*) FILTER (WHERE d IS NULL) AS undated, count(*) FILTER (WHERE d = latest AND v IS NULL) AS bare, count(DISTINCT CASE WHEN v IS NOT NULL THEN v || '|' || coalesce(u, '') END) AS kinds, min(CASE WHEN v IS NOT NULL THEN v || '|' || coalesce(u, '') END) AS one, count(DISTINCT CASE WHEN d = latest AND v IS NOT NULL THEN v || '|' || coalesce(u, '') END) AS last_kinds, min(CASE WHEN d = latest AND v IS NOT NULL THEN v || '|' || coalesce(u, '') END) AS last_one FROM m GROUP BY g),
c AS (SELECT *, CASE WHEN kinds = 1 AND (n = 1 OR undated = 0 AND bare = 0) THEN one WHEN (n = 1 OR undated = 0 AND bare = 0) AND last_kinds = 1 THEN last_one END AS pick FROM s)
SELECT g, CASE WHEN given = 0 THEN 'NONE' WHEN pick IS NULL THEN 'UNRESOLVED' ELSE 'SELECTED' END AS status, CAST(string_split(pick, '|')[1] AS BIGINT) AS value, nullif(string_split(pick, '|')[2], '') AS unit FROM c""")
def merged_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of one thing across revisions."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("g"), F.when(F.col("l_orderkey") % 17 != 0, F.col("l_shipdate")).alias("day"),
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity").cast("long") % 3).alias("value"), F.when(F.col("l_suppkey") % 2 == 0, "ea").alias("unit"),
    )
    return P.merge_quantities(rows, "g")


@query("SELECT event_id AS row_id, 'P' || user_id % 3 AS project_id, CASE WHEN event_id % 10 <> 0 THEN 'S1' END AS snapshot_id FROM events WHERE user_id % 3 <> 1 OR event_id % 10 = 0")
def scope_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a foreign project or snapshot; ``projects.guarded`` fails on the first."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.concat(F.lit("P"), F.col("user_id") % 3).alias("project_id"), F.when(F.col("event_id") % 10 != 0, "S1").alias("snapshot_id"))
    return P.scope_violations(rows, "P1", "S1")


@query("""WITH r AS (SELECT event_id AS row_id, user_id, event_type, CASE WHEN event_id % 3 > 0 THEN event_id % 5 END AS sheet, value FROM events),
h AS (SELECT user_id, sheet FROM r WHERE value > 90 AND sheet IS NOT NULL GROUP BY ALL HAVING count(DISTINCT event_type) <= 1)
SELECT user_id, sheet, row_id FROM r WHERE (user_id, sheet) IN (SELECT user_id, sheet FROM h)""")
def expanded_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the exact scopes of the hits, unless the hits of a scope contradict."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "user_id", F.col("event_type").alias("label"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 5).alias("sheet"), "value")
    return P.expand_scope(rows, rows.where("value > 90"), ["user_id", "sheet"], "row_id")


@query("""WITH p AS (SELECT DISTINCT user_id, event_id % 12 AS page FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND event_id % 50 = 7),
n AS (SELECT e.user_id, e.event_id % 12 AS page, e.event_id, row_number() OVER (PARTITION BY e.user_id, e.event_id % 12 ORDER BY e.event_id) AS place FROM events e JOIN p ON p.user_id = e.user_id AND p.page = e.event_id % 12)
SELECT user_id, page, event_id, place FROM n WHERE place <= 40""")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages of the exact sheets that a question names, 40 rows a page at most."""
    e = table(spark, sf_dir, "events").withColumn("page", F.col("event_id") % 12)
    kind = e.agg(F.min("event_type").alias("kind"))
    wanted = e.where("event_id % 50 = 7").join(F.broadcast(kind), F.col("event_type") == F.col("kind"), "left_semi").select("user_id", "page").distinct()
    rows = e.join(wanted, ["user_id", "page"], "left_semi").select("user_id", "page", "event_id")
    return S.top_per_group(rows, ["user_id", "page"], [F.asc("event_id")], 40, "place")


@query("""WITH a AS (SELECT item_id AS ordinal, md5(text) AS k, text AS q FROM benchmark), b AS (SELECT item_id AS ordinal, md5(CASE WHEN item_id % 9 = 0 THEN upper(text) ELSE text END) AS k, CASE WHEN item_id % 9 = 0 THEN upper(text) ELSE text END AS q FROM benchmark WHERE item_id % 13 <> 5)
SELECT coalesce(a.ordinal, b.ordinal) AS ordinal, CASE WHEN b.ordinal IS NULL THEN 'MISSING' WHEN a.ordinal IS NULL THEN 'ADDED' WHEN a.k <> b.k OR a.q <> b.q THEN 'CHANGED' ELSE 'SAME' END AS state FROM a FULL JOIN b ON a.ordinal = b.ordinal""")
def frozen_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frozen question lists by position: every question must be the same on both."""
    items = table(spark, sf_dir, "benchmark")
    a = items.select(F.col("item_id").alias("ordinal"), F.md5("text").alias("k"), F.col("text").alias("q"))
    said = F.when(F.col("item_id") % 9 == 0, F.upper("text")).otherwise(F.col("text"))
    b = items.where("item_id % 13 <> 5").select(F.col("item_id").alias("ordinal"), F.md5(said).alias("k2"), said.alias("q2"))
    state = F.when(F.col("k2").isNull(), "MISSING").when(F.col("k").isNull(), "ADDED").when((F.col("k") != F.col("k2")) | (F.col("q") != F.col("q2")), "CHANGED").otherwise("SAME")
    return a.join(b, "ordinal", "full").select("ordinal", state.alias("state"))


@query("SELECT o_custkey AS case_id, o_orderkey AS link, 'RUN' AS scope FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT s_nationkey, s_suppkey, 'EVALUATION' FROM supplier UNION ALL SELECT c_nationkey, c_custkey, 'FOLLOW_UP' FROM customer WHERE c_acctbal < 0")
def scoped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cases from three tables, each with its scope."""
    of = lambda name, case, link, scope, where="true": table(spark, sf_dir, name).where(where).select(F.col(case).cast("long").alias("case_id"), F.col(link).cast("long").alias("link"), F.lit(scope).alias("scope"))
    return of("orders", "o_custkey", "o_orderkey", "RUN", "o_orderstatus = 'F'").unionByName(of("supplier", "s_nationkey", "s_suppkey", "EVALUATION")).unionByName(of("customer", "c_nationkey", "c_custkey", "FOLLOW_UP", "c_acctbal < 0"))


@query("""WITH r AS (SELECT user_id, event_id % 4 AS page, event_id, 'E' || event_id AS ref, CASE WHEN event_id % 3 = 0 THEN event_type END AS section FROM events),
a AS (SELECT user_id, page, list(ref ORDER BY event_id, ref) AS refs FROM r GROUP BY ALL),
b AS (SELECT user_id, page, section, min(event_id) AS o, string_agg(ref, ',' ORDER BY event_id, ref) AS s FROM r WHERE section IS NOT NULL GROUP BY ALL),
c AS (SELECT user_id, page, list(section || '=' || s ORDER BY o, section) AS scopes FROM b GROUP BY ALL)
SELECT user_id AS document_id, 'f' || user_id AS file_name, page, refs, scopes FROM a LEFT JOIN c USING (user_id, page)""")
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by document and page in source order, with those of every section."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.concat(F.lit("f"), F.col("user_id")).alias("file_name"), (F.col("event_id") % 4).alias("page"), F.col("event_id").alias("source_order"), F.concat(F.lit("E"), F.col("event_id")).alias("ref"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("section"))
    return P.source_groups(rows)


@query("""WITH now AS (SELECT user_id, count(*) AS version FROM events GROUP BY user_id), ask AS (SELECT event_id, user_id, CAST(event_id % 40 AS BIGINT) AS expected FROM events WHERE event_id % 5 = 0)
SELECT event_id, expected, version, CASE WHEN version IS NULL THEN 'UNKNOWN' WHEN version = expected THEN 'APPLIED' ELSE 'REFUSED' END AS outcome FROM ask LEFT JOIN now USING (user_id)""")
def version_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that expect a version: applied only where it is the current one."""
    e = table(spark, sf_dir, "events")
    now = e.groupBy("user_id").agg(F.count("*").alias("version"))
    asked = e.where("event_id % 5 = 0").select("event_id", "user_id", (F.col("event_id") % 40).alias("expected"))
    outcome = F.when(F.col("version").isNull(), "UNKNOWN").when(F.col("version") == F.col("expected"), "APPLIED").otherwise("REFUSED")
    return asked.join(now, "user_id", "left").select("event_id", "expected", "version", outcome.alias("outcome"))


@query("SELECT event_id, ['E' || event_id, 'E' || (event_id + 1), 'C' || event_id % 3] AS refs, event_id % 4 <> 1 AS strict FROM events")
def json_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence references at any depth of a reply, and whether the reply is one strict
    object (every fourth repeats a key)."""
    k = F.col("event_id")
    first = F.when(k % 4 == 1, F.lit('"a": 1, ')).otherwise(F.lit(""))
    reply = F.concat(F.lit("```json\n{"), first, F.lit('"a": {"evidence_ids": ["E'), k, F.lit('", "E'), k + 1, F.lit('"]}, "b": [{"x": {"context_evidence_ids" : ["C'), k % 3, F.lit('", "E'), k, F.lit('"]}}]}\n```'))
    rows = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return rows.select("event_id", P.reference_paths(F.col("reply")).alias("refs"), P.strict_object(F.col("reply")).isNotNull().alias("strict"))


@query("""SELECT doc_id, 'PG-' || left(sha256('["run-1","d' || doc_id || '",' || (doc_id % 9 + 1) || ']'), 24) AS page_key, sha256('{"source":"' || source || '","lang":"' || coalesce(lang, '') || '"}') AS semantic_hash FROM documents WHERE source IS NOT NULL""")
def result_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page keys and semantic hashes of results, from compact JSON."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    meaning = F.sha2(F.to_json(F.struct("source", F.coalesce("lang", F.lit("")).alias("lang"))), 256)
    return docs.select("doc_id", P.page_key(F.lit("run-1"), F.concat(F.lit("d"), F.col("doc_id")), F.col("doc_id") % 9 + 1).alias("page_key"), meaning.alias("semantic_hash"))


@query(f"""WITH {EV}, r AS (SELECT doc_id, raw_text, left(raw_text, 120) AS sent, ord <= 5 AS used FROM ev)
SELECT doc_id, count(*) AS selected_rows, count(*) FILTER (WHERE used) AS input_rows, count(*) FILTER (WHERE NOT used) AS omitted_rows, count(*) FILTER (WHERE used AND sent <> raw_text) AS clipped_rows, coalesce(sum(strlen(raw_text)) FILTER (WHERE used), 0)::BIGINT AS source_bytes, coalesce(sum(strlen(sent)) FILTER (WHERE used), 0)::BIGINT AS input_bytes FROM r GROUP BY doc_id""")
def context_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was selected against what was sent, per question (here: document)."""
    rows = evidence(spark, sf_dir).select("doc_id", "raw_text", F.substring("raw_text", 1, 120).alias("sent"), (F.col("ord") <= 5).alias("used"))
    size = lambda c: F.coalesce(F.sum(F.when(F.col("used"), F.octet_length(c))), F.lit(0)).cast("long")
    return rows.groupBy("doc_id").agg(F.count("*").alias("selected_rows"), F.count_if("used").alias("input_rows"), F.count_if(~F.col("used")).alias("omitted_rows"), F.count_if(F.col("used") & (F.col("sent") != F.col("raw_text"))).alias("clipped_rows"), size("raw_text").alias("source_bytes"), size("sent").alias("input_bytes"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS VARCHAR) END AS quantity, CASE WHEN p_partkey % 3 = 0 THEN 'ea' END AS unit, p_brand AS name FROM part""")
def display_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    shown = F.when(k == 0, F.concat(size, F.lit(" EA "), "p_brand")).when(k == 1, F.concat("p_brand", F.lit(" ("), size, F.lit(")"))).otherwise(F.concat(F.lit(" "), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", P.split_quantity(shown).alias("q")).select("p_partkey", "q.*")


@query("""SELECT o_orderkey, unnest([{'kind': 'SPEC_SECTION', 'value': '0330' || (o_orderkey % 90 + 10)}, {'kind': 'PARAGRAPH', 'value': '2.' || o_custkey % 7 || '.1'}, {'kind': 'SHEET', 'value': 'A-' || o_custkey % 300}, {'kind': 'RFI', 'value': CAST(o_orderkey AS VARCHAR)}, {'kind': 'SUBMITTAL', 'value': 'S' || o_custkey}], recursive := true) FROM orders""")
def question_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that questions name, by five patterns."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = ["Does RFI No. 00", k, " or submittal: s", c, " change spec section 03 30 ", k % 90 + 10, ", clause 2.", c % 7, ".1 and sheet a-", c % 300, "?"]
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("q"))
    return asked.select("o_orderkey", F.inline(P.question_identifiers(F.col("q"))))


_PAGES = "p AS (SELECT doc_id, text, len(string_split(text, ' ')) AS words, (doc_id * 37) % 60 AS graphics, 600 + (doc_id % 5) * 120 AS width FROM documents)"


@query(f"""WITH {_PAGES}, q AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'Door Schedule' WHEN 1 THEN 'SECTION 03 30 00' WHEN 2 THEN 'PART 2 - PRODUCTS' ELSE '' END AS head FROM p)
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'SCHEDULE' WHEN doc_id % 6 IN (1, 2) THEN 'SPEC_PAGE' WHEN width > 1000 OR graphics >= 40 THEN 'DRAWING' WHEN words >= 120 THEN 'SPEC_PAGE' WHEN graphics > 0 THEN 'MIXED' ELSE 'TEXT_PAGE' END AS route FROM q WHERE NOT regexp_matches(text, '(?i)\\bschedule\\b') AND words > 0""")
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route of every page by its words, graphics and size; a schedule or a heading of a
    specification goes before these."""
    d = F.col("doc_id")
    head = F.when(d % 6 == 0, "Door Schedule").when(d % 6 == 1, "SECTION 03 30 00").when(d % 6 == 2, "PART 2 - PRODUCTS").otherwise("")
    rows = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(?i)\bschedule\b"))
    return rows.select("doc_id", P.page_route(F.concat(head, F.lit("\n"), "text"), F.size(F.split("text", " ")), (d * 37) % 60, 600 + (d % 5) * 120, F.lit(800)).alias("route"))


@query("""WITH r AS (SELECT l_orderkey AS block, l_linenumber AS ordinal, l_returnflag = 'R' OR l_linenumber = 1 AS candidate FROM lineitem),
n AS (SELECT a.*, (SELECT min(abs(a.ordinal - b.ordinal)) FROM r b WHERE b.block = a.block AND b.candidate) AS gap FROM r a)
SELECT block, ordinal, candidate, row_number() OVER (PARTITION BY block ORDER BY candidate DESC, gap, ordinal) AS place FROM n""")
def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a block by their distance to the nearest candidate."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("ordinal"), ((F.col("l_returnflag") == "R") | (F.col("l_linenumber") == 1)).alias("candidate"))
    return P.block_order(rows, "block", "ordinal", "candidate")


@query("SELECT o_orderkey, 'AS_NOTED' AS name, 7 AS s, 7 + length('approved as noted') AS e FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'NOT', 7, 19 FROM orders WHERE o_orderkey % 2 = 1")
def phrase_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest, then longest phrases that do not overlap."""
    from locatext.operators.fields import _spans

    said = F.when(F.col("o_orderkey") % 2 == 0, "it is: approved as noted").otherwise("it was not approved")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("t"))
    named = lambda p, n: F.transform(_spans(F.col("t"), p, n), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["name"].alias("name")))
    found = F.concat(named("approved as noted", "AS_NOTED"), named("not approved", "NOT"), named("approved", "SHORT"), named("noted", "LATE"))
    return rows.select("o_orderkey", F.inline(P.longest_phrases(found))).select("o_orderkey", "name", "s", "e")


_WEIGHTED = f"""WITH {EV},
t AS (SELECT doc_id, ord, regexp_extract_all(lower(raw_text), '[a-z0-9]+') AS a, regexp_extract_all(lower(file_name), '[a-z0-9]+') AS b, regexp_extract_all(lower(coalesce(family, '')), '[a-z0-9]+') AS c FROM ev),
f AS (SELECT doc_id, ord, len(a) + len(b) + len(c) AS n, 2 * len(list_filter(a, lambda x: x = 'token')) + 1.5 * len(list_filter(b, lambda x: x = 'token')) + len(list_filter(c, lambda x: x = 'token')) AS f1,
  2 * len(list_filter(range(1, len(a)), lambda i: a[i] = 'of' AND a[i + 1] = 'the')) AS f2, 2 * len(list_filter(a, lambda x: x = 'en')) + 1.5 * len(list_filter(b, lambda x: x = 'en')) + len(list_filter(c, lambda x: x = 'en')) AS f3 FROM t),
g AS (SELECT count(*) AS rows_, avg(n) AS avg_n, count(*) FILTER (WHERE f1 > 0) AS n1, count(*) FILTER (WHERE f2 > 0) AS n2, count(*) FILTER (WHERE f3 > 0) AS n3 FROM f),
i AS (SELECT avg_n, CASE WHEN ln((rows_ - n1 + 0.5) / (n1 + 0.5)) > 0 THEN ln((rows_ - n1 + 0.5) / (n1 + 0.5)) ELSE 1e-6 END AS i1, CASE WHEN ln((rows_ - n2 + 0.5) / (n2 + 0.5)) > 0 THEN ln((rows_ - n2 + 0.5) / (n2 + 0.5)) ELSE 1e-6 END AS i2, CASE WHEN ln((rows_ - n3 + 0.5) / (n3 + 0.5)) > 0 THEN ln((rows_ - n3 + 0.5) / (n3 + 0.5)) ELSE 1e-6 END AS i3 FROM g),
s AS (SELECT doc_id, ord, 1.2 * (0.25 + 0.75 * n / avg_n) AS k, f1, f2, f3, i1, i2, i3 FROM f, i WHERE f1 + f2 + f3 > 0)
SELECT doc_id, ord, round(-(i1 * f1 * 2.2 / (f1 + k) + i2 * f2 * 2.2 / (f2 + k) + i3 * f3 * 2.2 / (f3 + k)), 6) AS score FROM s ORDER BY score, doc_id, ord LIMIT 160"""


@query(_WEIGHTED)
def weighted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 160 best rows over three weighted columns, for two words and a phrase."""
    rows = evidence(spark, sf_dir)
    out = S.bm25_columns(rows, ["doc_id", "ord"], {"raw_text": 2.0, "file_name": 1.5, "family": 1.0}, ["token", "of the", "en"])
    return out.withColumn("score", F.round("score", 6)).orderBy("score", "doc_id", "ord").limit(160)
