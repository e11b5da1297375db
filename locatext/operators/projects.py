"""Project rows: eligibility, scopes, quantities, identities and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ineligible(section: Column, block_questions: Column | bool = True) -> Column:
    """Why a row may not support a requirement, or null: quoted history, mail headers,
    rejected submittals, and RFI text that is not a response where those are blocked."""
    s = F.upper(F.coalesce(section, F.lit("")))
    block = F.lit(block_questions) if isinstance(block_questions, bool) else block_questions
    rejected = s.contains("SUBMITTAL") & (s.contains("STATUS: REJECTED") | s.contains("STATUS: REVISE AND RESUBMIT"))
    return (
        F.when(s.startswith("EMAIL > QUOTED HISTORY"), "EMAIL_QUOTED_HISTORY")
        .when(s.startswith("EMAIL > HEADERS"), "EMAIL_HEADER")
        .when(rejected, "REJECTED_SUBMITTAL")
        .when(block & s.contains("RFI") & ~s.contains("> RESPONSE"), "RFI_QUESTION")
    )


# Acts and papers of quality control, by pattern.
QA_ACTION = r"(?i)\b(?:test|inspect|verif|witness|commission|balanc|start[- ]?up|certif|sampl)"
NO_QA_PAPER = r"(?i)^(?:shop drawings?|product data|warrant(?:y|ies)|schedule|invoice|manual)\b"
QA_REPORT = r"(?i)\b(?:test|inspection|start[- ]?up|commissioning|balancing|quality control)\b.{0,50}\breport\b|\breport\b.{0,50}\b(?:test|inspection|start[- ]?up|commissioning|balancing|quality control)\b"


def inspection_allowed(category: Column, action: Column, subject: Column, obj: Column) -> Column:
    """Whether an atom is an inspection: it names such an act, its object is not another
    paper, inspections and tests say so in the action, reports are reports of one."""
    said = F.concat_ws(" ", action, obj, subject)
    primary = F.regexp_replace(F.coalesce(obj, F.lit("")), r"(?i)^\s*(?:provide|submit|prepare)\s+(?:(?:a|an|the)\s+)?", "")
    own = ~category.isin("INSPECTION", "TEST") | F.coalesce(action, F.lit("")).rlike(QA_ACTION)
    report = (category != "REPORT") | said.rlike(QA_REPORT)
    return said.rlike(QA_ACTION) & ~primary.rlike(NO_QA_PAPER) & own & report


def merge_quantities(rows: DataFrame, group: str) -> DataFrame:
    """One quantity a group of rows (group, evidence_id, day, value, unit; value null
    where a row has none). Agreement stands; else the newest day decides, if every row
    has one, all rows of that day have a value and agree; otherwise UNRESOLVED."""
    has = F.col("value").isNotNull()
    pair = F.struct("value", F.coalesce("unit", F.lit("")).alias("unit"))
    newest = rows.withColumn("latest", F.max("day").over(W.partitionBy(group)))
    at_newest = F.col("day") == F.col("latest")
    g = newest.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(has).alias("given"), F.count_if(F.col("day").isNull()).alias("undated"),
        F.count_if(at_newest & ~has).alias("bare"), F.collect_set(F.when(has, pair)).alias("every"), F.collect_set(F.when(at_newest & has, pair)).alias("last"),
    )
    known = (F.col("n") == 1) | ((F.col("undated") == 0) & (F.col("bare") == 0))
    chosen = F.when((F.size("every") == 1) & known, F.col("every")[0]).when(known & (F.size("last") == 1), F.col("last")[0])
    status = F.when(F.col("given") == 0, "NONE").when(chosen.isNull(), "UNRESOLVED").otherwise("SELECTED")
    return g.select(group, status.alias("status"), chosen["value"].alias("value"), F.nullif(chosen["unit"], F.lit("")).alias("unit"))


def scope_violations(rows: DataFrame, project: str, snapshot: str) -> DataFrame:
    """Rows that belong to another project or snapshot than asked for."""
    return rows.where(~F.col("project_id").eqNullSafe(F.lit(project)) | ~F.col("snapshot_id").eqNullSafe(F.lit(snapshot)))


def guarded(rows: DataFrame, project: str, snapshot: str) -> DataFrame:
    """``rows``; the query fails as soon as one of them is out of scope."""
    inside = F.col("project_id").eqNullSafe(F.lit(project)) & F.col("snapshot_id").eqNullSafe(F.lit(snapshot))
    return rows.withColumn("row_id", F.when(F.assert_true(inside, F.lit("a row is out of scope")).isNull(), F.col("row_id")))


def expand_scope(rows: DataFrame, hits: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows of the exact scopes (document and sheet, or section and paragraph) that the
    hits have; a scope whose hits contradict each other in ``label`` is not expanded."""
    scopes = hits.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))).groupBy(*keys).agg(F.count_distinct("label").alias("labels")).where("labels <= 1")
    return rows.join(scopes.select(*keys), keys, "left_semi").select(*keys, row)


def block_order(rows: DataFrame, block: str, ordinal: str, candidate: str) -> DataFrame:
    """``rows`` with ``place``: candidates first, then the nearest to one, then by ordinal.
    The nearest candidate is looked for on both sides with running windows."""
    before = F.last(F.when(F.col(candidate), F.col(ordinal)), ignorenulls=True).over(W.partitionBy(block).orderBy(ordinal).rowsBetween(W.unboundedPreceding, 0))
    after = F.first(F.when(F.col(candidate), F.col(ordinal)), ignorenulls=True).over(W.partitionBy(block).orderBy(ordinal).rowsBetween(0, W.unboundedFollowing))
    near = rows.withColumn("gap", F.least(F.col(ordinal) - before, after - F.col(ordinal)))
    order = [F.desc(candidate), F.asc_nulls_last("gap"), F.asc(ordinal)]
    return near.withColumn("place", F.row_number().over(W.partitionBy(block).orderBy(*order))).drop("gap")


def fit_json(text: Column, budget: int) -> Column:
    """The longest start of a text whose JSON string (quotes and escapes included, in
    UTF-8) takes at most ``budget`` bytes, by bisection: the length never falls as the
    start grows."""
    size = lambda n: F.octet_length(F.to_json(F.struct(text.substr(F.lit(1), n).alias("t")))) - 6

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        fits = size(mid) <= budget
        return F.struct(F.when(fits, mid).otherwise(acc["lo"]).alias("lo"), F.when(fits, acc["hi"]).otherwise(F.greatest(acc["lo"], mid - 1)).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.least(F.length(text), F.lit(budget)).alias("hi"))
    steps = F.array(*map(F.lit, range(max(1, budget.bit_length()) + 1)))
    return text.substr(F.lit(1), F.aggregate(steps, start, halve)["lo"])


def longest_phrases(found: Column) -> Column:
    """Of matches (array of s, e, name) those that stay: by start, longer first, and none
    that overlaps one before it."""
    kind = "array<struct<s:int,e:int,name:string>>"
    ordered = F.array_sort(found, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).when(a["e"] != b["e"], b["e"] - a["e"]).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    keep = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(F.element_at(acc, -1)["e"] <= x["s"], F.concat(acc, F.array(x))).otherwise(acc)
    return F.aggregate(ordered.cast(kind), F.expr(f"CAST(array() AS {kind})"), keep)


def focus(text: Column, needle: Column, before: int = 120, after: int = 360) -> Column:
    """The clause of a text around a needle; else the sentence (of 20 characters or more)
    with the most of the needle's words, if it has two; else the text."""
    at = F.position(F.lower(needle), F.lower(text))
    start = F.greatest(F.lit(1), at - before)
    head = text.substr(start, at - start)
    lead = F.length(F.regexp_extract(head, r"(?s)^.*(?:[.;] |\n)", 0))
    end = F.least(F.length(text), at - 1 + F.length(needle) + after)
    tail = text.substr(at + F.length(needle), end - at - F.length(needle) + 1)
    stop = F.regexp_instr(tail, F.lit("[.;] "))
    stop = F.when(stop > 0, stop).otherwise(F.length(tail))
    cut = F.trim(text.substr(start + lead, at - start - lead + F.length(needle) + stop))
    words = F.array_distinct(F.regexp_extract_all(F.lower(needle), F.lit("[a-z0-9-]{4,}"), F.lit(0)))
    segments = F.filter(F.split(text, r"(?<=[.;])\s+"), lambda x: F.length(F.trim(x)) >= 20)
    scored = F.transform(segments, lambda x, i: F.struct(F.size(F.filter(words, lambda w: F.lower(x).contains(w))).alias("hits"), (-i).alias("i"), F.trim(x).alias("x")))
    best = F.array_max(scored)
    return F.when(at > 0, cut).when((F.size(segments) > 0) & (best["hits"] >= 2), best["x"]).otherwise(text)


def source_groups(rows: DataFrame) -> DataFrame:
    """(document_id, file_name, page, refs, scopes): ordered references of every page, and
    of every section on it."""
    ordered = lambda: F.transform(F.array_sort(F.collect_list(F.struct("source_order", "ref"))), lambda x: x["ref"])
    page = ["document_id", "file_name", "page"]
    refs = rows.groupBy(*page).agg(ordered().alias("refs"))
    by_scope = rows.where("section IS NOT NULL").groupBy(*page, "section").agg(F.min("source_order").alias("o"), ordered().alias("r"))
    scopes = by_scope.groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "section", "r"))), lambda x: F.concat_ws("=", x["section"], F.array_join(x["r"], ","))).alias("scopes"))
    return refs.join(scopes, page, "left")


def reference_paths(json: Column, keys: tuple[str, ...] = ("evidence_ids", "context_evidence_ids")) -> Column:
    """All identifiers under the given keys at any depth of a JSON text, in order."""
    names = "|".join(keys)
    arrays = F.regexp_extract_all(json, F.lit(rf'"(?:{names})"\s*:\s*\[([^\]]*)\]'), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(arrays, lambda x: F.regexp_extract_all(x, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)))))


def strict_object(text: Column) -> Column:
    """The JSON object inside a reply (a code fence around it is taken away) if it is one
    and repeats no key at its top level, else null."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*\n(.*)\n```$", "$1")
    flat = F.regexp_replace(F.regexp_replace(bare, r'(?s)^\s*\{', ""), r"\{[^{}]*\}|\[[^\[\]]*\]", "0")
    keys = F.regexp_extract_all(flat, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    ok = bare.rlike(r"(?s)^\s*\{.*\}\s*$") & F.json_object_keys(bare).isNotNull() & (F.size(keys) == F.size(F.array_distinct(keys)))
    return F.when(ok, bare)


def page_key(run: Column, document: Column, page: Column) -> Column:
    """Key of a page in a run: PG- and 24 hex digits of the compact JSON list."""
    return F.concat(F.lit("PG-"), F.substring(F.sha2(F.concat(F.lit('["'), run, F.lit('","'), document, F.lit('",'), page.cast("string"), F.lit("]")), 256), 1, 24))


def split_quantity(name: Column) -> Column:
    """(quantity, unit, name) of a display name such as "12 ea Valve" or "Valve (3)"."""
    lead = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(ea|each|pcs|nos?\.?|x)?\s+(\S.*?)\s*$"
    tail = r"^\s*(.*?)\s*\((\d+(?:\.\d+)?)\)\s*$"
    by_lead, by_tail = name.rlike(lead), name.rlike(tail)
    quantity = F.when(by_lead, F.regexp_extract(name, lead, 1)).when(by_tail, F.regexp_extract(name, tail, 2))
    rest = F.when(by_lead, F.regexp_extract(name, lead, 3)).when(by_tail, F.regexp_extract(name, tail, 1)).otherwise(F.trim(name))
    return F.struct(quantity.alias("quantity"), F.when(by_lead, F.nullif(F.lower(F.regexp_extract(name, lead, 2)), F.lit(""))).alias("unit"), rest.alias("name"))


def question_identifiers(text: Column) -> Column:
    """(kind, value) of the identifiers that a question names, in the order of kinds."""
    kinds = {
        "SPEC_SECTION": r"(?i)\b(?:SPECIFICATION\s+SECTION|SPEC\s+SECTION|SECTION)\s*[:#]?\s*(\d{5}|\d{2}(?:[ .-]+\d{2}){2})",
        "PARAGRAPH": r"(?i)\b(?:PARAGRAPH|PARA\.?|CLAUSE|ARTICLE)\s*[:#]?\s*(\d+(?:\.\d+)+)",
        "SHEET": r"(?i)\b(?:SHEET|DRAWING|DWG\.?)\s*[:#]?\s*([A-Z0-9][A-Z0-9._/-]{1,31})",
        "RFI": r"(?i)\bRFI\s*(?:NO\.?\s*)?[:#-]?\s*([A-Z0-9][A-Z0-9._/-]{0,31})",
        "SUBMITTAL": r"(?i)\bSUBMITTAL\s*(?:NO\.?\s*)?[:#-]?\s*([A-Z0-9][A-Z0-9._/-]{0,31})",
    }

    def plain(kind: str, x: Column) -> Column:
        x = F.regexp_replace(F.upper(x), "[._/-]+$", "")
        return F.regexp_replace(x, "[ .-]", "") if kind == "SPEC_SECTION" else F.regexp_replace(x, "^0+(?=[0-9])", "") if kind == "RFI" else x

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), plain(kind, x).alias("value")))

    return F.array_distinct(F.concat(*[of(kind, p) for kind, p in kinds.items()]))


def page_route(text: Column, words: Column, graphics: Column, width: Column, height: Column) -> Column:
    """Route of a page: what it says comes first, then what it holds."""
    schedule = r"(?i)\bSCHEDULE\b"
    spec = r"(?im)\b(?:SECTION\s+(?:\d{5}|\d{2}(?:[ .-]+\d{2}){2})|\d{2}\s+\d{2}\s+\d{2})\b|^\s*PART\s+[123IVX]+\b(?:\s*[-–—:]\s*.*)?$|^\s*DIVISION\s+\d{1,2}\b(?:\s*[-–—:]\s*.*)?$"
    return (
        F.when(text.rlike(schedule), "SCHEDULE")
        .when(text.rlike(spec), "SPEC_PAGE")
        .when(words == 0, F.when(graphics > 0, "GRAPHIC_OR_SCAN").otherwise("BLANK"))
        .when((width > 1000) | (height > 1400) | (graphics >= 40), "DRAWING")
        .when(words >= 120, "SPEC_PAGE")
        .otherwise(F.when(graphics > 0, "MIXED").otherwise("TEXT_PAGE"))
    )
