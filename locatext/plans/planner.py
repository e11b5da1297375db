"""Question planner: driver-side recognition of typed requests, one small plan each.

``recognise`` maps a question to (intent, workflow, identifier, argument) by full-match
patterns in a fixed order; ``ask`` runs the plan of the request on an evidence table
and a workflow index, answers ``UNSUPPORTED`` where the evidence has no columns for it
(``UNSUPPORTED``), and falls back to ranked retrieval for a free question. No model is
called."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locatext.functions import lexing as L
from locatext.functions.vocab import STOP_WORDS
from locatext.operators import fields as R
from locatext.operators import resolution as X
from locatext.operators import search as S

_ID = r"(?:no\.?\s*|number\s*|#\s*)?([a-z0-9][a-z0-9._/-]*)"
_ITEM = rf"(?:the\s+)?(rfi|submittal)\s+{_ID}"

#: Intents in dispatch order: name, pattern, label whose value is read.
INTENTS: list[tuple[str, str, str | None]] = [
    ("inventory_count", r"how many (rfi|submittal|email|document)s?(?: are there)?", None),
    ("inventory_list", r"list (?:all |the )?(rfi|submittal|email|document)s?", None),
    ("status_inventory", r"(?:list|which|show) (rfi|submittal)s? (?:are |by )?(open|closed|approved|rejected|pending|status)", None),
    ("email_thread", r"(?:show|list) the (?:email )?thread of (\S+)", None),
    ("attachments", r"(?:list|show|what are) (?:the )?attachments of (\S+)", None),
    ("email_to_items", r"which (rfi|submittal)s? does (?:the )?email (\S+) mention", None),
    ("item_to_emails", rf"which emails mention {_ITEM}", None),
    ("cross_relations", rf"which (?:rfi|submittal)s? (?:are|is) related to {_ITEM}", None),
    ("item_documents", rf"which (?:files|documents) (?:belong to|mention) {_ITEM}", None),
    ("email_header", r"what is the (subject|from|to|cc|bcc|reply-to|date) of (?:the )?email (\S+)", None),
    ("email_action", r"what action does (?:the )?email (\S+) (?:ask|request)(?: for)?", "action required"),
    ("action", rf"what (?:is the )?action (?:is )?(?:required|requested) (?:by|for|on) {_ITEM}", "action required"),
    ("metadata", rf"what is the (ball[- ]in[- ]court|priority|discipline|location) (?:of|for) {_ITEM}", None),
    ("impact", rf"what is the (cost|schedule) impact (?:of|for) {_ITEM}", None),
    ("rfi_content", rf"what (?:is|was) the (question|response|answer) (?:of|to|in) {_ITEM}", None),
    ("spec_section", rf"(?:which|what) (?:spec|specification) section (?:is|applies to|does) {_ITEM}(?: (?:in|cite|reference))?", "spec section"),
    ("drawing_references", rf"which drawings does {_ITEM} reference", None),
    ("clause_references", rf"which (?:clauses|paragraphs) does {_ITEM} reference", None),
    ("party", rf"who (?:is|was) (assigned to|responsible for|the author of|the reviewer of) {_ITEM}", None),
    ("submittal_field", rf"what is the (description|review comment) of {_ITEM}", None),
    ("date", rf"when (?:is|was) {_ITEM} (due|issued|submitted|received|sent|reviewed|approved|answered)", None),
    ("subject", rf"what is the (subject|title) of {_ITEM}", None),
    ("status", rf"(?:what is the status of|is) {_ITEM}(?: open| closed| approved| rejected)?", "status"),
    ("field", rf"what is the ([a-z][a-z ]{{1,40}}) (?:of|for) {_ITEM}", None),
]
#: Recognised, but without a plan: reply chains and attachments are not in the evidence
#: that ``ask`` reads (``plans.mails`` answers them over whole messages).
UNSUPPORTED = frozenset(("email_thread", "attachments"))
#: Intents answered by reading identifiers out of the item's rows.
READERS = {
    "cross_relations": lambda text: R.workflow_items(F.array_join(R.labelled(r"related\s+(?:rfis?|submittals?)", 1000)(text), "\n")),
    "drawing_references": R.drawings,
    "clause_references": R.clauses,
    "spec_section": R.sections,
}
#: Labels (patterns) under which forms give what a question asks for by other words.
LABELS = {
    "cost": r"cost\s+impact", "schedule": r"schedule\s+impact", "responsible for": r"responsible(?:\s+party)?", "assigned to": r"assigned\s+to|assignee",
    "the author of": r"submitted\s+by|submitter", "the reviewer of": r"reviewed\s+by|reviewer", "action required": r"action\s+required|required\s+action",
    "due": r"(?:response\s+)?due(?:\s+date)?", "issued": r"issue\s+date|date\s+issued|issued", "submitted": r"submission\s+date|date\s+submitted", "received": r"receipt\s+date|date\s+received",
    "sent": r"sent\s+date|date\s+sent", "reviewed": r"review\s+date|date\s+reviewed", "approved": r"approval\s+date|date\s+approved", "answered": r"response\s+date|date\s+answered",
}
_COMPILED = [(name, re.compile(rf"\s*{pattern}\s*[?.]?\s*", re.I), label) for name, pattern, label in INTENTS]


@dataclass(frozen=True)
class Request:
    intent: str
    workflow: str | None = None
    identifier: str | None = None
    argument: str | None = None
    target: str | None = None


def normalise_identifier(workflow: str, raw: str) -> str | None:
    value = raw.upper().strip(" #:-.").rstrip("._/-")
    if not any(c.isdigit() for c in value):
        return None
    return str(int(value)) if workflow == "RFI" and value.isdigit() else value


def recognise(question: str) -> Request:
    """The first intent whose pattern matches the whole question; else retrieval."""
    for name, pattern, label in _COMPILED:
        m = pattern.fullmatch(question)
        if not m:
            continue
        groups = [g.lower() for g in m.groups() if g]
        workflow = next((g.upper() for g in groups if g in ("rfi", "submittal")), None)
        rest = [g for g in groups if g not in ("rfi", "submittal")]
        identifier = next((n for g in reversed(rest) if workflow and (n := normalise_identifier(workflow, g))), None)
        argument = label or next((g for g in rest if not identifier or normalise_identifier(workflow or "", g) != identifier), None)
        return Request(name, workflow, identifier, argument, rest[-1].rstrip("?.") if rest else None)
    return Request("retrieve")


def read_field(rows: DataFrame, request: Request, cap: int = 32) -> DataFrame:
    """Values of ``Label: value`` lines of one item: ANSWERED, CONFLICT, NONE, or REFUSED
    beyond ``cap`` candidate rows (a request that broad has no one answer)."""
    mine = rows.where((F.col("workflow") == request.workflow) & (F.col("identifier") == request.identifier))
    return _read_label(mine, request, cap)


def _read_label(rows: DataFrame, request: Request, cap: int) -> DataFrame:
    label = request.argument or "status"
    pattern = LABELS.get(label) or re.escape(label)
    mine = rows.where(F.col("raw_text").rlike(f"(?i){pattern}"))
    value = F.regexp_extract("raw_text", f"(?im)^[ \\t]*(?:{pattern})[ \\t]*:[ \\t]*(.+?)[ \\t]*$", 1)
    found = mine.select("evidence_id", value.alias("value")).agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.when(F.col("value") != "", F.col("value")))).alias("values"), F.array_sort(F.collect_set(F.when(F.col("value") != "", F.col("evidence_id")))).alias("cited"))
    return found.select(F.lit(request.intent).alias("intent"), F.when(F.col("rows") > cap, "REFUSED").otherwise(X.agree(F.col("values"))).alias("outcome"), "values", "cited")


def retrieve(rows: DataFrame, question: str, results: int = 8) -> DataFrame:
    """Ranked evidence ids for a free question."""
    stop = set(STOP_WORDS)
    terms = [t for t in dict.fromkeys(re.findall(r"[a-z0-9]+", question.lower())) if t not in stop][:10]
    hits = S.postings(rows, ["evidence_id"], "raw_text", terms or [""])
    scored = hits.groupBy("evidence_id").agg(F.count("*").alias("hits"), F.sum(S.concept_points(F.col("term"), F.lit(True), F.col("tf"))).alias("points"))
    return S.rank_rows(scored.withColumn("score", F.col("points") + S.coverage_bonus(F.col("hits"), len(terms)))).limit(results).select("evidence_id", "hits", "score")


def _emails(rows: DataFrame) -> DataFrame:
    """Rows of the documents that are emails by their name or first header line."""
    family = L.source_family(F.col("document_id"), F.col("raw_text"))
    mails = rows.where((F.col("workflow") == "EMAIL") | (family == "EMAIL")).select("document_id").distinct()
    return rows.join(mails, "document_id", "left_semi")


def _listed(rows: DataFrame, intent: str, value: str, cited: str) -> DataFrame:
    """All distinct values in order, with what they are cited from."""
    found = rows.agg(F.array_sort(F.collect_set(value)).alias("v"), F.array_sort(F.collect_set(cited)).alias("c"))
    return found.select(F.lit(intent).alias("intent"), F.when(F.size("v") > 0, "ANSWERED").otherwise("NONE").alias("outcome"), F.col("v").alias("values"), F.col("c").alias("cited"))


def _inventory(rows: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """Rows of a kind of item, and the column that names an item."""
    if kind == "DOCUMENT":
        return rows, "document_id"
    if kind == "EMAIL":
        return _emails(rows), "document_id"
    return rows.where(F.col("workflow") == kind), "identifier"


def _statuses(rows: DataFrame, request: Request) -> DataFrame:
    """Items of a status, or all with theirs; an item with several is a ``CONFLICT`` and
    one without any ``NONE``, and both are listed only by status."""
    value = F.regexp_extract("raw_text", r"(?im)^[ \t]*status[ \t]*:[ \t]*(.+?)[ \t]*$", 1)
    mine = rows.where((F.col("workflow") == request.workflow) & F.col("identifier").isNotNull()).select("identifier", "evidence_id", F.when(value != "", value).alias("said"))
    items = mine.groupBy("identifier").agg(F.collect_set(F.lower("said")).alias("s"), F.min("said").alias("said"), F.min(F.when(F.col("said").isNotNull(), F.col("evidence_id"))).alias("evidence_id"))
    if request.argument != "status":
        return _listed(items.where((F.size("s") == 1) & (F.col("s")[0] == request.argument)), request.intent, "identifier", "evidence_id")
    state = F.when(F.size("s") > 1, "CONFLICT").otherwise(F.coalesce("said", F.lit("NONE")))
    return _listed(items.select(F.concat_ws(": ", "identifier", state).alias("item"), "evidence_id"), request.intent, "item", "evidence_id")


def ask(rows: DataFrame, question: str) -> DataFrame:
    """Answer one question over ``rows`` (evidence_id, workflow, identifier, role,
    document_id, raw_text)."""
    request = recognise(question)
    if request.intent == "inventory_count":
        kind, item = _inventory(rows, request.workflow or (request.argument or "").upper())
        return kind.agg(F.countDistinct(item).alias("n")).select(F.lit(request.intent).alias("intent"), F.lit("ANSWERED").alias("outcome"), F.array(F.col("n").cast("string")).alias("values"), F.array().cast("array<string>").alias("cited"))
    if request.intent in UNSUPPORTED:
        none = F.array().cast("array<string>")
        return rows.sparkSession.range(1).select(F.lit(request.intent).alias("intent"), F.lit("UNSUPPORTED").alias("outcome"), none.alias("values"), none.alias("cited"))
    if request.intent in READERS:
        mine = rows.where((F.col("workflow") == request.workflow) & (F.col("identifier") == request.identifier))
        found = mine.select("evidence_id", F.explode(READERS[request.intent](F.col("raw_text"))).alias("value"))
        if request.intent == "cross_relations":
            found = found.where(~F.col("value").isin(f"{request.workflow}:{request.identifier}"))
        return _listed(found, request.intent, "value", "evidence_id")
    if request.intent == "inventory_list":
        kind, item = _inventory(rows, request.workflow or (request.argument or "").upper())
        return _listed(kind, request.intent, item, "document_id")
    if request.intent == "status_inventory":
        return _statuses(rows, request)
    if request.intent == "email_to_items":
        mine = _emails(rows).where((F.lower("document_id") == request.target) & (F.col("workflow") == request.workflow))
        return _listed(mine, request.intent, "identifier", "evidence_id")
    if request.intent == "email_header":
        return _read_label(_emails(rows).where(F.lower("document_id") == request.target), request, 32)
    if request.intent == "rfi_content":
        role = "QUESTION" if request.argument == "question" else "RESPONSE"
        mine = rows.where((F.col("workflow") == request.workflow) & (F.col("identifier") == request.identifier) & (F.col("role") == role))
        said = mine.agg(F.array_sort(F.collect_list(F.struct("evidence_id", "raw_text"))).alias("r"))
        texts = F.transform("r", lambda x: x["raw_text"])
        return said.select(F.lit(request.intent).alias("intent"), F.when(F.size("r") > 0, "ANSWERED").otherwise("NONE").alias("outcome"), texts.alias("values"), F.transform("r", lambda x: x["evidence_id"]).alias("cited"))
    if request.intent in ("item_documents", "item_to_emails"):
        of = _emails(rows) if request.intent == "item_to_emails" else rows
        mine = of.where((F.col("workflow") == request.workflow) & (F.col("identifier") == request.identifier))
        return mine.agg(F.array_sort(F.collect_set("document_id")).alias("v")).select(F.lit(request.intent).alias("intent"), F.when(F.size("v") > 0, "ANSWERED").otherwise("NONE").alias("outcome"), F.col("v").alias("values"), F.col("v").alias("cited"))
    if request.identifier:
        return read_field(rows, request)
    ranked = retrieve(rows, question)
    return ranked.agg(F.transform(F.sort_array(F.collect_list(F.struct("score", "hits", "evidence_id")), False), lambda x: x["evidence_id"]).alias("cited")).select(F.lit("retrieve").alias("intent"), F.lit("CONTEXT").alias("outcome"), F.array().cast("array<string>").alias("values"), "cited")
