"""Questions over project files: RFI and submittal forms, and the e-mails about them.

The files are written out from ``orders`` and ``events`` as text and read back by the
operators of ``operators.fields``; the SQL of each query states the values that went in,
from the columns alone, and reads no text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.operators import fields as R
from locatext.registry import query
from locatext.session import table

def _k() -> Column:
    return F.col("o_orderkey")


def _c() -> Column:
    return F.col("o_custkey")


def _is_rfi() -> Column:
    return _k() % 2 == 1


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _item() -> Column:
    return F.when(_is_rfi(), F.concat(F.lit("RFI:"), _k())).otherwise(F.concat(F.lit("SUBMITTAL:S-"), _k()))


def forms(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(o_orderkey, document_id, name, item, text): a form of every order, and for every
    tenth a second file of the same item with another priority and status. ``spread``
    deals the orders out first: one row group of them is minutes of reading forms."""
    o = table(spark, sf_dir, "orders")
    if spread:  # by number, else adaptive execution joins small parts again
        o = o.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    header = F.when(_is_rfi(), _line("RFI No. 00", _k())).otherwise(_line("SUBMITTAL: S-", _k()))
    other = lambda first, second: F.when(F.col("copy") == 0, first).otherwise(second)
    lines = [
        header,
        _line("Subject: Works of customer ", _c()),
        _line("Status: ", F.when(_is_rfi(), F.when(F.col("o_orderstatus") == "F", other(F.lit("Closed"), F.lit("Open"))).otherwise(F.lit("Open"))).otherwise(F.when(_c() % 3 == 0, "Make corrections noted").when(_c() % 3 == 1, "Revise/Resubmit").otherwise("No exceptions taken"))),
        _line("Ball in Court: Customer ", _c()),
        _line("  PRIORITY : ", other(F.col("o_orderpriority"), F.lit("ESCALATED"))),
        _line("Discipline: Trade ", _c() % 7),
        _line("Location: Building ", _c() % 5),
        _line("Cost Impact: ", _k() % 900, " USD"),
        _line("Schedule Impact: ", _k() % 30, " days"),
        _line("Assigned to: Crew ", _c() % 11),
        _line("Responsible Party: Office ", _c() % 13),
        _line("Submitted by: Writer ", _c() % 17),
        _line("Reviewer: Reader ", _c() % 19),
        _line("Required Action: Answer by day ", _k() % 28),
        _line("Next action: Send part ", _k() % 9),
        _line("Action Item: Check row ", _k() % 5),
        _line("Widget Code: W", _k()),
        _line("Due Date: 2024-", F.lpad((_k() % 12 + 1).cast("string"), 2, "0"), "-15"),
        _line("Date Issued: ", F.date_format("o_orderdate", "yyyy-MM-dd")),
        _line("Date Received: 2023-", F.lpad((_c() % 12 + 1).cast("string"), 2, "0"), "-09"),
        F.when(_k() % 4 < 2, _line("Specification Section: 03 30 ", _k() % 90 + 10)).otherwise(_line("Section 0", _k() % 9000 + 1000, " applies")),
        _line("See Drawing A-", _c() % 9, ".", _k() % 9 + 1, " and sheet no. S", _c() % 50, "; detail 2024-01-05"),
        _line("Refer to para. 2.", _k() % 9 + 1, ".3 and Clause 4.", _c() % 9 + 1, "a"),
        _line("Revision ", F.substring(F.lit("ABCDE"), (_k() % 5 + 1).cast("int"), F.lit(1)), ", rev no. ", _c() % 6, "; Revision Date pending"),
        F.when(_is_rfi(), F.when(_k() % 8 == 1, F.lit("Related Submittals: None")).otherwise(_line("Related Submittals: Submittal S-", _k() + 1, ", Submittal S-", _k() + 3))).otherwise(_line("Related RFIs: RFI 0", _k() + 1)),
        F.when(_is_rfi(), _line("Question:\nMay row ", _k() % 77, " be moved?\nIt is late.\nResponse: Yes, row ", _k() % 77, " may.")).otherwise(_line("Description: Samples ", _c() % 23, "\nReview Comments:\nColour ", _c() % 4, " is fine.\nShip it.")),
        _line("The pipe diameter is ", _k() % 40 + 10, " mm; its length ", _c() % 9 + 1, ".5 m. RFI 12 asks for 5."),
    ]
    copies = F.explode(F.when(_k() % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    with_copies = o.select("*", copies)
    return with_copies.select("o_orderkey", F.concat_ws("-", _k(), "copy").alias("document_id"), F.concat(_k().cast("string"), F.when(F.col("copy") == 0, ".docx").otherwise(".txt")).alias("name"), _item().alias("item"), F.concat_ws("\n", *lines).alias("text"))


_ITEM = "CASE WHEN o_orderkey % 2 = 1 THEN 'RFI:' || o_orderkey ELSE 'SUBMITTAL:S-' || o_orderkey END"
_COPIES = "CASE WHEN o_orderkey % 10 = 3 THEN 2 ELSE 1 END"


def _answers_sql(**values: str) -> str:
    """Answers where every file of an item says the same."""
    return " UNION ALL ".join(f"SELECT {_ITEM} AS item, '{role}' AS role, 'ANSWERED' AS status, {value} AS value, {_COPIES} AS files FROM orders" for role, value in values.items())


def _answers(spark: SparkSession, sf_dir: str, **readers: R.Reader) -> DataFrame:
    return R.answer_items(R.read_fields(forms(spark, sf_dir), readers, ["document_id", "item"]))


#: Labels of the registered fields (patterns).
PARTY = {"ASSIGNED_TO": r"assigned\s+to|assignee", "RESPONSIBLE_PARTY": r"responsible\s+party|responsible", "SUBMITTED_BY": r"submitted\s+by|submitter", "REVIEWED_BY": r"reviewed\s+by|reviewer"}
ACTION = {"ACTION_REQUIRED": r"action\s+required|required\s+action", "NEXT_ACTION": r"next\s+action", "ACTION_ITEM": r"action\s+item"}
METADATA = {"BALL_IN_COURT": r"ball[-\s]+in[-\s]+court", "PRIORITY": "priority", "DISCIPLINE": "discipline", "LOCATION": "location"}
IMPACT = {"COST": r"cost\s+impact", "SCHEDULE": r"schedule\s+impact"}
_BLOCKS = "question|response|description|review comments|the pipe diameter is[^\n]*"


def _labelled(table_of: dict[str, str], longest: int = 200) -> dict[str, R.Reader]:
    return {role: R.labelled(p, longest) for role, p in table_of.items()}


@query(_answers_sql(ASSIGNED_TO="'Crew ' || o_custkey % 11", RESPONSIBLE_PARTY="'Office ' || o_custkey % 13", SUBMITTED_BY="'Writer ' || o_custkey % 17", REVIEWED_BY="'Reader ' || o_custkey % 19"))
def workflow_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, **_labelled(PARTY))


@query(_answers_sql(ACTION_REQUIRED="'Answer by day ' || o_orderkey % 28", NEXT_ACTION="'Send part ' || o_orderkey % 9", ACTION_ITEM="'Check row ' || o_orderkey % 5"))
def workflow_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, **_labelled(ACTION, 1000))


@query(f"{_answers_sql(BALL_IN_COURT=chr(39) + 'Customer ' + chr(39) + ' || o_custkey', DISCIPLINE=chr(39) + 'Trade ' + chr(39) + ' || o_custkey % 7', LOCATION=chr(39) + 'Building ' + chr(39) + ' || o_custkey % 5')} UNION ALL SELECT {_ITEM}, 'PRIORITY', CASE WHEN o_orderkey % 10 = 3 THEN 'CONFLICT' ELSE 'ANSWERED' END, CASE WHEN o_orderkey % 10 <> 3 THEN o_orderpriority END, {_COPIES} FROM orders")
def workflow_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of an item that differ in a field are a conflict, not a choice."""
    return _answers(spark, sf_dir, **_labelled(METADATA))


@query(_answers_sql(COST="(o_orderkey % 900) || ' USD'", SCHEDULE="(o_orderkey % 30) || ' days'"))
def workflow_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, **_labelled(IMPACT))


@query(_answers_sql(WIDGET_CODE="'W' || o_orderkey"))
def unregistered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field by its literal label."""
    return _answers(spark, sf_dir, WIDGET_CODE=R.labelled(r"\QWidget Code\E"))


@query(_answers_sql(SUBJECT="'Works of customer ' || o_custkey"))
def workflow_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, SUBJECT=R.labelled("subject", 500))


@query(f"SELECT {_ITEM} AS item, 'DESCRIPTION' AS role, 'ANSWERED' AS status, 'Samples ' || o_custkey % 23 AS value, 1 AS files FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT {_ITEM}, 'REVIEW_COMMENTS', 'ANSWERED', 'Colour ' || o_custkey % 4 || ' is fine.' || chr(10) || 'Ship it.', 1 FROM orders WHERE o_orderkey % 2 = 0")
def submittal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline and block fields of submittals."""
    cut = lambda label: lambda text: F.transform(R.block(label, _BLOCKS)(text), lambda x: F.regexp_replace(x, "(?s)\nThe pipe.*$", ""))
    readers = {"DESCRIPTION": cut("description"), "REVIEW_COMMENTS": cut("review comments")}
    return R.answer_items(R.read_fields(forms(spark, sf_dir).where(F.col("item").startswith("SUB")), readers, ["document_id", "item"]))


@query(f"SELECT {_ITEM} AS item, 'QUESTION' AS role, 'ANSWERED' AS status, 'May row ' || o_orderkey % 77 || ' be moved?' || chr(10) || 'It is late.' AS value, {_COPIES} AS files FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT {_ITEM}, 'RESPONSE', 'ANSWERED', 'Yes, row ' || o_orderkey % 77 || ' may.', {_COPIES} FROM orders WHERE o_orderkey % 2 = 1")
def rfi_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an RFI asks and what it is answered."""
    cut = lambda label: lambda text: F.transform(R.block(label, _BLOCKS)(text), lambda x: F.regexp_replace(x, "(?s)\nThe pipe.*$", ""))
    readers = {"QUESTION": cut("question"), "RESPONSE": cut("response|answer")}
    return R.answer_items(R.read_fields(forms(spark, sf_dir).where(F.col("item").startswith("RFI")), readers, ["document_id", "item"]))


@query(f"SELECT {_ITEM} AS item, CASE WHEN o_orderkey % 4 < 2 THEN '0330' || (o_orderkey % 90 + 10) ELSE '0' || (o_orderkey % 9000 + 1000) END AS value FROM orders")
def workflow_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specification sections of both numbering schemes."""
    return R.read_fields(forms(spark, sf_dir), {"SECTION": R.sections}, ["item"]).select("item", "value").distinct()


@query(f"SELECT {_ITEM} AS item, unnest(['A-' || o_custkey % 9 || '.' || (o_orderkey % 9 + 1), 'S' || o_custkey % 50]) AS value FROM orders")
def drawing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings that an item's files refer to; a date after "detail" is none."""
    return R.read_fields(forms(spark, sf_dir), {"DRAWING": R.drawings}, ["item"]).select("item", "value").distinct()


@query(f"SELECT {_ITEM} AS item, unnest(['PARAGRAPH:2.' || (o_orderkey % 9 + 1) || '.3', 'CLAUSE:4.' || (o_custkey % 9 + 1) || 'A']) AS value FROM orders")
def clause_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_fields(forms(spark, sf_dir), {"CLAUSE": R.clauses}, ["item"]).select("item", "value").distinct()


@query(f"SELECT DISTINCT {_ITEM} AS item, unnest(['ABCDE'[CAST(o_orderkey % 5 + 1 AS INTEGER)], CAST(o_custkey % 6 AS VARCHAR)]) AS value FROM orders")
def revision_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong and weak revision labels; "revision date" is none."""
    return R.read_fields(forms(spark, sf_dir), {"REVISION": R.revisions}, ["item"]).select("item", "value").distinct()


_DATE_LABELS = {"DUE": r"due(?:\s+date)?", "ISSUED": r"issue\s+date|date\s+issued|issued", "RECEIVED": r"receipt\s+date|date\s+received|received"}


@query(_answers_sql(DUE="'2024-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '-15'", ISSUED="strftime(o_orderdate, '%Y-%m-%d')", RECEIVED="'2023-' || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-09'"))
def workflow_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of an item by their role."""
    dated = lambda p: lambda text: F.filter(R.labelled(p)(text), lambda x: F.try_to_date(x, "yyyy-MM-dd").isNotNull())
    return _answers(spark, sf_dir, **{role: dated(p) for role, p in _DATE_LABELS.items()})


_STATUS_SQL = "CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END WHEN o_custkey % 3 = 0 THEN 'APPROVED AS NOTED' WHEN o_custkey % 3 = 1 THEN 'REVISE AND RESUBMIT' ELSE 'APPROVED' END"


@query(f"SELECT {_ITEM} AS item, CASE WHEN o_orderkey % 10 = 3 AND o_orderstatus = 'F' THEN 'CONFLICT' ELSE {_STATUS_SQL} END AS status, CASE WHEN o_orderkey % 10 = 3 AND o_orderstatus = 'F' THEN 'CLOSED in ' || o_orderkey || '.docx; OPEN in ' || o_orderkey || '.txt' ELSE {_STATUS_SQL} || ' in ' || CASE WHEN o_orderkey % 10 = 3 THEN o_orderkey || '.docx, ' || o_orderkey || '.txt' ELSE o_orderkey || '.docx' END END AS cited FROM orders")
def workflow_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every item with the files that say so; files that differ are a
    conflict that cites each side."""
    kinds = {"S": lambda text: F.when(F.col("item").startswith("RFI"), R.statuses(text, R.RFI_STATUS)).otherwise(R.statuses(text, R.SUBMITTAL_STATUS))}
    said = R.read_fields(forms(spark, sf_dir), kinds, ["item", "name"])
    by_value = said.groupBy("item", "value").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    sides = by_value.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("value", "names"))).alias("s"))
    cited = F.array_join(F.transform("s", lambda x: F.concat(x["value"], F.lit(" in "), x["names"])), "; ")
    return sides.select("item", F.when(F.size("s") > 1, "CONFLICT").otherwise(F.col("s")[0]["value"]).alias("status"), cited.alias("cited"))


@query(f"""SELECT {_ITEM} AS item, CASE WHEN o_orderkey % 8 = 1 THEN 'NONE' ELSE 'RELATED' END AS status, unnest(CASE WHEN o_orderkey % 8 = 1 THEN [NULL] ELSE ['SUBMITTAL:S-' || (o_orderkey + 1), 'SUBMITTAL:S-' || (o_orderkey + 3)] END) AS related FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT {_ITEM}, 'RELATED', 'RFI:' || (o_orderkey + 1) FROM orders WHERE o_orderkey % 2 = 0""")
def cross_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a form relates explicitly, or that it says there are none."""
    said = R.read_fields(forms(spark, sf_dir), {"R": R.labelled(r"related\s+(?:rfis?|submittals?)", 1000)}, ["item"]).select("item", "value").distinct()
    none = F.lower("value").isin("none", "n/a", "not applicable")
    related = F.when(none, F.array(F.lit(None).cast("string"))).otherwise(R.workflow_items(F.col("value")))
    return said.select("item", F.when(none, "NONE").otherwise("RELATED").alias("status"), F.explode(related).alias("related"))


def _doc_name(k: str) -> str:
    return f"{k} || '.docx'"


@query(f"""WITH f AS (SELECT o_orderkey AS k, o_orderkey || '.docx' AS name, {_ITEM} AS item FROM orders UNION ALL SELECT o_orderkey, o_orderkey || '.txt', {_ITEM} FROM orders WHERE o_orderkey % 10 = 3),
r AS (SELECT item, name, 0 AS way FROM f
UNION ALL SELECT unnest(CASE WHEN k % 2 = 0 THEN ['RFI:' || (k + 1)] WHEN k % 8 = 1 THEN [] ELSE ['SUBMITTAL:S-' || (k + 1), 'SUBMITTAL:S-' || (k + 3)] END), name, 1 FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY way, name) AS place FROM r)
SELECT item, name, CASE WHEN way = 0 THEN 'PRIMARY' ELSE 'REFERENCE' END AS relation, place FROM n WHERE place <= 8 AND item <> 'RFI:12'""")
def item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every item: those that are about it first, then those that name it;
    eight at most (a report's limit)."""
    files = forms(spark, sf_dir)
    named = files.select("name", F.col("item").alias("own"), F.explode(R.workflow_items(F.col("text"))).alias("item"))
    named = named.where("item <> 'RFI:12'")  # the remark that every form carries
    ways = named.groupBy("item", "name").agg(F.min(F.when(F.col("own") == F.col("item"), 0).otherwise(1)).alias("way"))
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("item").orderBy("way", "name"))
    return ways.withColumn("place", place).where("place <= 8").select("item", "name", F.when(F.col("way") == 0, "PRIMARY").otherwise("REFERENCE").alias("relation"), "place")


@query("SELECT o_orderkey || '-' || c AS document_id, CASE WHEN o_orderkey % 2 = 1 THEN 'RFI_RESPONSE' ELSE 'SUBMITTAL' END AS document_type, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey AS VARCHAR) ELSE 'S-' || o_orderkey END AS identifier, CASE WHEN o_orderkey % 2 = 1 THEN 'MIXED' ELSE 'SUBMITTAL' END AS role, " + _STATUS_SQL.replace("o_orderstatus = 'F'", "o_orderstatus = 'F' AND c = 0") + " AS status FROM orders, (SELECT unnest([0, 1]) AS c) WHERE c = 0 OR o_orderkey % 10 = 3")
def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classify(forms(spark, sf_dir, spread=True)).select("document_id", "document_type", "identifier", "role", "status")


@query("SELECT o_orderkey || '-' || c AS document_id, unnest([{'role': 'SIZE', 'value': CAST(o_orderkey % 40 + 10 AS VARCHAR), 'unit': 'MM'}, {'role': 'LENGTH', 'value': (o_custkey % 9 + 1) || '.5', 'unit': 'METER'}], recursive := true) FROM orders, (SELECT unnest([0, 1]) AS c) WHERE c = 0 OR o_orderkey % 10 = 3")
def measured_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers paired with the property label nearest to them, both ways; the numbers of
    items and of other sentences are none."""
    last = F.element_at(F.split("text", "\n"), -1)
    reserved = F.transform(R._spans(F.col("last"), r"\brfi\s+\d+", "ITEM"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    found = forms(spark, sf_dir).select("document_id", last.alias("last")).select("document_id", F.inline(R.measured(F.col("last"), reserved)))
    return found.where("unit IS NOT NULL")


# Claim checks: every fifth form's claim states one value wrongly.


def _wrong(right: Column, wrong: str) -> Column:
    return F.when(_k() % 5 == 0, F.lit(wrong)).otherwise(right.cast("string"))


def _check(name: str, claim: Callable[[], Column], said: R.Reader, shown: R.Reader, wrong: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = forms(spark, sf_dir).select("o_orderkey", "text")
        claims = table(spark, sf_dir, "orders").select("o_orderkey", claim().alias("text"))
        return R.unsupported(claims, sources, "o_orderkey", said, shown)

    run.__name__ = name
    run.__doc__ = "Values that a claim states and its sources do not show."
    query(f"SELECT o_orderkey, '{wrong}' AS value FROM orders WHERE o_orderkey % 5 = 0")(run)


_first = lambda table_of: "|".join(table_of.values())
_check("unsupported_revisions", lambda: _line("It follows revision no. ", _wrong(_c() % 6, "99"), "."), R.revisions, R.revisions, "99")
_check("unsupported_drawings", lambda: _line("Shown on sheet S", _wrong(_c() % 50, "77.7"), " only."), R.drawings, R.drawings, "S77.7")
_check("unsupported_clauses", lambda: _line("As clause 4.", _wrong(_c() % 9 + 1, "88"), "a says."), R.clauses, R.clauses, "CLAUSE:4.88A")
_check("unsupported_sections", lambda: F.when(_k() % 5 == 0, "Under section 09 91 23 it holds.").when(_k() % 4 < 2, _line("Under section 03 30 ", _k() % 90 + 10, " it holds.")).otherwise("It holds."), R.sections, R.sections, "099123")
_check("unsupported_subjects", lambda: _line("Subject: ", _wrong(_line("Works of customer ", _c()), "Another matter"), "."), R.stated("subject", 500), R.labelled("subject", 500), "Another matter")
_check("unsupported_parties", lambda: _line("It is so; assigned to: ", _wrong(_line("Crew ", _c() % 11), "Nobody"), "; submitted by: Writer ", _c() % 17), R.stated(_first(PARTY)), R.labelled(_first(PARTY)), "Nobody")
_check("unsupported_actions", lambda: _line("Next action: ", _wrong(_line("Send part ", _k() % 9), "Wait"), "."), R.stated(_first(ACTION), 1000), R.labelled(_first(ACTION), 1000), "Wait")
_check("unsupported_metadata", lambda: _line("Discipline: Trade ", _c() % 7, "; Cost impact: ", _wrong(_line(_k() % 900, " USD"), "9999 USD"), "."), R.stated(_first(METADATA | IMPACT)), R.labelled(_first(METADATA | IMPACT)), "9999 USD")
_check("unsupported_generic", lambda: _line("The widget code: ", _wrong(_line("W", _k()), "W-0"), "."), R.stated("widget code"), R.labelled("widget code"), "W-0")
_check("unsupported_relations", lambda: F.when(_k() % 5 == 0, F.lit("It relates to RFI 00777777777.")).when(_is_rfi(), F.lit("It relates to nothing.")).otherwise(_line("It relates to RFI ", _k() + 1, ".")), R.workflow_items, R.workflow_items, "RFI:777777777")
_check("unsupported_items", lambda: F.when(_k() % 5 == 0, F.lit("Submittal S-000X1 is closed.")).when(_is_rfi(), _line("RFI 000", _k(), " is closed.")).otherwise(_line("Submittal S-", _k(), " is closed.")), R.workflow_items, R.workflow_items, "SUBMITTAL:S-000X1")
_check("unsupported_measures", lambda: _line("Its length is ", _wrong(_line(_c() % 9 + 1, ".5"), "11.25"), " m."), lambda t: F.transform(R.measured(t), lambda x: F.concat_ws(" ", x["role"], x["value"], x["unit"])), lambda t: F.transform(R.measured(F.element_at(F.split(t, "\n"), -1)), lambda x: F.concat_ws(" ", x["role"], x["value"], x["unit"])), "LENGTH 11.25 METER")
