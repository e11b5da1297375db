"""Questions over e-mails: headers, threads, attachments and the items they name.

Every event is written out as a message and read back; the SQL states what went in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locatext.functions import lexing as L
from locatext.operators import fields as R
from locatext.registry import query
from locatext.session import table

#: Files of a thread that one answer lists.
THREAD_FILES = 8


def _id() -> Column:
    return F.col("event_id")


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, name, text): one message an event. Messages of a user answer the one
    before in runs of four; every fifth quotes it, every third is signed."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    answers = _id() % 4 != 0
    lines = [
        _said("From: Person ", F.col("user_id"), " <p", F.col("user_id"), "@site.example>"),
        _said("To: Desk <desk", _id() % 3, "@site.example>, Other <o@site.example>"),
        F.when(_id() % 2 == 0, _said("Cc: q", _id() % 5, "@site.example")),
        _said("Subject: ", F.when(answers, "RE: ").otherwise(""), "RFI No. 00", _id() % 50, " on ", F.col("event_type")),
        _said("Date: Mon, 0", _id() % 9 + 1, " Jan 2024 10:00:00 +0000"),
        _said("Message-ID: <m", _id(), "@site.example>"),
        F.when(answers, _said("In-Reply-To: <M", _id() - 1, "@SITE.example>")),
        F.when(_id() % 6 == 0, _said("Attachment: plan", _id() % 40, ".pdf")),
        F.lit(""),
        _said("Please see submittal S-", _id() % 30, " for this."),
        _said("Action required: Call back ", _id() % 7),
        F.when(_id() % 3 == 0, _said("-- \nPerson ", F.col("user_id"), "\nSubmittal S-900 team")),
        F.when(_id() % 5 == 0, _said("On Monday somebody wrote:\n> Action required: Nothing\n> RFI 4444")),
    ]
    return e.select("event_id", _said("mail", _id(), ".eml").alias("name"), F.concat_ws("\n", *lines).alias("text"))


def body(text: Column) -> Column:
    """What a message itself says: no headers, no quoted history, no signature."""
    said = F.regexp_replace(text, r"(?s)^.*?\n\n", "")
    said = F.regexp_replace(said, r"(?sd)(?:^|\n)On [^\n]{1,200} wrote:\n.*$", "")
    return F.regexp_replace(F.regexp_replace(said, r"(?sd)(?:^|\n)-- \n.*$", ""), r"(?md)^>.*$", "")


def _headers(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^(.*?)(?:\n\n|$)", 1)


HEADERS = {"FROM": "from", "TO": "to", "CC": "cc", "SUBJECT": "subject", "DATE": "date"}


@query("""SELECT 'mail' || event_id || '.eml' AS name, unnest([
{'role': 'FROM', 'value': 'Person ' || user_id || ' <p' || user_id || '@site.example>'},
{'role': 'TO', 'value': 'Desk <desk' || event_id % 3 || '@site.example>, Other <o@site.example>'},
{'role': 'SUBJECT', 'value': CASE WHEN event_id % 4 <> 0 THEN 'RE: ' ELSE '' END || 'RFI No. 00' || event_id % 50 || ' on ' || event_type},
{'role': 'DATE', 'value': 'Mon, 0' || (event_id % 9 + 1) || ' Jan 2024 10:00:00 +0000'}], recursive := true) FROM events
UNION ALL SELECT 'mail' || event_id || '.eml', 'CC', 'q' || event_id % 5 || '@site.example' FROM events WHERE event_id % 2 = 0""")
def mail_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header values of every message, by header; lines of the body are none."""
    readers = {role: R.labelled(p, 500) for role, p in HEADERS.items()}
    return R.read_fields(mails(spark, sf_dir).select("name", _headers(F.col("text")).alias("text")), readers, ["name"])


@query("SELECT 'mail' || event_id || '.eml' AS name, 'ACTION_REQUIRED' AS role, 'Call back ' || event_id % 7 AS value FROM events")
def mail_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action fields of the message's own body: what it quotes or signs with is not read."""
    readers = {"ACTION_REQUIRED": R.labelled(r"action\s+required|required\s+action", 1000)}
    return R.read_fields(mails(spark, sf_dir).select("name", body(F.col("text")).alias("text")), readers, ["name"])


@query("SELECT event_id, sum(CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 3 ELSE 0 END) AS signature_lines FROM events GROUP BY event_id")
def signature_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the signature takes: all from its first line on."""
    lines = mails(spark, sf_dir).select("event_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return R.signature_parts(lines, "event_id", "n", "line").groupBy("event_id").agg(F.count_if(F.col("part") == "SIGNATURE").alias("signature_lines"))


def _named(text: Column, primary: Column) -> DataFrame:
    return F.explode(F.transform(R.workflow_items(text), lambda x: F.struct(x.alias("item"), F.when(x == primary, "PRIMARY").otherwise("REFERENCE").alias("relation")))).alias("r")


def _mail_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mails(spark, sf_dir).withColumns({"head": _headers(F.col("text")), "said": body(F.col("text"))})
    subject = F.get(R.labelled("subject", 500)(F.col("head")), F.lit(0))
    m = m.withColumns({"subject": subject, "primary": F.get(R.workflow_items(subject), F.lit(0))})
    read = F.concat_ws("\n", "subject", "said")
    pairs = m.select("name", read.alias("read"), _named(read, F.col("primary")))
    # A relation needs its quote: the line of the message that names the item.
    number = F.regexp_extract("r.item", "[^:]*$", 0)
    quote = F.filter(F.split("read", "\n"), lambda line: F.array_contains(R.workflow_items(line), F.col("r.item")))
    return pairs.select("name", "r.item", "r.relation", F.get(quote, F.lit(0)).alias("quote"), number.alias("number")).where("quote IS NOT NULL").drop("number")


_MAIL_ITEMS = """SELECT 'mail' || event_id || '.eml' AS name, unnest([
{'item': 'RFI:' || event_id % 50, 'relation': 'PRIMARY', 'quote': CASE WHEN event_id % 4 <> 0 THEN 'RE: ' ELSE '' END || 'RFI No. 00' || event_id % 50 || ' on ' || event_type},
{'item': 'SUBMITTAL:S-' || event_id % 30, 'relation': 'REFERENCE', 'quote': 'Please see submittal S-' || event_id % 30 || ' for this.'}], recursive := true) FROM events"""


@query(_MAIL_ITEMS)
def mail_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a message is about (its subject) or refers to, each with its quote;
    quoted history and signatures relate nothing."""
    return _mail_items(spark, sf_dir)


@query(f"SELECT item, relation, count(*) AS mails, min(name) AS first_name FROM ({_MAIL_ITEMS}) GROUP BY item, relation")
def item_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item the messages that quote it."""
    return _mail_items(spark, sf_dir).groupBy("item", "relation").agg(F.count("*").alias("mails"), F.min("name").alias("first_name"))


@query("SELECT 'mail' || event_id || '.eml' AS name, 'mail' || (event_id - event_id % 4) || '.eml' AS thread, event_id % 4 + 1 AS place FROM events")
def mail_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thread of every message, eight files at most: messages are linked by
    Message-ID and In-Reply-To (trimmed, any case). Replies point backwards in runs of
    four, so two doublings of the parent reach every root."""
    key = lambda label: F.lower(F.trim(F.get(R.labelled(label, 500)(F.col("head")), F.lit(0))))
    m = mails(spark, sf_dir).select("event_id", "name", _headers(F.col("text")).alias("head"))
    m = m.select("event_id", "name", key("message-id").alias("id"), key("in-reply-to").alias("parent"))
    known = m.select(F.col("id").alias("parent"), F.lit(True).alias("here"))
    up = m.join(known, "parent", "left").select("event_id", "name", "id", F.when(F.col("here"), F.col("parent")).otherwise(F.col("id")).alias("root"))
    for _ in range(2):
        above = up.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        up = up.join(above, "root").select("event_id", "name", "id", F.col("higher").alias("root"))
    roots = up.select(F.col("id").alias("root"), F.col("name").alias("thread"))
    place = F.row_number().over(W.partitionBy("thread").orderBy("event_id"))
    return up.join(roots, "root").withColumn("place", place).where(F.col("place") <= THREAD_FILES).select("name", "thread", "place")


@query("SELECT 'plan' || event_id % 40 || '.pdf' AS attachment, list_sort(list('mail' || event_id || '.eml')) AS mails, count(*) > 1 AS shared FROM events WHERE event_id % 6 = 0 GROUP BY event_id % 40")
def mail_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments with the messages they came with; a name that several messages carry
    is marked, as it may be several files."""
    found = R.read_fields(mails(spark, sf_dir).select("name", _headers(F.col("text")).alias("text")), {"A": R.labelled("attachment", 500)}, ["name"])
    return found.groupBy(F.col("value").alias("attachment")).agg(F.array_sort(F.collect_list("name")).alias("mails"), (F.count("*") > 1).alias("shared"))


@query("SELECT event_id, 'another matter' AS value FROM events WHERE event_id % 5 = 0")
def unsupported_mail_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that a claim gives and the message does not have; reply marks and case
    do not count."""
    plain = lambda x: F.lower(F.trim(F.regexp_replace(L.collapse(x), r"(?i)^(?:(?:re|fwd?)\s*:\s*)+", "")))
    m = mails(spark, sf_dir).select("event_id", _headers(F.col("text")).alias("text"))
    right = F.get(R.labelled("subject", 500)(F.col("text")), F.lit(0))
    claims = m.select("event_id", _said("The email subject: ", F.when(_id() % 5 == 0, "Another matter").otherwise(F.upper(right)), ".").alias("text"))
    return R.unsupported(claims, m, "event_id", lambda t: F.transform(R.stated("email subject", 500)(t), plain), lambda t: F.transform(R.labelled("subject", 500)(t), plain))


@query("SELECT event_id, 'FROM:nobody' AS value FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 'TO:somebody' FROM events WHERE event_id % 11 = 0")
def unsupported_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders and recipients that a claim names and the message's headers do not."""
    m = mails(spark, sf_dir).select("event_id", _headers(F.col("text")).alias("text"))
    sender = F.regexp_extract("text", r"(?md)^From: ([^<\n]*?) <", 1)
    claims = m.select("event_id", _said("Sender: ", F.when(_id() % 7 == 0, "Nobody").otherwise(sender), "; recipient: ", F.when(_id() % 11 == 0, "Somebody").otherwise("Desk")).alias("text"))

    def names(role: str, found: Column) -> Column:
        parts = F.flatten(F.transform(found, lambda x: F.split(x, ",")))
        return F.transform(parts, lambda x: F.concat(F.lit(role + ":"), F.lower(F.trim(F.regexp_replace(x, "<[^>]*>", "")))))

    said = lambda t: F.concat(names("FROM", R.stated("sender")(t)), names("TO", R.stated("recipients?")(t)))
    shown = lambda t: F.concat(names("FROM", R.labelled("from", 500)(t)), names("TO", R.labelled("to", 500)(t)))
    return R.unsupported(claims, m, "event_id", said, shown)


@query("""WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN 'S' || event_id END AS section, CASE WHEN event_id % 4 = 1 THEN 'P' || event_id % 3 END AS part FROM events),
w AS (SELECT *, count(section) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT event_id, last_value(section IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section_now, last_value(part IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS part_now FROM w""")
def inherited_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section and part carried from page to page of a document (here: a user's events);
    a new section ends the part before it."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(_id() % 9 == 0, _said("S", _id())).alias("section"), F.when(_id() % 4 == 1, _said("P", _id() % 3)).alias("part"))
    return R.inherit(rows, ["user_id"], ["event_id"], ["section", "part"], {"part": "section"}).select("event_id", "section_now", "part_now")
