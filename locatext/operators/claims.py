"""Claim support: values a claim states must stand in what it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Value families by pattern; one capture group or the whole match is the value.
FAMILIES = {
    "section": "[0-9]{2} [0-9]{2} [0-9]{2}",
    "drawing": "[A-Z]{1,2}-?[0-9]{1,3}[.][0-9]{1,2}",
    "clause": "[0-9]+[.][0-9]+[.][A-Z]",
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+",
    "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "number": "[0-9]+(?:[.][0-9]+)?",
}


def values(text: Column, family: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(FAMILIES[family]), F.lit(0)))


def unsupported(claims: DataFrame, citations: DataFrame, key: str, family: str, text: str = "text") -> DataFrame:
    """(key, value) that claims state and no citation of the key has (anti-join)."""
    said = claims.select(key, F.explode(values(F.col(text), family)).alias("value")).distinct()
    cited = citations.select(key, F.explode(values(F.col(text), family)).alias("value")).distinct()
    return said.join(cited, [key, "value"], "left_anti")


def disposition(text: Column) -> Column:
    """First phrase of the status table that the text has; negations come first."""
    table = [("not approved|rejected|disapproved|denied", "REJECTED"), ("not closed", "NOT_CLOSED"), ("approved as noted|approved with comments|make corrections noted", "APPROVED_AS_NOTED"), ("revise and resubmit|revise/resubmit|amend and resubmit|returned for correction", "REVISE_AND_RESUBMIT"), ("approved|accepted|no exceptions taken", "APPROVED"), ("under review|for review|pending", "PENDING"), ("submitted", "SUBMITTED"), ("closed|resolved", "CLOSED"), ("open|unresolved|outstanding", "OPEN"), ("answered", "ANSWERED"), ("void|voided|cancelled|canceled", "VOID"), ("draft", "DRAFT")]
    out = None
    for pattern, name in table:
        hit = F.lower(text).rlike(f"(^|[^a-z])({pattern})([^a-z]|$)")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
