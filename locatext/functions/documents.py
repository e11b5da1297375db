"""Document-level readers as Column expressions: workflow references, parts of
questions, units, date roles, display and safety of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units by name, with the forms that stand for them after a number.
UNITS = {"INCH": "inch(?:es)?|in[.]", "FOOT": "feet|foot|ft", "MM": "mm|millimeters?", "CM": "cm|centimeters?", "PSI": "psi", "GPM": "gpm", "PERCENT": "percent|%", "POUND": "pounds?|lbs?", "KG": "kgs?|kilograms?"}
DATE_ROLES = {"DUE": "due", "ISSUED": "issued?|issue date", "SUBMITTED": "submitted", "RECEIVED": "received", "SENT": "sent", "REVIEWED": "reviewed", "APPROVED": "approved", "RESPONSE": "answered|responded"}


def workflow_references(text: Column) -> Column:
    """Every RFI or submittal mentioned, as ``KIND id``, once each; e-mail addresses are
    taken out first."""
    bare = F.regexp_replace(F.lower(text), "[a-z0-9._%+-]+@[a-z0-9.-]+", " ")
    found = F.regexp_extract_all(bare, F.lit("((?:rfi|submittal) #?[a-z0-9._/-]*[0-9][a-z0-9]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.upper(F.regexp_replace(x, "#", ""))))


def answer_parts(question: Column, limit: int = 12) -> Column:
    """Parts of a question cut at semicolons and sentence ends; the whole where that
    gives fewer than two or more than ``limit``."""
    parts = F.filter(F.transform(F.split(question, "[;?.] *"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts).between(2, limit), parts).otherwise(F.array(F.trim(question)))


def with_unit(text: Column) -> Column:
    """(number, unit) of every number followed by a known unit."""
    forms = "|".join(UNITS.values())
    raw = F.regexp_extract_all(F.lower(text), F.lit(f"([0-9]+(?:[.][0-9]+)? ?(?:{forms}))(?:[^a-z]|$)"), F.lit(1))

    def unit(x: Column) -> Column:
        tail, out = F.trim(F.regexp_replace(x, "^[0-9.]+", "")), None
        for name, form in UNITS.items():
            hit = tail.rlike(f"^(?:{form})$")
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    return F.transform(raw, lambda x: F.struct(F.regexp_extract(x, "^[0-9]+(?:[.][0-9]+)?", 0).alias("number"), unit(x).alias("unit")))


def date_role(text: Column) -> Column:
    """Role named directly before the first ISO date."""
    before = F.lower(F.regexp_extract(text, "^(.*?)[0-9]{4}-[0-9]{2}-[0-9]{2}", 1))
    out = None
    for name, form in DATE_ROLES.items():
        hit = before.rlike(f"(?:^|[^a-z])(?:{form})(?: date| on| is| was)*[ :=-]*$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def clip_bytes(text: Column, limit: int) -> Column:
    """Longest prefix of at most ``limit`` UTF-8 bytes. ``limit`` bytes hold at least a
    quarter as many characters; the rest is found from the sizes of the prefixes."""
    start = F.substring(text, F.lit(1), F.lit(limit))
    sizes = F.transform(F.sequence(F.lit(limit // 4), F.lit(limit)), lambda n: F.struct(n.alias("n"), F.octet_length(F.substring(start, F.lit(1), n)).alias("b")))
    best = F.array_max(F.transform(F.filter(sizes, lambda s: s["b"] <= limit), lambda s: s["n"]))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(start, F.lit(1), best))


def context_window(text: Column, needle: str, chars: int) -> Column:
    """Text around the first hit of ``needle``, ``chars`` characters in all."""
    at = F.locate(needle, F.lower(text))
    start = F.greatest(F.lit(1), at - chars // 2)
    return F.when(at > 0, F.substring(text, start, F.lit(chars)))


def safe_name(name: Column) -> Column:
    """File name without folders and characters that file systems refuse."""
    last = F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1)
    return F.regexp_replace(last, "[^A-Za-z0-9._ -]", "_")


def scrubbed(text: Column) -> Column:
    """Values of secrets masked in diagnostics."""
    return F.regexp_replace(text, '(?i)((?:token|secret|password|api[_-]?key) *[:=] *"?)[A-Za-z0-9_+/=-]{8,}', "$1***")


def humanised(key: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(key, "([a-z])([A-Z])", "$1 $2"), "[_-]+", " ")))
