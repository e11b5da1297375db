"""Text functions as Column expressions: all run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locatext.functions import vocab


def plain_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(text: Column, limit: int = vocab.LIMITS["query_terms"]) -> Column:
    """Distinct terms in order: no stop words, two characters or a digit at least."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:[-./][a-z0-9]+)*"), F.lit(0))
    stop = F.array(*map(F.lit, vocab.STOP_WORDS))
    good = F.filter(words, lambda w: ~F.array_contains(stop, w) & ((F.length(w) >= 2) | w.rlike("^[0-9]+$")))
    return F.slice(F.array_distinct(good), 1, limit)


def rfi_variants(number: Column, limit: int = vocab.LIMITS["search_terms"]) -> Column:
    """Search forms of a numeric identifier: as it is, then with 1, 2, ... leading zeros."""
    bare = F.regexp_replace(number, "^0+(?=.)", "")
    zeros = F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda n: F.concat(F.repeat(F.lit("0"), n), bare))
    numbers = F.array_distinct(F.concat(F.array(number), zeros))
    prefixes = F.array(*map(F.lit, vocab.RFI_PREFIXES))
    return F.slice(F.flatten(F.transform(numbers, lambda n: F.transform(prefixes, lambda p: F.concat(p, n)))), 1, limit)


def rfi_forms(*numbers: Column) -> Column:
    """Search forms of these numbers only: each prefix before the first, then the next."""
    return F.array(*[F.concat(F.lit(p), n) for n in numbers for p in vocab.RFI_PREFIXES])


def word_forms(term: Column) -> Column:
    """A term and its simple forms: -ness and -s dropped, -ies to -y, parts of compounds."""
    return F.array_distinct(
        F.concat(
            F.array(term),
            F.when(term.endswith("ness") & (F.length(term) > 6), F.array(term.substr(F.lit(1), F.length(term) - 4))).otherwise(F.array().cast("array<string>")),
            F.when(term.endswith("ies") & (F.length(term) > 4), F.array(F.concat(term.substr(F.lit(1), F.length(term) - 3), F.lit("y"))))
            .when(term.endswith("s") & ~term.endswith("ss") & (F.length(term) > 3), F.array(term.substr(F.lit(1), F.length(term) - 1)))
            .otherwise(F.array().cast("array<string>")),
            F.when(term.contains("-"), F.split(term, "-")).otherwise(F.array().cast("array<string>")),
        )
    )


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))


def fold_dashes(text: Column) -> Column:
    return F.translate(text, vocab.DASHES, "-" * len(vocab.DASHES))



def rfi_identifier(text: Column) -> Column:
    """Upper-cased identifier after the label and number sign; digits lose leading
    zeros; null without a digit or where an e-mail address goes on from it."""
    up = collapse(F.upper(fold_dashes(text)))
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.regexp_replace(up, "^RFI([^A-Z0-9_]|$)", "$1")), "^(NO[.]?|NUMBER)([^A-Z0-9_]|$)", "$2")), "^[ #:.-]+", "")
    found = F.regexp_replace(F.regexp_extract(bare, "^[A-Z0-9]+([._/-][A-Z0-9]+)*", 0), "[._/-]+$", "")
    ok = found.rlike("[0-9]") & ~bare.rlike("^[A-Z0-9._/%+-]*@")
    return F.when(ok, F.when(found.rlike("^[0-9]+$"), F.regexp_replace(found, "^0+([0-9])", "$1")).otherwise(found))


def submittal_status(text: Column) -> Column:
    said = F.regexp_replace(collapse(F.upper(text)), " ?/ ?", "/")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in vocab.SUBMITTAL_STATUS.items() for x in kv]), said), said)


def only_value(values: Column) -> Column:
    """The value all agree on; null if there is none or more than one."""
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, distinct[0])


def message_key(header: Column) -> Column:
    return F.concat(F.lit("MSG-"), F.sha2(F.lower(F.trim(header)), 256).substr(1, 24))


def csi_sections(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]{2} [0-9]{2} [0-9]{2}"), F.lit(0)))


def number_literals(text: Column) -> Column:
    """Canonical decimals: no thousands commas, leading or trailing zeros."""
    raw = F.regexp_extract_all(text, F.lit("[0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?"), F.lit(0))
    plain = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), "^0+([0-9])", "$1"))
    return F.transform(plain, lambda x: F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), "[.]$", "")).otherwise(x))


def source_family(file_name: Column, text: Column) -> Column:
    """First family whose mark is in the name or opens the text."""
    name, said = F.lower(file_name), F.lower(F.ltrim(text))
    return (
        F.when(name.like("%.eml") | name.like("%.msg") | ((said.startswith("from:") | said.startswith("to:") | said.startswith("cc:") | said.startswith("subject:")) & said.contains("subject:")), "EMAIL")
        .when(said.startswith("rfi ") | said.startswith("request for information ") | name.contains("rfi"), "RFI")
        .when(said.startswith("submittal ") | said.startswith("submission ") | name.contains("submittal"), "SUBMITTAL")
        .when(name.contains("spec"), "SPECIFICATION")
        .when(name.like("%.dwg") | name.like("%.dxf") | name.contains("sheet") | said.startswith("sheet ") | said.startswith("drawing ") | said.startswith("detail "), "DRAWING")
        .otherwise("OTHER")
    )


def page_type(words: Column, chars: Column, graphics: Column) -> Column:
    """Route of a page by how much text and drawing it has."""
    return F.when((words == 0) & (graphics == 0), "BLANK").when((words < 20) | (chars < 80), "GRAPHIC_OR_SCAN").when((graphics > 200) & (words < 250), "DRAWING").when(graphics > 200, "MIXED").otherwise("TEXT_PAGE")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the compact JSON of the columns, in their order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def compact_decimal(value: Column) -> Column:
    """Decimal as text without trailing zeros."""
    said = value.cast("string")
    return F.when(said.contains("."), F.regexp_replace(F.regexp_replace(said, "0+$", ""), "[.]$", "")).otherwise(said)


def safe_rate(part: Column, whole: Column) -> Column:
    """Null, not zero, where there is nothing to divide by."""
    return F.when(whole != 0, part / whole)


def source_text(content_basis: Column, extraction_method: Column) -> Column:
    """True for source text; narration by a model is none. Null counts as source."""
    return (F.coalesce(content_basis, F.lit("")) != "MODEL_VISION_OUTPUT") & (F.coalesce(extraction_method, F.lit("")) != "VISION")


def property_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
