"""Readers of labelled lines, identifiers and measures, as Column expressions, and the
answers and claim checks made from them. Every reader gives an array of values in the
order of the text; several values are for the caller to report as a conflict."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locatext.functions import vocab

Reader = Callable[[Column], Column]


def labelled(label: str, longest: int = 200) -> Reader:
    """Values of the lines ``label: value`` (the label is a pattern, any case)."""
    pattern = rf"(?imd)^[ \t]*(?:{label})[ \t]*:[ \t]*([^\r\n]{{1,{longest}}}?)[ \t]*$"
    return lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def stated(label: str, longest: int = 200) -> Reader:
    """Values that running text states as ``label: value``, up to the end of the clause."""
    pattern = rf"(?i)\b(?:{label})\s*:\s*([^\r\n;]{{1,{longest}}}?)(?=[.]?(?:$|[\r\n;]))"
    return lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def block(label: str, others: str) -> Reader:
    """The text after ``label:``, inline or on the lines below, up to the next label."""
    pattern = rf"(?isd)(?:^|\n)[ \t]*(?:{label})[ \t]*:[ \t]*\n?(.*?)(?=\n[ \t]*(?:{others})[ \t]*:|$)"
    return lambda text: F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def _dashes(text: Column) -> Column:
    return F.translate(text, vocab.DASHES, "-" * len(vocab.DASHES))


def _matches(pattern: str, group: int = 0) -> Reader:
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


_DATE_SHAPE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"


def drawings(text: Column) -> Column:
    """Identifiers after sheet, drawing, dwg or detail: upper case, plain dashes; dates
    and labels over 32 characters are none."""
    pattern = r"(?i)(?:\bsheet\b|\bdrawing\b|\bdwg\b\.?|\bdetail\b)(?:\s+(?:(?:no\.?|number)\s*)?|\s*[:#=-]\s*)((?=[a-z0-9._/-]*\d)[a-z0-9]+(?:[._/-][a-z0-9]+)*)(?!\w)"
    found = F.transform(_matches(pattern, 1)(_dashes(text)), F.upper)
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) <= 32) & ~x.rlike(_DATE_SHAPE)))


def clauses(text: Column) -> Column:
    """``KIND:number`` of paragraphs, clauses and articles; date-shaped numbers are none."""
    pattern = r"(?i)\b(?:paragraph|para\.?|clause|article)\b\.?(?:\s+(?:(?:no\.?|number)\s*)?|\s*[:#=-]\s*)\d{1,3}(?:\.\d{1,3}){1,5}[a-z]?(?!\w)(?!\.\d)"

    def name(x: Column) -> Column:
        kind = F.when(F.lower(x).startswith("para"), "PARAGRAPH").otherwise(F.upper(F.regexp_extract(x, "^[A-Za-z]+", 0)))
        return F.concat(kind, F.lit(":"), F.upper(F.regexp_extract(x, r"\d[0-9.]*[A-Za-z]?$", 0)))

    found = F.transform(_matches(pattern)(text), name)
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike(r":\d{4}\.\d{1,2}\.\d{1,2}$")))


def revisions(text: Column) -> Column:
    """Revision labels: anything after "revision no." or a separator, else a single
    letter, a number, a code with a digit, or IFC, IFB and AS-BUILT."""
    prefix = r"(?:\brevision\b|\brev\b\.?)"
    strong = rf"(?i){prefix}(?:\s+(?:no\.?|number)\s*|\s*[:#=-]\s*)([a-z0-9][a-z0-9._/-]{{0,20}})(?!\w)"
    weak = rf"(?i){prefix}\s+((?:ifc|ifb|as[- ]built|(?=[a-z0-9._/-]*\d)[a-z0-9]+(?:[._/-][a-z0-9]+)*|[a-z]|\d+))(?!\w)"
    plain = _dashes(text)
    found = F.transform(F.concat(_matches(strong, 1)(plain), _matches(weak, 1)(plain)), lambda x: F.rtrim(F.regexp_replace(F.upper(x), "[.]+$", "")))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin("DATE", "STATUS", "CURRENT", "NO", "NUMBER") & ~x.rlike(_DATE_SHAPE)))


_SECTION = r"(?i)(?<!\w)(?:section|csi(?:\s+section)?|spec(?:ification)?(?:\s+section)?)\s*[:#-]?\s*"


def sections(text: Column) -> Column:
    """Specification sections after their label: six digits (and an extension), or the
    five of the older scheme; digits only."""
    six = _SECTION + r"(\d{2}(?:\s+|\s*[.-]\s*)\d{2}(?:\s+|\s*[.-]\s*)\d{2}(?:\.\d{2})?)(?!\w)(?!\.\d)"
    five = _SECTION + r"(\d{5})(?!\w)(?![.-]\d)"
    return F.array_distinct(F.concat(F.transform(_matches(six, 1)(text), lambda x: F.regexp_replace(x, "[ .-]", "")), _matches(five, 1)(text)))


def workflow_items(text: Column) -> Column:
    """``RFI:id`` and ``SUBMITTAL:id`` of every item that the text names; numbers lose
    leading zeros and e-mail addresses are not read."""
    bare = F.regexp_replace(_dashes(text), r"\S+@\S+", " ")
    label = r"(?:\s+(?:no\.?|number))?\s*[#:.-]*\s*"
    rfi = _matches(rf"(?i)(?<![\w-])(?:rfi|request for information){label}([a-z0-9][a-z0-9._/-]{{0,30}})", 1)(bare)
    sub = _matches(rf"(?i)(?<![\w-])(?:submittal|submission){label}([a-z0-9][a-z0-9._/-]{{0,30}})", 1)(bare)

    def named(kind: str, found: Column) -> Column:
        ids = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.upper(x), "[._/-]+$", ""), "^0+(?=[0-9])", ""))
        return F.transform(F.filter(ids, lambda x: x.rlike("[0-9]")), lambda x: F.concat(F.lit(kind + ":"), x))

    return F.array_distinct(F.concat(named("RFI", rfi), named("SUBMITTAL", sub)))


# Canonical status by phrase, longest phrase first.
RFI_STATUS = {"NOT CLOSED": "OPEN", "CLOSED": "CLOSED", "ANSWERED": "ANSWERED", "OPEN": "OPEN", "VOID": "VOID", "DRAFT": "DRAFT"}

SUBMITTAL_STATUS = vocab.SUBMITTAL_STATUS | {v: v for v in vocab.SUBMITTAL_STATUS.values()}


def statuses(text: Column, table: Mapping[str, str]) -> Column:
    """Distinct canonical statuses of the ``Status:`` lines, sorted."""
    said = F.transform(labelled("(?:RFI |SUBMITTAL )?STATUS")(text), F.upper)
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_sort(F.array_distinct(F.filter(F.transform(said, lambda x: F.element_at(known, x)), lambda x: x.isNotNull())))


def _header(kind: str) -> str:
    return rf"(?imd)^[ \t]*(?:{kind})(?:[ \t]+(?:NO\.?|NUMBER))?[ \t]*[#:.-]*[ \t]*([A-Z0-9](?=[A-Z0-9._/-]*)[A-Z0-9._/-]{{0,30}})[ \t]*$"


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with document_type, workflow_type, identifier, role and status. A subject
    line that names an item beats the headers of the body; of those the first wins. The
    role is MIXED where a form both asks and answers; nothing known is UNKNOWN."""
    kinds = {"RFI": "RFI|REQUEST FOR INFORMATION", "SUBMITTAL": "SUBMITTAL|SUBMISSION"}
    t = F.col("__t")
    in_subject = {f"__subject_{k}": F.nullif(F.regexp_extract(t, rf"(?imd)^[ \t]*subject[ \t]*:[ \t]*(?:(?:re|fwd?)[ \t]*:[ \t]*)*(?:{p})(?:[ \t]+(?:no\.?|number))?[ \t]*[#:.-]*[ \t]*([A-Z0-9._/-]*[0-9][A-Z0-9._/-]*)", 1), F.lit("")) for k, p in kinds.items()}
    place = {f"__place_{k}": F.nullif(F.regexp_instr(t, F.lit(_header(p))), F.lit(0)) for k, p in kinds.items()}
    # Columns of their own: within one expression every mention of a match would search the text again.
    plain = F.when(F.col(text).rlike(f"[{vocab.DASHES}]"), _dashes(F.col(text))).otherwise(F.col(text))
    read = docs.withColumn("__t", plain).withColumns(in_subject | place)
    subject, at = ({k: F.col(f"__{name}_{k}") for k in kinds} for name in ("subject", "place"))
    first = F.when(at["RFI"].isNotNull() & (at["SUBMITTAL"].isNull() | (at["RFI"] < at["SUBMITTAL"])), "RFI").when(at["SUBMITTAL"].isNotNull(), "SUBMITTAL")
    typed = read.withColumn("workflow_type", F.when(subject["RFI"].isNotNull(), "RFI").when(subject["SUBMITTAL"].isNotNull(), "SUBMITTAL").otherwise(first))
    kind = F.col("workflow_type")
    said = {k: F.coalesce(subject[k], F.nullif(F.regexp_extract(t, _header(p), 1), F.lit(""))) for k, p in kinds.items()}
    identifier = F.regexp_replace(F.regexp_replace(F.upper(F.when(kind == "RFI", said["RFI"]).otherwise(said["SUBMITTAL"])), "[._/-]+$", ""), "^0+(?=[0-9])", "")
    asks, answers = (t.rlike(rf"(?imd)^[ \t]*(?:{p})[ \t]*:") for p in ("question|request", "response|answer|reply"))
    asked = typed.withColumns({"__asks": F.when(kind == "RFI", asks), "__answers": F.when(kind == "RFI", answers)})
    asks, answers = F.col("__asks"), F.col("__answers")
    role = F.when(kind == "SUBMITTAL", "SUBMITTAL").when(kind == "RFI", F.when(asks & answers, "MIXED").when(answers, "RESPONSE").when(asks, "QUESTION").otherwise("UNKNOWN"))
    status = F.when(kind == "RFI", F.array_join(statuses(t, RFI_STATUS), " / ")).when(kind == "SUBMITTAL", F.array_join(statuses(t, SUBMITTAL_STATUS), " / "))
    found = asked.withColumns({"identifier": F.when(kind.isNotNull(), identifier), "role": role, "status": F.nullif(status, F.lit(""))})
    kind_of = F.when(kind == "SUBMITTAL", "SUBMITTAL").when(F.col("role").isin("RESPONSE", "MIXED"), "RFI_RESPONSE").when(F.col("role") == "QUESTION", "RFI_QUESTION").when(kind.isNotNull(), "OTHER").otherwise("UNKNOWN")
    return found.withColumn("document_type", kind_of).drop("__t", *in_subject, *place, "__asks", "__answers")


def read_fields(docs: DataFrame, readers: Mapping[str, Reader], keys: list[str], text: str = "text") -> DataFrame:
    """(keys, role, value) of every reader's values, in one pass over the texts."""
    found = F.array(*[F.struct(F.lit(role).alias("role"), read(F.col(text)).alias("values")) for role, read in readers.items()])
    return docs.select(*keys, F.inline(found)).select(*keys, "role", F.explode("values").alias("value"))


def answer_items(fields: DataFrame, item: str = "item") -> DataFrame:
    """One answer for each item and role: ANSWERED with the value, or CONFLICT with the
    number of values that the files give and no value."""
    grouped = fields.groupBy(item, "role").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"), F.count_distinct("document_id").alias("files"))
    return grouped.select(item, "role", F.when(F.col("n") == 1, "ANSWERED").otherwise("CONFLICT").alias("status"), F.when(F.col("n") == 1, F.col("value")).alias("value"), "files")


def unsupported(claims: DataFrame, sources: DataFrame, key: str, said: Reader, shown: Reader, text: str = "text") -> DataFrame:
    """(key, value) that a claim states and none of the key's sources shows."""
    of = lambda df, read: df.select(key, F.explode(read(F.col(text))).alias("value")).distinct()
    return of(claims, said).join(of(sources, shown), [key, "value"], "left_anti")


def inherit(rows: DataFrame, by: list[str], order: list[str], values: list[str], resets: Mapping[str, str]) -> DataFrame:
    """Rows that lack a value take the last one before; where ``resets[value]`` names
    another column, a new value of that column starts over."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    for c in values:
        scope = [*by]
        if c in resets:
            rows = rows.withColumn(f"_{c}", F.count(resets[c]).over(w))
            scope.append(f"_{c}")
        own = W.partitionBy(*scope).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn(f"{c}_now", F.last(c, ignorenulls=True).over(own))
    return rows.drop(*[f"_{c}" for c in resets])


def signature_parts(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """``lines`` with ``part``: SIGNATURE from the first line "-- " (quoted or not) on."""
    starts = F.col(text).rlike(r"^(?:>\s*)*-- $")
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("part", F.when(F.max(starts.cast("int")).over(w) == 1, "SIGNATURE").otherwise("BODY"))


# Measured properties and units by pattern.
PROPERTIES = {
    "SIZE": r"\b(?:(?:nominal|pipe|tube|duct|conduit)\s+)?(?:size|diameter|dimensions?)\b",
    "THICKNESS": r"\b(?:thickness|thick)\b",
    "LENGTH": r"\b(?:length|long(?![-\s]+term\b))\b",
    "WIDTH": r"\b(?:width|wide)\b",
    "HEIGHT": r"\b(?:height|high(?!\s+pressure\b))\b",
    "DEPTH": r"\b(?:depth|deep)\b",
    "QUANTITY": r"\b(?:quantity|quantities|qty|count)\b",
    "PRESSURE": r"\bpressure\b",
    "STRENGTH": r"\bstrength\b",
    "FLOW": r"\bflow(?:\s+rate)?\b",
    "CAPACITY": r"\bcapacity\b",
    "TEMPERATURE": r"\btemperature\b",
    "WEIGHT": r"\bweight\b",
}
UNITS = {
    "INCH": r"inch(?:es)?|in\.",
    "FOOT": r"feet|foot|ft\.?",
    "MM": r"millimeters?|mm",
    "CM": r"centimeters?|cm",
    "METER": r"meters?|m",
    "PSI": r"psi",
    "KPA": r"kpa",
    "MPA": r"mpa",
    "BAR": r"bar",
    "GPM": r"gpm",
    "CFM": r"cfm",
    "LPM": r"lpm",
    "LPS": r"l\s*/\s*s",
    "PERCENT": r"percent|%",
    "POUND": r"pounds?|lbs?",
    "KG": r"kilograms?|kgs?",
    "TON": r"tons?",
    "FAHRENHEIT": r"°\s*f|deg(?:ree)?s?\s*f",
    "CELSIUS": r"°\s*c|deg(?:ree)?s?\s*c",
}
_NUMBER = r"(?<![\w.])\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\w)|(?<![\w.])\d+(?:\.\d+)?(?=\W|$|[A-Za-z])"


def _spans(text: Column, pattern: str, name: str) -> Column:
    """(name, value, start, end) of all matches: the text is cut at them, and lengths of
    the parts add up to places."""
    kind = "array<struct<name:string,value:string,s:int,e:int>>"
    cut = F.struct(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0)).alias("found"), F.split(text, f"(?i){pattern}").alias("between"))

    def spans(z: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(F.get(z["between"], i))
            e = s + F.length(F.get(z["found"], i))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(name).alias("name"), F.get(z["found"], i).alias("value"), s.alias("s"), e.alias("e")))).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {kind})").alias("out"))
        return F.when(F.size(z["found"]) == 0, F.expr(f"CAST(array() AS {kind})")).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(z["found"]) - 1), start, step)["out"])

    return _once(cut, spans)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), lambda z: use(z))[0]


def distance(a: Column, b: Column) -> Column:
    return F.greatest(a["s"] - b["e"], b["s"] - a["e"], F.lit(0))


def measured(text: Column, reserved: Column | None = None, reach: int = 64) -> Column:
    """(role, value, unit) where a number and a property's label of one statement are
    nearest to each other and within ``reach``. Numbers inside ``reserved`` spans
    (array of s, e: identifiers, dates, sections) are none."""
    numbers = _spans(text, _NUMBER, "NUMBER")
    if reserved is not None:
        numbers = F.filter(numbers, lambda n: ~F.exists(reserved, lambda r: (r["s"] <= n["s"]) & (n["e"] <= r["e"])))
    labels = F.flatten(F.array(*[_spans(text, p, role) for role, p in PROPERTIES.items()]))

    def unit_after(end: Column) -> Column:
        def named(after: Column) -> Column:
            unit = None
            for name, p in UNITS.items():
                hit = after.rlike(rf"(?i)^\s*-?\s*(?:{p})(?=$|[\s,.;:)\]])")
                unit = F.when(hit, name) if unit is None else unit.when(hit, name)
            return unit

        return _once(text.substr(end + 1, F.lit(24)), named)

    def pairs(z: Column) -> Column:
        def pair(n: Column) -> Column:
            near = F.array_sort(F.filter(F.transform(z["labels"], lambda x: F.struct(distance(n, x).alias("d"), x["name"].alias("role"), x["s"].alias("s"), x["e"].alias("e"))), lambda x: x["d"] <= reach))

            def choose(found: Column) -> Column:
                best = F.get(found, F.lit(0))
                tied = F.exists(found, lambda x: (x["d"] == best["d"]) & (x["role"] != best["role"]))
                back = F.array_min(F.transform(z["numbers"], lambda m: distance(m, best)))
                good = (F.size(found) > 0) & ~tied & (back == best["d"])
                return F.when(good, F.struct(best["role"].alias("role"), F.regexp_replace(n["value"], ",", "").alias("value"), unit_after(n["e"]).alias("unit")))

            return _once(near, choose)

        return F.filter(F.transform(z["numbers"], pair), lambda x: x.isNotNull())

    return _once(F.struct(numbers.alias("numbers"), labels.alias("labels")), pairs)
