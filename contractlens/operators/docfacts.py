"""Facts of a whole document; a type's boolean facts are always there, the numbers if they are stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contractlens.functions.text import UNICODE, matches, squeeze

# Patterns and numbers (fixed values).
NUMBER_WORD = r"(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|eighteen|twenty|twenty[- ]four|twenty[- ]five|thirty|thirty[- ]six|forty|fifty)"
AMOUNT = (
    r"(?:(?:rs\.?|inr|₹)\s*[\d,]+(?:\.\d+)?|\b\d+(?:\.\d+)?\s*%|\b\d+(?:\.\d+)?\s*(?:per\s*cent|percent)\b"
    r"|\b" + NUMBER_WORD + r"\s*(?:per\s*cent|percent)\b|\b[\d.,]+\s*(?:lakh|lakhs|crore|crores)\b)"
)
WITHHELD = (
    r"(?:not\s+(?:be\s+)?required\s+to\s+disclose|without\s+disclos\w+|as\s+(?:the\s+)?(?:lender|bank|company)\s+may\s+(?:decide|determine|deem)"
    r"|at\s+(?:the\s+)?(?:lender|bank|company)(?:'s|s')?\s+(?:sole\s+)?discretion|quantum\s+(?:of\s+such\s+)?charges?\s+(?:shall|may|will)\s+(?:be\s+)?(?:decided|determined|notified))"
)
PENAL = r"(?:penal\s+(?:charge|interest|sum)\w*|penalty|late\s+(?:charge|fee|payment\s+charge)\w*|default\s+(?:charge|interest)\w*|overdue\s+(?:charge|interest)\w*|delayed\s+payment\s+charge\w*)"
PREPAYMENT = r"(?:pre-?payment|pre-?closure|foreclosure|part-?payment|early\s+repayment)"
KEY_FACTS = r"(?:key\s+fact\s+statement|\bkfs\b|annual\s+percentage\s+rate|\bapr\b)"
REGISTRATION = r"(?:registrat(?:ion|ed)|sub-?registrar|stamp\s+dut(?:y|ies)|registration\s+act)"
NOTICE = r"(?:notice\s+period|notice\s+of\s+\w+\s+(?:month|day))"
MONTHS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "eighteen": 18, "twenty-four": 24, "twenty four": 24, "thirty-six": 36, "thirty six": 36,
}
TERM_STATED = r"(?:period|term|tenure|tenancy|duration)\s+of\s+(\d{1,3}|[a-z]+(?:[- ][a-z]+)?)\s*(?:\(\s*[\w-]+\s*\))?\s*(month|year)s?"
TERM_AS_ADJECTIVE = r"\b(\d{1,3})\s*[- ]\s*month\s+(?:term|period|tenancy|tenure|lease)\b"
TERM_IN_TABLE = r"\b(?:term|tenure|lease\s+period|period\s+of\s+(?:lease|tenancy|licen[cs]e))\b[^.\n]{0,90}?\(?\s*(\d{1,3})\s*(month|year)s?\s*\)?"
_WORDS = "|".join(sorted(MONTHS, key=len, reverse=True))
_NUMBER = r"(\d{1,2}|" + _WORDS + r")\b\s*(?:\(\s*(\d{1,2}|" + _WORDS + r")\s*\))?"
_OF_RENT = r"\s*months?['’]?\s*(?:of\s+(?:the\s+)?)?(?:monthly\s+)?rent"
DEPOSIT_THEN_MONTHS = r"deposit[^.\n]{0,100}?\b" + _NUMBER + _OF_RENT
MONTHS_THEN_DEPOSIT = r"\b" + _NUMBER + _OF_RENT + r"[^.\n]{0,40}?deposit"
DEPOSIT_MONEY = r"security\s+deposit[^.\n\d]{0,40}?(?:rs\.?|inr|₹)\s*([\d,]+(?:\.\d+)?)"
RENT_MONEY = (r"monthly\s+rent[^.\n\d]{0,30}?(?:rs\.?|inr|₹)\s*([\d,]+)", r"\brent\b[^.\n\d]{0,30}?(?:rs\.?|inr|₹)\s*([\d,]+)(?:/-)?\s*(?:per\s+month|a\s+month|monthly|p\.?\s?m\.?)")
#: What cuts a window: a numbered heading on a new line, or an empty line (a fixed value).
BOUNDARY = r"\n\s*(?:\d{1,2}[.)]\s|\n)"
WINDOW = 200


def _all(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(x, F.lit("(?iuU)" + pattern), F.lit(group))


def windows(x: Column, lead: str, width: int = WINDOW) -> Column:
    """The text around each match of lead: up to width characters on either side, cut at the nearest boundary."""
    # the signs mark where a lead begins and ends, and boundaries; they keep the texts' lengths
    plain = F.translate(x, "\x01\x02\x03", "   ")
    pieces = F.split(F.regexp_replace(plain, "(?iuU)" + lead, "\x01$0\x02"), "\x01")
    none = F.array().cast("array<struct<at:int,size:int>>")

    def step(acc: Column, piece: Column) -> Column:
        size = F.instr(piece, "\x02") - 1
        at = F.array(F.struct(acc["at"].alias("at"), size.alias("size")))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["leads"], at).alias("leads"))

    start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), none.alias("leads"))
    leads = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda acc: acc["leads"])
    cut = lambda part: F.regexp_replace(part, UNICODE + BOUNDARY, "\x03")

    def around(m: Column) -> Column:
        first = F.greatest(m["at"] - width, F.lit(0))
        left = F.substring(plain, first + 1, m["at"] - first)
        right = F.substring(plain, m["at"] + m["size"] + 1, F.lit(width))
        return F.concat(F.substring_index(cut(left), "\x03", -1), F.substring(plain, m["at"] + 1, m["size"]), F.substring_index(cut(right), "\x03", 1))

    return F.transform(leads, around)


def shown_near(x: Column, lead: str, near: str, width: int = WINDOW) -> Column:
    """The first window of lead that holds near, squeezed; null without one."""
    return F.get(F.transform(F.filter(windows(x, lead, width), lambda w: matches(w, near)), lambda w: squeeze(w)), F.lit(0))


def in_provision(x: Column, lead: str, near: str, width: int = WINDOW) -> Column:
    """Whether near stands in the window of some lead."""
    return F.exists(windows(x, lead, width), lambda w: matches(w, near))


def mention(x: Column, pattern: str) -> Column:
    """The first match with 60 characters before and 100 after it, squeezed; null without one."""
    found = F.regexp_extract(x, "(?iuUs).{0,60}?(?:" + pattern + ").{0,100}", 0)
    return F.when(found != "", squeeze(found))


def _number(raw: Column) -> Column:
    """Digits or a number word; null for anything else."""
    words = F.create_map(*(F.lit(v) for kv in MONTHS.items() for v in kv))
    low = F.lower(F.trim(raw))
    return F.coalesce(F.when(low.rlike(r"^\d+$"), F.try_to_number(low, F.lit("999")).cast("int")), F.try_element_at(words, low))


def _months(number: Column, unit: Column) -> Column:
    return F.when(F.startswith(F.lower(unit), F.lit("year")), number * 12).otherwise(number)


def term_months(x: Column) -> Column:
    """The longest stated term in months; null if none is stated."""
    stated = F.zip_with(_all(x, TERM_STATED, 1), _all(x, TERM_STATED, 2), lambda n, u: _months(_number(n), u))
    adjective = F.transform(_all(x, TERM_AS_ADJECTIVE, 1), _number)
    table = F.zip_with(_all(x, TERM_IN_TABLE, 1), _all(x, TERM_IN_TABLE, 2), lambda n, u: _months(_number(n), u))
    return F.array_max(F.concat(stated, adjective, F.filter(table, lambda n: (n > 0) & (n <= 600)))).cast("double")


def _money(found: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(found, lambda m: F.replace(m, F.lit(","), F.lit("")).try_cast("double")), lambda m: m.isNotNull()))


def deposit_months(x: Column) -> Column:
    """The deposit in months of rent, if one number of months is stated, or one deposit and one rent."""
    said = [F.zip_with(_all(x, p, 1), _all(x, p, 2), lambda a, b: F.coalesce(_number(a), _number(b))) for p in (DEPOSIT_THEN_MONTHS, MONTHS_THEN_DEPOSIT)]
    months = F.array_distinct(F.filter(F.concat(*said), lambda n: (n > 0) & (n <= 24)))
    deposit = _money(_all(x, DEPOSIT_MONEY, 1))
    rent = F.array_distinct(F.concat(*(_money(_all(x, p, 1)) for p in RENT_MONEY)))
    ratio = F.when((F.size(deposit) == 1) & (F.size(rent) == 1) & (F.get(rent, F.lit(0)) > 0), F.bround(F.get(deposit, F.lit(0)) / F.get(rent, F.lit(0)), 1))
    return F.when(F.size(months) == 1, F.get(months, F.lit(0)).cast("double")).when(F.size(months) == 0, ratio)


#: Document facts and the type they belong to.
FACTS = {
    "doc__penal_charge_quantified": "loan", "doc__penal_quantum_withheld": "loan", "doc__prepayment_charge_quantified": "loan", "doc__kfs_present": "loan",
    "doc__registration_mentioned": "rental", "doc__term_months": "rental", "doc__deposit_months": "rental", "doc__notice_period_mentioned": "employment",
}


def read_document(text: Column, doc_type: Column) -> Column:
    """A struct of all FACTS; those of other types are null."""
    x = F.coalesce(text, F.lit(""))
    values = {
        "doc__penal_charge_quantified": in_provision(x, PENAL, AMOUNT),
        "doc__penal_quantum_withheld": in_provision(x, PENAL, WITHHELD),
        "doc__prepayment_charge_quantified": in_provision(x, PREPAYMENT, AMOUNT),
        "doc__kfs_present": matches(x, KEY_FACTS),
        "doc__registration_mentioned": matches(x, REGISTRATION),
        "doc__term_months": term_months(x),
        "doc__deposit_months": deposit_months(x),
        "doc__notice_period_mentioned": matches(x, NOTICE),
    }
    return F.struct(*(F.when(doc_type == kind, values[f]).alias(f) for f, kind in FACTS.items()))


#: What shows a boolean fact, where words do.
CONTEXTS = {
    "doc__penal_charge_quantified": (PENAL, AMOUNT), "doc__penal_quantum_withheld": (PENAL, WITHHELD), "doc__prepayment_charge_quantified": (PREPAYMENT, AMOUNT),
    "doc__kfs_present": (KEY_FACTS, None), "doc__registration_mentioned": (REGISTRATION, None), "doc__notice_period_mentioned": (NOTICE, None),
}


def read_contexts(text: Column, doc_type: Column) -> Column:
    """A struct of the words that show each boolean fact; null where there are none."""
    x = F.coalesce(text, F.lit(""))
    shown = {f: mention(x, lead) if near is None else shown_near(x, lead, near) for f, (lead, near) in CONTEXTS.items()}
    return F.struct(*(F.when(doc_type == FACTS[f], c).alias(f) for f, c in shown.items()))
