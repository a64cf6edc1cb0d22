"""Pattern readers: typed facts of a clause, each with the words that show it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contractlens.functions.text import UNICODE, bound, evidence, matches

# Patterns (fixed values; matched without regard to case).
MONEY = r"(?:(?:rs\.?|inr|₹)\s*[\d,]+|\b[\d.,]+\s*(?:lakh|lakhs|crore|crores)\b)"
COMMITMENT = r"(?:minimum\s+(?:period\s+of\s+service|tenure|service\s+period|term)|minimum\s+tenure\s+commitment|service\s+(?:bond|commitment)\b|shall\s+serve\s+(?:a\s+minimum|for\s+a\s+minimum|the\s+company\s+for)|bond\s+period)"
EXIT_RECOVERY = r"(?:liable\s+to\s+(?:a\s+)?recover|recovery\s+of|shall\s+(?:pay|refund|reimburse)|liquidated\s+damages|indemnif\w+|forfeit\w*|penalty\s+of)[^.]{0,160}?" + MONEY
REASON_THEN_RECOVERY = r"(?:discontinu\w+|leav\w+|resign\w+|exit\w*|terminat\w+|quit\w*|separation)[^.]{0,200}?(?:liable\s+to|recovery\s+of|shall\s+(?:pay|refund|reimburse)|liquidated\s+damages)"
TRAINING_COST = r"(?:cost\s+of\s+training|training\s+cost|cost\s+of\s+the\s+training|investment\s+(?:made|incurred))"
NOT_NEGOTIABLE = r"(?:not\s+negotiable|non-?negotiable|under\s+any\s+circumstance|cannot\s+be\s+waived|no\s+\w+\s+can\s+waive|mandatory)"
PLACEHOLDER = r"\[[A-Za-z][^\]\n]{2,40}\]"
PLACEHOLDER_ALLOWED = r"^(?:sic|\.\.\.|etc|see|and|or|the\s+company|emphasis\s+added)$"
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
DAY_RANGE = r"(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\s*(?:-|to|–|—)\s*(monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
TIME_RANGE = r"(\d{1,2})[:.](\d{2})\s*(am|pm)?\s*(?:-|to|–|—)\s*(\d{1,2})[:.](\d{2})\s*(am|pm)?"
SETTLEMENT = r"(?:full\s+and\s+final\s+settlement|final\s+settlement|experience\s+certificate|relieving\s+letter|service\s+certificate)"
CONDITIONAL = r"(?:is\s+mandatory|only\s+(?:upon|after|if)|subject\s+to|shall\s+not\s+be\s+(?:issued|released|paid)|withheld|conditional\s+upon|required\s+(?:to|in\s+order)\s+to\s+receive)"
UNPAID = r"(?:\bunpaid\b|without\s+(?:any\s+)?(?:pay|stipend|remuneration|salary)|no\s+(?:stipend|salary|remuneration)\s+(?:shall\s+be|will\s+be|is)\s+(?:paid|payable))"
WORK_PERIOD = r"(?:training|probation|orientation|induction|internship|on-?the-?job|ojt|notice\s+period)"
ELSEWHERE = (
    r"(?:(?:as\s+per|following|in\s+line\s+with|subject\s+to)\s+(?:the\s+)?(?:company|internal|organisation\w*)\s+[A-Za-z ]{0,25}?polic\w+"
    r"|(?:detailed|set\s+out|specified|governed|described)\s+in\s+the\s+[A-Za-z ]{3,40}\s*agreement"
    r"|in\s+accordance\s+with\s+(?:the\s+)?(?:company|internal)\s+polic\w+"
    r"|will\s+be\s+communicated\s+(?:at\s+the\s+time|later|separately|in\s+due\s+course)"
    r"|which\s+may\s+be\s+(?:updated|amended|revised)\s+from\s+time\s+to\s+time)"
)
MATERIAL_TERM = r"(?:compensation|salary|remuneration|ctc|benefit|leave|assessment|evaluation|incentive|bonus|appraisal|notice)"
PERPETUAL = (
    r"(?:(?:during\s+and\s+after|at\s+all\s+times|in\s+perpetuity|shall\s+survive|even\s+after\s+(?:the\s+)?(?:termination|cessation|expiry))[^.]{0,120}?confidential"
    r"|confidential[^.]{0,120}?(?:during\s+and\s+after|in\s+perpetuity|shall\s+survive))"
)
PUBLIC = (
    r"(?:public\s+domain|publicly\s+(?:available|known)|already\s+known|becomes\s+public|through\s+no\s+fault|independently\s+developed"
    r"|\bnon[-\s]?public\b|not\s+(?:otherwise\s+)?(?:publicly|generally)\s+(?:available|known)|generally\s+(?:available|known)\s+to\s+the\s+public)"
)
IMMEDIATE = (
    r"(?:(?:terminat\w+|end\s+(?:it|this|your)\b|withdraw\w*\s+(?:the\s+)?offer|dismiss\w*)[^.]{0,160}?(?:with\s+immediate\s+effect|without\s+notice|sole\s+discretion|forthwith)"
    r"|(?:with\s+immediate\s+effect|sole\s+discretion)[^.]{0,160}?(?:terminat\w+|withdraw\w*\s+(?:the\s+)?offer))"
)
HARASSMENT = r"(?:sexual\s+harass\w*|harassment\s+(?:at|in)\s+(?:the\s+)?work\s*place|\bPOSH\b|internal\s+complaints?\s+committee|prevention\s+of\s+sexual)"
VAGUE_GROUND = (
    r"(?:\b(?:non-?)?performance\b|under-?perform\w*|not\s+up\s+to|unsatisfactor\w*|prejudicial|harmful\s+to\s+the\s+interest"
    r"|misbehav\w*|sole\s+(?:opinion|discretion)|for\s+any\s+reason|without\s+assigning|inconsistent\s+with\s+the\s+polic\w*|absent\w*|attitude|loss\s+of\s+confidence)"
)
CURE = r"(?:opportunity\s+to\s+(?:remedy|cure|rectify|be\s+heard)|cure\s+period|after\s+(?:giving|serving)\s+(?:\w+\s+){0,3}notice\s+to\s+remedy|show\s+cause|inquiry|enquiry|improvement\s+plan|\bPIP\b)"
VERIFICATION = r"(?:(?:background|reference|credential|document)\s+(?:check|verification|screening)\w*|check\s+results?|submit\w*\s+(?:the\s+|your\s+|required\s+)?documents|documents?\s+(?:listed|required|to\s+be\s+submitted))"
CONDUCT = r"(?:\bperformance\b|under-?perform\w*|polic(?:y|ies)|misconduct|behaviou?r|attitude|prejudicial|harmful\s+to\s+the\s+interest|loss\s+of\s+confidence)"
BROAD_GROUND = (
    r"(?:(?:unsatisfactory|poor|inadequate|sub-?standard)\s+(?:work\s+)?performance|non-?performance|under-?perform\w*|not\s+up\s+to\s+(?:the\s+)?(?:mark|standards?)"
    r"|(?:violation|breach)\w*\s+of\s+(?:any\s+)?(?:the\s+)?(?:company\s+|internal\s+)?polic(?:y|ies)|polic(?:y|ies)\s+violations?|prejudicial\s+to|harmful\s+to\s+the\s+interest|loss\s+of\s+confidence)"
)
MAY_TERMINATE = r"\b(?:may|shall|can|will|right\s+to|entitled\s+to)\s+(?:\w+\s+){0,3}?(?:terminat\w+|dismiss\w*)\b"
NOTICE_OR_CURE = r"(?:notice|days['’]|remedy|cure|rectify|improvement\s+plan|\bPIP\b|warning)"

#: Boolean facts and the two hours, in the order of the reader's struct.
FACTS = (
    "unfilled_placeholder", "bond_present", "compels_continued_service", "recovery_on_early_exit", "training_cost_clawback",
    "weekly_hours", "weekly_hours_net", "settlement_conditional", "unpaid_work_period", "material_terms_elsewhere",
    "perpetual_confidentiality", "perpetual", "excludes_public_information", "termination_without_cure", "cause_undefined_or_vague",
)


def _group(x: Column, pattern: str, i: int) -> Column:
    found = F.regexp_extract(x, "(?iuU)" + pattern, i)
    return F.when(found != "", F.lower(found))


def working_time(x: Column) -> Column:
    """(days, h1, m1, am1, h2, m2, am2) of the first range of days and the first range of times."""
    index = F.array(*map(F.lit, DAYS))
    i, j = (F.array_position(index, _group(x, DAY_RANGE, k)) for k in (1, 2))
    parts = {"h1": 1, "m1": 2, "am1": 3, "h2": 4, "m2": 5, "am2": 6}
    read = {n: _group(x, TIME_RANGE, k) for n, k in parts.items()}
    return F.struct(F.when((i > 0) & (j > 0), F.pmod(j - i, F.lit(7)) + 1).alias("days"), *((c if n.startswith("am") else c.cast("int")).alias(n) for n, c in read.items()))


def _hours(t: Column) -> Column:
    """Hours from start to end of a working time."""
    start = F.when((t["am1"] == "pm") & (t["h1"] < 12), t["h1"] + 12).when((t["am1"] == "am") & (t["h1"] == 12), F.lit(0)).otherwise(t["h1"])
    late = F.when((t["am2"] == "pm") & (t["h2"] < 12), t["h2"] + 12).otherwise(t["h2"])
    end = F.when(t["am2"].isNull() & (late < start), late + 12).otherwise(late)
    return (end * 60 + t["m2"] - start * 60 - t["m1"]) / 60


def weekly(x: Column) -> Column:
    """(gross, net) hours a week; null if a range is missing or a day has no or over 16 hours.

    Net is an hour less on every day of more than five hours.
    """
    ranges = x.rlike("(?iuU)" + DAY_RANGE) & x.rlike("(?iuU)" + TIME_RANGE)  # eight groups are read below
    timed = bound(F.when(ranges, working_time(x)), lambda t: F.struct(t["days"].alias("days"), _hours(t).alias("hours")))
    gross = bound(timed, lambda t: F.struct(t["days"].alias("days"), F.when((t["hours"] > 0) & (t["hours"] <= 16), F.bround(t["days"] * t["hours"], 1)).alias("week")))
    return bound(gross, lambda g: F.struct(g["week"].alias("gross"), F.when(g["week"] / g["days"] > 5, F.bround(g["days"] * (g["week"] / g["days"] - 1), 1)).otherwise(g["week"]).alias("net")))


def weekly_hours(x: Column) -> Column:
    return weekly(x)["gross"]


def placeholder(x: Column) -> Column:
    """The first bracketed blank that is not on the list of allowed ones; null without any."""
    inner = lambda p: F.trim(F.substring(p, 2, 1000))
    bare = lambda p: F.regexp_replace(inner(p), r"\s*\]$", "")
    open_ = F.filter(F.regexp_extract_all(x, F.lit(PLACEHOLDER), F.lit(0)), lambda p: ~bare(p).rlike("(?i)" + PLACEHOLDER_ALLOWED))
    return F.get(open_, F.lit(0))


def broad_ground_sentence(x: Column) -> Column:
    """The first sentence that lets one end the contract on a broad ground without notice or cure."""
    parts = F.regexp_extract_all(x, F.lit(UNICODE + r"[^.;\s][^.;]*[.;]?"), F.lit(0))
    return F.get(F.filter(parts, lambda s: matches(s, MAY_TERMINATE) & matches(s, BROAD_GROUND) & ~matches(s, NOTICE_OR_CURE)), F.lit(0))


def protected_misconduct(x: Column) -> Column:
    """The subject is harassment and no vague ground is named."""
    return matches(x, HARASSMENT) & ~matches(x, VAGUE_GROUND)


def read_facts(text: Column, doc_type: Column) -> Column:
    """A struct of all FACTS; null is silence. Only the placeholder is read outside employment."""
    yes, own = F.lit(True), doc_type == "employment"
    commitment = matches(text, COMMITMENT)
    recovery = matches(text, EXIT_RECOVERY) & (commitment | matches(text, REASON_THEN_RECOVERY))
    perpetual = matches(text, PERPETUAL) & ~matches(text, PUBLIC)
    immediate = matches(text, IMMEDIATE) & ~(matches(text, VERIFICATION) & ~matches(text, CONDUCT))
    vague = (immediate | broad_ground_sentence(text).isNotNull()) & ~matches(text, CURE) & ~protected_misconduct(text)
    # several facts hang on each of these, and what stands behind a condition is worked out at each use
    shared = {"commitment": commitment, "recovery": recovery, "perpetual": perpetual, "vague": vague, "week": weekly(text)}
    return bound(F.when(own, F.struct(*(c.alias(n) for n, c in shared.items()))), lambda s: _facts(text, yes, own, s))


def _facts(text: Column, yes: Column, own: Column, s: Column) -> Column:
    values = {
        "unfilled_placeholder": F.when(placeholder(text).isNotNull(), yes),
        "bond_present": F.when(s["commitment"] | s["recovery"], yes),
        "compels_continued_service": F.when(s["commitment"] & matches(text, NOT_NEGOTIABLE), yes),
        "recovery_on_early_exit": F.when(s["recovery"], yes),
        "training_cost_clawback": F.when(own & matches(text, TRAINING_COST) & matches(text, MONEY), yes),
        "weekly_hours": s["week"]["gross"],
        "weekly_hours_net": s["week"]["net"],
        "settlement_conditional": F.when(own & matches(text, SETTLEMENT) & matches(text, CONDITIONAL), yes),
        "unpaid_work_period": F.when(own & matches(text, UNPAID) & matches(text, WORK_PERIOD), yes),
        "material_terms_elsewhere": F.when(own & matches(text, ELSEWHERE) & matches(text, MATERIAL_TERM), yes),
        "perpetual_confidentiality": F.when(s["perpetual"], yes),
        "perpetual": F.when(s["perpetual"], yes),
        "excludes_public_information": F.when(s["perpetual"], F.lit(False)),
        "termination_without_cure": F.when(s["vague"], yes),
        "cause_undefined_or_vague": F.when(s["vague"], yes),
    }
    return F.struct(*(values[f].alias(f) for f in FACTS))


#: The pattern whose match shows a fact.
SHOWN_BY = {
    "bond_present": COMMITMENT, "compels_continued_service": NOT_NEGOTIABLE, "recovery_on_early_exit": EXIT_RECOVERY, "training_cost_clawback": TRAINING_COST,
    "weekly_hours": TIME_RANGE, "weekly_hours_net": TIME_RANGE, "settlement_conditional": SETTLEMENT, "unpaid_work_period": UNPAID, "material_terms_elsewhere": ELSEWHERE,
    "perpetual_confidentiality": PERPETUAL, "perpetual": PERPETUAL, "excludes_public_information": PERPETUAL,
}


def read_evidence(text: Column, facts: Column) -> Column:
    """A map of fact to its evidence span, for the facts of :func:`read_facts` that hold."""
    shown = {f: evidence(text, p) for f, p in SHOWN_BY.items()}
    shown["bond_present"] = F.coalesce(shown["bond_present"], evidence(text, EXIT_RECOVERY))
    ends = F.coalesce(F.when(~(matches(text, VERIFICATION) & ~matches(text, CONDUCT)), evidence(text, IMMEDIATE)), F.left(broad_ground_sentence(text), F.lit(90)))
    shown |= {"termination_without_cure": ends, "cause_undefined_or_vague": ends, "unfilled_placeholder": placeholder(text)}
    # a span stands once, behind its fact: shared parts are worked out for every row
    entries = F.array(*(F.struct(F.lit(f).alias("key"), F.when(facts[f].isNotNull(), shown[f]).alias("value")) for f in FACTS))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
