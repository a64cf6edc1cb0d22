"""Topic gates: a fact that was supplied or extracted stands only if the clause speaks of its subject."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from contractlens.functions.text import UNICODE, bound, matches
from contractlens.operators.facts import HARASSMENT, VAGUE_GROUND, protected_misconduct

#: Field and the patterns that must all occur (fixed values).
GATES: dict[str, tuple[str, ...]] = {
    "escalation_undefined": (r"\brent\b|lease\s+amount|licen[cs]e\s+fee|monthly\s+(?:consideration|payment|amount)", r"escalat|increas|revis|enhanc|hike|adjust|review|re-?fix",),
    "escalation_percent": (r"\brent\b|lease\s+amount|licen[cs]e\s+fee|monthly\s+(?:consideration|payment|amount)", r"escalat|increas|revis|enhanc|hike|adjust|review|re-?fix",),
    "lock_in_binds_tenant_only": (r"lock[-\s]?in|minimum\s+(?:period|commitment|term|tenure)|shall\s+not\s+vacate|premature",),
    "early_exit_forfeits_full_deposit": (r"deposit|vacat|leave|quit|premature|lock[-\s]?in",),
    "deposit_months": (r"deposit|advance|caution\s+money|security",),
    "forfeiture_at_sole_discretion": (r"deposit|forfeit|withhold|refund|advance|security",),
    "deposit_forfeited_entirely_on_any_breach": (r"deposit|forfeit|breach|security",),
    "forfeiture_disproportionate_to_breach": (r"deposit|forfeit|breach|damages|compensation",),
    "entry_without_notice": (r"enter|entry|inspect|access|visit|premises",),
    "entry_notice_hours": (r"enter|entry|inspect|access|visit|premises",),
    "entry_causes_unspecified": (r"enter|entry|inspect|access|visit|premises",),
    "structural_repairs_on_tenant": (r"repair|maintenance|upkeep|structural|whitewash|plumb|leak",),
    "auto_renews_on_landlord_terms": (r"renew|extend|continuation|further\s+term",),
    "jurisdiction_away_from_premises": (r"jurisdiction|court|tribunal|forum|venue|arbitrat|dispute",),
    "premises_type": (r"premises|property|flat|apartment|house|shop|office|residential|commercial",),
    "registered": (r"registrat|registered|sub[-\s]?registrar|stamp\s+dut",),
    "term_months": (r"term|period|tenure|tenancy|commenc|expir|duration",),
    "penal_interest_added_to_rate": (r"penal|penalt|late\s+(?:charge|fee|payment)|default|overdue|delay",),
    "penal_charges_capitalised": (r"penal|penalt|capitalis|capitaliz|compound|late\s+charge|overdue",),
    "individual_penal_higher_than_corporate": (r"penal|penalt|individual|retail|corporate|borrower",),
    "penal_charge_amount_undisclosed": (r"penal|penalt|late\s+(?:charge|fee|payment)|default\s+(?:charge|interest)|overdue",),
    "stipulated_penalty_amount": (r"penal|penalt|liquidated|forfeit|damages|charge|fee",),
    "penalty_disproportionate_to_loss": (r"penal|penalt|liquidated|forfeit|damages|compensation",),
    "acceleration_without_notice": (r"accelerat|immediately\s+due|due\s+and\s+payable|recall|entire\s+outstanding|whole\s+of\s+the|event\s+of\s+default|forthwith",),
    "rate_reset_at_sole_discretion": (r"interest|rate|benchmark|repric|reset|revis|spread|margin",),
    "set_off_across_unrelated_accounts": (r"set[-\s]?off|lien|adjust|appropriat|other\s+account|credit\s+balance",),
    "set_off_without_notice": (r"set[-\s]?off|lien|adjust|appropriat|other\s+account|credit\s+balance",),
    "guarantee_uncapped": (r"guarant|surety|indemnifier|co[-\s]?borrower",),
    "prepayment_penalty": (r"pre[-\s]?pay|pre[-\s]?clos|foreclos|early\s+repay|part[-\s]?payment",),
    "insurance_mandatory_named_insurer": (r"insur|policy|cover|premium",),
    "assignment_without_notice": (r"assign|transfer|securitis|securitiz|novat|sell\s+the\s+loan", r"\bright|\bloan\b|agreement|receivable|transferee|assignee|securitis|securitiz|participation",),
    "repossession_without_notice": (r"reposs|seiz|take\s+possession|enforce\s+the\s+security|hypothecat|recovery\s+agent",),
    "jurisdiction_lender_city_only": (r"jurisdiction|court|tribunal|forum|venue|arbitrat|dispute",),
    "post_termination_restraint": (r"compet|solicit|restrain|restrict|after\s+(?:the\s+)?(?:termination|cessation)|following\s+(?:the\s+)?termination|non[-\s]?compete",),
    "restricted_from_competing_or_soliciting": (r"compet|solicit|engage|employ|restrain|restrict|business",),
    "in_term_restraint_only": (r"compet|solicit|restrain|restrict|during\s+(?:your|the)\s+employment|last\s+working\s+day",),
    "restraint_months": (r"compet|solicit|restrain|restrict|period|month|year",),
    "ip_assigned_outside_work": (r"intellectual|invention|copyright|patent|work\s+product|creat|design|author",),
    "moral_rights_assigned": (r"moral\s+right|intellectual|copyright|author",),
    "prior_work_carve_out": (r"intellectual|invention|prior|pre[-\s]?existing|owned\s+before|copyright",),
    "notice_asymmetric": (r"notice|resign|terminat|separation|leav",),
    "notice_days_employee": (r"notice|resign|terminat|separation",),
    "notice_days_employer": (r"notice|resign|terminat|separation",),
    "termination_at_sole_opinion": (r"terminat|dismiss|discharge|sole\s+(?:opinion|discretion)|services",),
    "confidentiality_perpetual": (r"confidential|proprietary|secret|disclos",),
    "confidentiality_covers_public_info": (r"confidential|proprietary|secret|disclos|public",),
    "arbitrator_appointed_by_one_side": (r"arbitrat|dispute|tribunal|umpire",),
    "probation_extendable_indefinitely": (r"probation|confirm|trainee|training\s+period",),
    "clawback_on_resignation": (r"clawback|recover|refund|repay|bonus|variable|incentive|joining",),
    "bond_present": (r"bond|minimum\s+(?:period|service|tenure|term)|shall\s+serve|commitment|undertaking",),
    "compels_continued_service": (r"bond|minimum\s+(?:period|service|tenure|term)|shall\s+serve|continue\s+in|remain\s+in",),
    "liquidated_damages_stated": (r"liquidated|damages|penalty|forfeit|compensation|recover|sum\s+of|shall\s+pay",),
    "penalty_amount_stated": (r"penalt|liquidated|damages|forfeit|recover|sum\s+of|shall\s+pay|bond",),
    "recovery_on_early_exit": (r"recover|refund|repay|reimburse|forfeit|resign|leav|quit|terminat|discontinu|early",),
    "training_cost_clawback": (r"training|clawback|recover|refund|reimburse|investment|cost\s+of",),
    "assigns_ip": (r"intellectual|invention|copyright|patent|trademark|work\s+product|design|author|creat|assign",),
    "assignment_scope_unlimited": (r"intellectual|invention|copyright|patent|work\s+product|assign|all\s+work",),
    "covers_off_premises": (r"intellectual|invention|copyright|work\s+product|premises|outside|off\s+the|away\s+from",),
    "covers_outside_work_hours": (r"intellectual|invention|copyright|work\s+product|hours|outside|after\s+work|personal\s+time",),
    "covers_anything_related_to_business": (r"intellectual|invention|copyright|work\s+product|business|related\s+to|field\s+of",),
    "prior_work_carveout": (r"intellectual|invention|copyright|prior|pre[-\s]?existing|owned\s+before|already",),
    "assigns_moral_rights": (r"moral\s+right|intellectual|copyright|author|integrity|paternity|waiv",),
    "cause_undefined_or_vague": (r"terminat|dismiss|discharge|cause|ground|reason|misconduct|sole\s+(?:opinion|discretion)",),
    "excludes_public_information": (r"confidential|proprietary|secret|disclos|public|generally\s+known",),
    "perpetual": (r"confidential|proprietary|secret|perpetu|in\s+perpetuity|without\s+limit|indefinit|forever|survive",),
    "probation_extendable_without_limit": (r"probation|confirm|trainee|training\s+period|extend",),
    "termination_without_cure_period": (r"terminat|breach|cure|remedy|rectif|notice|default",),
}
#: Fields that a clause on harassment without a vague ground can't set (fixed values).
TERMINATION = ("cause_undefined_or_vague", "termination_without_cure", "termination_without_cure_period", "termination_at_sole_opinion")


def truthy(value: Column, kind: str = "boolean") -> Column:
    """Whether a value asserts something."""
    nothing = {"boolean": F.lit(False), "double": F.lit(0.0)}.get(kind, F.lit(""))
    return F.coalesce(value != nothing, F.lit(False))


def passes(field: str, text: Column) -> Column:
    """Whether a clause lets a field be asserted."""
    subject = reduce(Column.__and__, (matches(text, p) for p in GATES.get(field, ())), F.lit(True))
    return subject & ~protected_misconduct(text) if field in TERMINATION else subject


def gated(field: str, value: Column, text: Column, kind: str = "boolean") -> Column:
    """The value, or null where it asserts something that the gate stops."""
    return F.when(truthy(value, kind) & ~passes(field, text), F.lit(None)).otherwise(value)


def dropped(values: dict[str, Column], text: Column, kinds: dict[str, str]) -> Column:
    """The fields that their gates stop, as an array."""
    return F.array_compact(F.array(*(F.when(truthy(v, kinds.get(f, "boolean")) & ~passes(f, text), F.lit(f)) for f, v in values.items())))


def _parts(pattern: str) -> list[str]:
    """The alternatives of a pattern, those within groups left together."""
    out, depth = [""], 0
    for c in pattern:
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(c, 0)
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _stem(part: str) -> str:
    """The longest run of letters that each match of an alternative holds."""
    sure = re.sub(r"\((?:[^()]|\([^()]*\))*\)|\[[^]]*\]\??|\\.\+?|.\?", " ", part)
    return max(re.findall("[a-z]+", sure), key=len, default="")


#: Every alternative of the gates, by what has to be tried: words that are searched for as they are, and patterns each with a word that it needs.
PARTS = sorted({a for own in GATES.values() for p in own for a in _parts(p)})
WORDS = [a for a in PARTS if re.fullmatch("[a-z]+", a)]
PATTERNS = {a: _stem(a) for a in PARTS if not re.fullmatch("[a-z]+", a)}
#: Capitals and signs that match one of a-z without regard to case.
_ALIKE = ("\u017f\u0131\u0130\u212a", "siik")


def lowered(text: Column) -> Column:
    """Small letters, in which a pattern of small letters finds what it finds in the text without regard to case."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), *_ALIKE))


def spoken(low: Column) -> Column:
    """The alternatives of all gates that a lowered text holds.

    Words are searched for, and a pattern is tried only where the word stands that it needs; each
    once, however many gates share it.
    """
    tried = [F.when(F.contains(low, F.lit(word)) & F.rlike(low, F.lit(UNICODE + a)), F.lit(a)) for a, word in PATTERNS.items()]
    return F.concat(F.filter(F.array(*map(F.lit, WORDS)), lambda w: F.contains(low, w)), F.array_compact(F.array(*tried)))


def _protected(low: Column) -> Column:
    """:func:`facts.protected_misconduct` of a lowered text."""
    return F.rlike(low, F.lit(UNICODE + HARASSMENT.replace("POSH", "posh"))) & ~F.rlike(low, F.lit(UNICODE + VAGUE_GROUND))


def stopped(values: Column, text: Column) -> Column:
    """The fields of a map of field to text that assert something and that their gates stop, sorted.

    The gates are one constant of alternatives; which of those a text holds is found out once, and
    only where some field is there.
    """
    return F.when(F.size(values) > 0, _stopped(values, text)).otherwise(F.array().cast("array<string>"))


def _stopped(values: Column, text: Column) -> Column:
    table = F.from_json(F.lit(json.dumps({f: [_parts(p) for p in own] for f, own in GATES.items()})), "map<string,array<array<string>>>")

    def stops(field: Column, value: Column, there: Column, protected: Column) -> Column:
        asserts = ~F.coalesce((value.try_cast("double") == 0) | value.isin("false", ""), F.lit(False))
        subject = F.coalesce(F.forall(F.try_element_at(table, field), lambda own: F.arrays_overlap(own, there)), F.lit(True))
        return asserts & (~subject | (field.isin(*TERMINATION) & protected))

    held = bound(lowered(text), lambda low: F.struct(spoken(low).alias("there"), _protected(low).alias("protected")))
    return bound(held, lambda h: F.sort_array(F.map_keys(F.map_filter(values, lambda f, v: stops(f, v, h["there"], h["protected"])))))
