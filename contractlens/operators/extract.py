"""The extractor surface: a deterministic keyword extractor, and how a model's answer is read.

An extractor is any function from (doc_type, text) columns to a JSON column of parameters; the one
here is made of expressions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from contractlens.operators import rulebook

MAX_PROMPT = 4000


def _has(low: Column, *phrases: str) -> Column:
    """All of the phrases occur."""
    out = F.lit(True)
    for p in phrases:
        out = out & F.contains(low, F.lit(p))
    return out


def _any(low: Column, *phrases: str) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def keyword_params(doc_type: Column, text: Column) -> dict[str, Column]:
    """Field to typed column, null where the keywords say nothing (the keywords are fixed values)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    yes = lambda c: F.when(c, F.lit(True))
    yes_no = lambda c, no: F.when(no, F.lit(False)).when(c, F.lit(True))
    after = _any(low, "following the termination", "following termination") & _has(low, "shall not") & _any(low, "compet", "employed by")
    assigns = _any(low, "vest in the company", "property of the company", "assign to the company")
    yours = _any(low, "remains yours", "remains your property", "belongs to you")
    perpetual = _has(low, "in perpetuity")
    rental, loan = doc_type == "rental", doc_type == "loan"
    discretion = _has(low, "sole discretion")
    hyphens = F.replace(low, F.lit("set-off"), F.lit("set off"))
    no_notice = _has(low, "without prior notice")
    hours = _any(low, "twenty-four", "24 hours")
    levied = _any(low, "penal charge", "penal interest", "late payment charge") & ~_any(low, "without penalty", "no penalty", "without any penal")
    return {
        "post_termination_restraint": yes(after),
        "restricted_from_competing_or_soliciting": yes(after),
        "in_term_restraint_only": yes(_any(low, "only during your employment", "ends on your last working day")),
        "bond_present": yes(_any(low, "minimum period", "minimum service")),
        "liquidated_damages_stated": yes(_has(low, "liquidated damages")),
        "penalty_amount_stated": yes(_any(low, "rs. 5,00,000", "rs 5,00,000")),
        "recovery_on_early_exit": yes(_any(low, "recoverable as a debt", "shall pay the company a sum")),
        "assigns_ip": yes(assigns),
        "covers_outside_work_hours": yes(assigns & _any(low, "outside the usual hours", "outside working hours") & ~yours),
        "covers_off_premises": yes(assigns & _has(low, "off the premises") & ~yours),
        "prior_work_carveout": yes(assigns & _has(low, "before joining", "remains yours")),
        "assigns_moral_rights": yes(assigns & _has(low, "moral rights", "assign") & ~_has(low, "affects your moral")),
        "notice_asymmetric": yes(_has(low, "ninety (90) days", "thirty (30) days") | (rental & _has(low, "three (3) months written notice", "fifteen (15) days notice"))),
        "cause_undefined_or_vague": yes(_any(low, "sole opinion", "detrimental to the best interests")),
        "perpetual": yes(perpetual),
        "excludes_public_information": F.when(perpetual, _has(low, "publicly available") & ~_has(low, "whether or not")),
        "arbitrator_appointed_by_one_side": yes(_has(low, "arbitrator appointed by the company")),
        "deposit_months": F.when(rental & _any(low, "six (6) months rent", "six months rent"), F.lit(6.0)).when(rental & _any(low, "two (2) months", "two months rent"), F.lit(2.0)),
        "forfeiture_at_sole_discretion": yes(rental & discretion & _any(low, "deduct", "deposit")),
        "deposit_forfeited_entirely_on_any_breach": yes(rental & (_has(low, "howsoever minor") | _has(low, "entire security deposit", "forfeit"))),
        "lock_in_binds_tenant_only": yes(rental & _has(low, "shall not vacate", "may terminate this agreement at any time")),
        "entry_without_notice": yes(rental & no_notice),
        "entry_notice_hours": F.when(rental & ~no_notice & (hours | _has(low, "48 hours")), F.when(hours, F.lit(24.0)).otherwise(F.lit(48.0))),
        "structural_repairs_on_tenant": yes(rental & _has(low, "structural repairs", "lessee", "own cost")),
        "term_months": F.when(rental & _has(low, "twenty-four (24) months", "shall not be registered"), F.lit(24.0)),
        "penal_interest_added_to_rate": F.when(loan, yes_no(_any(low, "added to the rate of interest", "added to the applicable rate"), _any(low, "not be added to the rate", "separate fee"))),
        "penal_charges_capitalised": F.when(loan, yes_no(_has(low, "compounded", "penal"), _has(low, "no interest shall be computed on any penal"))),
        "penal_charge_amount_undisclosed": yes(loan & levied & ~_any(low, "key fact statement", "rs.", "separate fee")),
        "acceleration_without_notice": yes(loan & _has(low, "immediately due", "without notice")),
        "rate_reset_at_sole_discretion": yes(loan & discretion & _any(low, "rate", "interest")),
        "set_off_across_unrelated_accounts": yes(loan & _has(hyphens, "any other account", "set off")),
        "repossession_without_notice": yes(loan & _has(low, "take possession", "without notice")),
    }


def answer_params(answer: Column, fields) -> dict[str, Column]:
    """Typed fields of an extractor's JSON answer."""
    v = F.try_parse_json(answer)
    return {f: F.try_variant_get(v, f"$.params.{f}", rulebook.KINDS.get(f, "boolean")) for f in fields}


def quote_check(text: Column, quote: Column, category: Column, confidence: Column, taxonomy: list[str]) -> Column:
    """(quote_verified, category, confidence): an unfound quote or unknown category lowers the confidence."""
    found = F.contains(F.lower(text), F.lower(F.left(F.coalesce(quote, F.lit("")), F.lit(40)))) & (F.coalesce(quote, F.lit("")) != "")
    known = F.coalesce(category.isin(taxonomy), F.lit(False))
    sure = F.when(found, confidence).otherwise(F.least(confidence, F.lit(0.5)))
    return F.struct(found.alias("quote_verified"), F.when(known, category).otherwise(F.lit("boilerplate")).alias("category"), F.when(known, sure).otherwise(F.least(sure, F.lit(0.4))).alias("confidence"))


def _objects(text: str):
    """Balanced JSON objects in a text, and a cut-off last one with its brackets closed."""
    depth, start, quoted, escaped, stack = 0, -1, False, False, []
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), (escaped or c != '"')
            continue
        if c == '"' and depth:
            quoted = True
        elif c in "{[" and (depth or c == "{"):
            start = i if not depth else start
            depth += 1
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and depth:
            depth -= 1
            stack.pop()
            if not depth:
                yield text[start : i + 1]
    if depth:
        yield text[start:].rstrip().rstrip(",") + '"' * quoted + "".join(reversed(stack))


def best_object(text: str | None, keys: set[str]) -> str | None:
    """The JSON object of a model's answer that has most of the expected keys, the last of equals."""
    best, most = None, -1
    for raw in _objects(text or ""):
        try:
            value = json.loads(raw)
        except ValueError:
            continue
        if isinstance(value, dict) and len(keys & set(value)) >= most:
            best, most = raw, len(keys & set(value))
    return best


def json_answer(keys=("category", "params", "quote", "confidence")):
    """A pandas UDF that finds the JSON object in a model's answer."""
    wanted = set(keys)

    @F.pandas_udf("string")
    def find(answers: pd.Series) -> pd.Series:
        return answers.map(lambda a: best_object(a, wanted))

    return find
