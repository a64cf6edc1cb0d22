"""Queries on the shipped rules, fields, gates and citations, each beside its SQL."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from contractlens.functions.text import bound, computed
from contractlens.operators import evalstats, extract, facts, gates, guard, rulebook, rules, statutes
from contractlens.plans import audit, papers
from contractlens.plans.queries import SQL, _list, query, spread, table
from contractlens.sources import readers

_PAPERS = "papers as (select doc_id, case doc_id % 3 when 0 then 'employment' when 1 then 'rental' else 'loan' end as doc_type from documents),\nbank(doc_type, code, whole, rule_id, severity) as (values " + ", ".join(
    f"('{t}', '{p.code}', {str(p.whole).lower()}, '{rule}', '{severity}')" for t, own in papers.BANK.items() for p in own for rule, severity in p.raises
) + """),
found as (
  select doc_id, rule_id, severity, case when whole then 'opening' else code end as place from papers join bank using (doc_type)
  where substr(md5(doc_id || ':' || code), 1, 1) between '0' and '9')"""


def _papers(spark, sf_dir):
    return papers.papers(spread(table(spark, sf_dir, "documents").select("doc_id")))


def _audited(spark, sf_dir):
    return audit.audit(_papers(spark, sf_dir), papers.acts(spark))


@query("with " + _PAPERS + """,
sums as (select doc_id, count(distinct place) as flagged, sum((severity = 'high')::int) as high, sum(case severity when 'high' then 3 when 'medium' then 2 else 1 end) as score, string_agg(distinct rule_id, ',' order by rule_id) as rules from found group by doc_id)
select doc_id, coalesce(flagged, 0)::bigint as flagged, coalesce(high, 0)::bigint as high, coalesce(score, 0)::bigint as score, coalesce(rules, '') as rules from papers left join sums using (doc_id)""")
def audit_papers(spark, sf_dir):
    """The whole audit with the shipped rules over a paper for each document: cleaning, clauses, facts, gates, rules, citations from small acts, verification, summary."""
    found, summary = _audited(spark, sf_dir)
    scores = found.where("risky").groupBy("doc_id").agg(F.sum(evalstats.severity_score(F.col("severity"))).cast("long").alias("score"))
    return summary.join(scores, "doc_id", "left").select("doc_id", "flagged", "high", F.coalesce("score", F.lit(0)).cast("long").alias("score"), "rules")


@query("with " + _PAPERS + "\nselect doc_id, rule_id, severity, count(*) as n from found group by all")
def audit_findings(spark, sf_dir):
    """The verified findings of the same papers."""
    return _audited(spark, sf_dir)[0].groupBy("doc_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def _rash(kind: Column, text: Column) -> dict[str, Column]:
    """The keyword extractor, but that it takes every minimum service for one that can't be got out of."""
    return extract.keyword_params(kind, text) | {"compels_continued_service": F.when((kind == "employment") & F.contains(F.lower(text), F.lit("minimum service")), F.lit(True))}


@query("with " + _PAPERS + "\nselect doc_id, rule_id, severity, case when place = 'e2' then 2 else 1 end as tries, count(*) as n from found group by all")
def audit_second_reading(spark, sf_dir):
    """The audit with an extractor that is wrong at first: what it makes up can't be cited, so the clause is read again."""
    acts = papers.acts(spark).where("corpus_id <> 'sra_1963'")
    found = audit.audit(_papers(spark, sf_dir), acts, _rash, again=[extract.keyword_params])[0]
    return found.groupBy("doc_id", "rule_id", "severity", "tries").agg(F.count(F.lit(1)).alias("n"))


_NORMS = {"notice_days_employee": {"p90": 60}, "escalation_percent": {"p90": 7}}
#: What a digit of a number's hash gives: a factor and what is added.
_NUMBERS = {
    "deposit_months": (1, 0), "doc__deposit_months": (1, 0), "term_months": (3, 0), "doc__term_months": (3, 0), "garden_leave_days": (10, 0), "notice_days_employee": (10, 0),
    "escalation_percent": (1, 0), "entry_notice_hours": (6, 0), "weekly_hours": (3, 30), "weekly_hours_net": (3, 27),
}
_FIELDS = sorted({f for own in rulebook.RULES.values() for f in rules.required_params(own)})


def _generated(f: str) -> str:
    digit = f"substr(md5(o_orderkey || ':{f}'), 1, 1)"
    if f == "premises_type":
        return f"case when {digit} between '0' and '4' then 'residential' when {digit} between '5' and '9' then 'non_residential' end as {f}"
    if f in _NUMBERS:
        a, b = _NUMBERS[f]
        return f"case when {digit} between '0' and '9' then {digit}::int * {a} + {b} end as {f}"
    return f"case when {digit} between '0' and '5' then true when {digit} between '6' and '9' then false end as {f}"


#: Every rule as SQL: type, id, severity, what escalates it to high, its condition.
_ALL_RULES = [
    ("employment", "R-EMP-01", "medium", "bond_present or garden_leave_days > 60", "post_termination_restraint and restricted_from_competing_or_soliciting"),
    ("employment", "R-EMP-02", "none", "", "in_term_restraint_only"),
    ("employment", "R-EMP-03", "high", "", "bond_present and (penalty_amount_stated or liquidated_damages_stated or recovery_on_early_exit or training_cost_clawback)"),
    ("employment", "R-EMP-04", "medium", "", "compels_continued_service"),
    ("employment", "R-EMP-05", "high", "", "assigns_ip and (covers_outside_work_hours or covers_off_premises)"),
    ("employment", "R-EMP-06", "medium", "", "assigns_ip and (covers_outside_work_hours or covers_off_premises or assignment_scope_unlimited or covers_anything_related_to_business) and (prior_work_carveout = false or prior_work_carveout is null)"),
    ("employment", "R-EMP-07", "medium", "", "assigns_moral_rights"),
    ("employment", "R-EMP-08", "medium", "", "notice_asymmetric"),
    ("employment", "R-EMP-09", "low", "", "notice_days_employee > 60"),
    ("employment", "R-EMP-10", "medium", "", "cause_undefined_or_vague"),
    ("employment", "R-EMP-11", "medium", "", "clawback_on_resignation"),
    ("employment", "R-EMP-12", "low", "", "perpetual and excludes_public_information = false"),
    ("employment", "R-EMP-13", "medium", "", "arbitrator_appointed_by_one_side"),
    ("employment", "R-EMP-14", "medium", "", "probation_extendable_without_limit"),
    ("employment", "R-EMP-15", "high", "", "unfilled_placeholder"),
    ("employment", "R-EMP-16", "medium", "weekly_hours_net > 48", "weekly_hours > 48"),
    ("employment", "R-EMP-17", "high", "", "settlement_conditional"),
    ("employment", "R-EMP-18", "high", "", "unpaid_work_period"),
    ("employment", "R-EMP-19", "medium", "", "material_terms_elsewhere"),
    ("loan", "R-LOAN-01", "high", "", "penal_interest_added_to_rate"),
    ("loan", "R-LOAN-02", "high", "", "penal_charges_capitalised"),
    ("loan", "R-LOAN-03", "high", "", "individual_penal_higher_than_corporate"),
    ("loan", "R-LOAN-04", "medium", "", "penal_charge_amount_undisclosed and (doc__penal_charge_quantified = false or doc__penal_quantum_withheld)"),
    ("loan", "R-LOAN-05", "high", "", "stipulated_penalty_amount and (penalty_disproportionate_to_loss or penal_charge_amount_undisclosed)"),
    ("loan", "R-LOAN-06", "high", "", "acceleration_without_notice"),
    ("loan", "R-LOAN-07", "high", "", "rate_reset_at_sole_discretion"),
    ("loan", "R-LOAN-08", "medium", "set_off_without_notice", "set_off_across_unrelated_accounts"),
    ("loan", "R-LOAN-09", "high", "", "guarantee_uncapped"),
    ("loan", "R-LOAN-10", "medium", "", "prepayment_penalty"),
    ("loan", "R-LOAN-11", "medium", "", "insurance_mandatory_named_insurer"),
    ("loan", "R-LOAN-12", "medium", "", "assignment_without_notice"),
    ("loan", "R-LOAN-13", "high", "", "repossession_without_notice"),
    ("loan", "R-LOAN-14", "medium", "", "jurisdiction_lender_city_only"),
    ("rental", "R-RENT-01", "high", "", "(deposit_months > 2 or doc__deposit_months > 2) and (premises_type = 'residential' or premises_type is null)"),
    ("rental", "R-RENT-02", "high", "", "deposit_months > 6 and premises_type = 'non_residential'"),
    ("rental", "R-RENT-03", "high", "", "forfeiture_at_sole_discretion"),
    ("rental", "R-RENT-04", "medium", "early_exit_forfeits_full_deposit", "lock_in_binds_tenant_only"),
    ("rental", "R-RENT-05", "high", "", "early_exit_forfeits_full_deposit"),
    ("rental", "R-RENT-06", "high", "", "notice_asymmetric"),
    ("rental", "R-RENT-07", "high", "", "entry_without_notice or entry_notice_hours < 24 or entry_causes_unspecified"),
    ("rental", "R-RENT-08", "medium", "", "escalation_percent > 7"),
    ("rental", "R-RENT-09", "medium", "", "escalation_undefined"),
    ("rental", "R-RENT-10", "medium", "", "(term_months > 12 or doc__term_months > 12) and doc__registration_mentioned = false"),
    ("rental", "R-RENT-11", "medium", "", "structural_repairs_on_tenant"),
    ("rental", "R-RENT-12", "medium", "", "termination_without_cure_period"),
    ("rental", "R-RENT-13", "medium", "", "auto_renews_on_landlord_terms"),
    ("rental", "R-RENT-14", "medium", "", "jurisdiction_away_from_premises"),
    ("rental", "R-RENT-15", "high", "", "deposit_forfeited_entirely_on_any_breach or forfeiture_disproportionate_to_breach"),
]
_EVERY_RULE = "p as materialized (select o_orderkey, " + ", ".join(map(_generated, _FIELDS)) + " from orders),\nfound as (" + "\n  union all ".join(
    f"select o_orderkey, '{t}' as doc_type, '{rule}' as rule_id, " + (f"case when {up} then 'high' else '{severity}' end" if up else f"'{severity}'") + f" as severity from p where {when}" for t, rule, severity, up, when in _ALL_RULES
) + ")"


def _parameter(f: str) -> Column:
    """A field of the clause of an order, from a digit of its hash."""
    digit = F.substring(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(f":{f}")).cast("binary")), 1, 1)
    if f == "premises_type":
        return F.when(digit.between("0", "4"), F.lit("residential")).when(digit.between("5", "9"), F.lit("non_residential"))
    if f in _NUMBERS:
        a, b = _NUMBERS[f]
        return F.when(digit.between("0", "9"), digit.try_cast("int") * a + b)
    return F.when(digit.between("0", "5"), F.lit(True)).when(digit.between("6", "9"), F.lit(False))


def _at_once(build) -> Column:
    """All fields in one lambda: code written out for each of them is one method, too long for Java to compile."""
    return bound(F.col("o_orderkey"), lambda _: build())


def _every_rule(spark, sf_dir):
    """Each order's hash as the parameters of a clause, in JSON, judged by the rules of each type."""
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.to_json(F.struct(*(_parameter(f).alias(f) for f in _FIELDS))).alias("params"))
    judged = audit.clause_findings(audit.supplied(rows).withColumn("doc_type", F.explode(F.array(*map(F.lit, rulebook.RULES)))), _NORMS)
    return judged.select("o_orderkey", "doc_type", F.explode("findings").alias("f")).select("o_orderkey", "doc_type", "f.rule_id", "f.severity")


@query("with " + _EVERY_RULE + "\nselect * from found")
def every_rule(spark, sf_dir):
    return _every_rule(spark, sf_dir)


@query("with " + _EVERY_RULE + """
select r.rule_id, count(f.o_orderkey) as fired, (select count(*) from orders) - count(f.o_orderkey) as silent, count(*) filter (f.severity = 'high') as high from (select unnest(""" + _list([r[1] for r in _ALL_RULES]) + """) as rule_id) r left join found f using (rule_id) group by r.rule_id""")
def every_rule_census(spark, sf_dir):
    """How often each of the 48 rules fires and stays silent."""
    known = spark.createDataFrame([(r["id"],) for own in rulebook.RULES.values() for r in own], "rule_id string")
    orders = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"))
    fired = _every_rule(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("fired"), F.count_if(F.col("severity") == "high").alias("high"))
    n = F.coalesce("fired", F.lit(0))
    return known.join(fired, "rule_id", "left").crossJoin(F.broadcast(orders)).select("rule_id", n.alias("fired"), (F.col("n") - n).alias("silent"), F.coalesce("high", F.lit(0)).alias("high"))  # orders are one row


def _catalogued(kind: str, i: int, r: dict) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    own = rules.required_fields(r)
    return f"select {text(kind)} as doc_type, {i}::int as rule_order, {text(r['id'])} as rule_id, {text(r['category'])} as category, {text(r['basis'])} as basis, {text(r['severity'])} as severity, {text(r.get('scope', 'clause'))} as scope, {text(','.join(own))} as fields, {text(json.dumps(r['when']))} as condition, count(*) filter ({' and '.join(f'{f} is not null' for f in own)}) as judged from p"


@query("with p as materialized (select o_orderkey, " + ", ".join(map(_generated, _FIELDS)) + " from orders)\n" + "\nunion all ".join(_catalogued(kind, i, r) for kind, own in rulebook.RULES.items() for i, r in enumerate(own)))
def rules_catalogue(spark, sf_dir):
    """The rules, each with how many of the orders' generated clauses say something of all its fields."""
    said = computed(spread(table(spark, sf_dir, "orders").select("o_orderkey")), "said", _at_once(lambda: F.struct(*(_parameter(f).isNotNull().alias(f) for f in _FIELDS))))
    all_said = [F.when(reduce(Column.__and__, (F.col(f"said.{f}") for f in rules.required_fields(r))), F.lit(r["id"])) for own in rulebook.RULES.values() for r in own]
    judged = said.select(F.explode(F.array_compact(F.array(*all_said))).alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("judged"))
    return readers.rules_table(spark).join(judged, "rule_id", "left").withColumn("judged", F.coalesce("judged", F.lit(0)))


@query("with " + _PAPERS + """,
grounded as (select f.*, r.section from found f join (values """ + ", ".join(f"('{r['id']}', " + (f"'{r['source']['section']}'" if r["source"].get("section") else "null") + ")" for own in rulebook.RULES.values() for r in own if r.get("source")) + """) r(rule_id, section) using (rule_id)),
ways as (select rule_id, unnest([case when section is not null then 'other section' end, 'heading alone', 'no anchor']) as poison from grounded)
select rule_id, poison, case poison when 'other section' then 'wrong section' when 'heading alone' then 'heading only' else 'no anchor' end as reason, count(*) as n from ways where poison is not null group by all""")
def poisoned_citations(spark, sf_dir):
    """Citations made wrong in three ways: all of them are withheld, each for its own reason.

    Those of equal papers are equal, so they are judged once and count for each of the papers.
    """
    copies, _, found, _ = audit.readings(_papers(spark, sf_dir), papers.acts(spark))
    judged = statutes.verify(statutes.poisoned(found.drop("reason", "verified")))
    ways = ("rule_id", "poison", F.coalesce("reason", F.lit("stands")).alias("reason"))
    own = judged.groupBy(F.col("doc_id").alias("key"), *ways).agg(F.count(F.lit(1)).alias("n"))
    times = copies.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    return own.join(times, "key").groupBy("rule_id", "poison", "reason").agg(F.sum(F.col("n") * F.col("times")).alias("n"))


def _typed(f: str) -> str:
    return f"try_cast(params::json->>'{f}' as {'varchar' if f == 'premises_type' else 'double' if f in _NUMBERS else 'boolean'}) as {f}"


_FIXED = [("employment", '{"bond_present": true, "penalty_amount_stated": true}'), ("rental", '{"deposit_months": 3, "premises_type": "residential"}'), ("loan", '{"guarantee_uncapped": true, "prepayment_penalty": true}')]
#: Without norms no value is above a percentile.
SQL["evaluate_clause"] = "with given(kind, params) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in _FIXED) + "),\nasked as (select * from given union all select kind, props from events cross join (select kind from given)),\np as materialized (select kind as doc_type, " + ", ".join(map(_typed, _FIELDS)) + " from asked)\n" + "\nunion all ".join(
    f"select doc_type, '{rule}' as rule_id, " + (f"case when {up} then 'high' else '{severity}' end" if up else f"'{severity}'") + f" as severity, '{category}' as category from p where doc_type = '{t}' and ({when})"
    for (t, rule, severity, up, when), category in ((r, next(x["category"] for x in rulebook.RULES[r[0]] if x["id"] == r[1])) for r in _ALL_RULES) if rule not in ("R-EMP-09", "R-RENT-08")
)


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Every clause of the bank, for texts that speak of what the gates ask for.
_CLAUSES = [p.text for own in papers.BANK.values() for p in own]
_LONE = "(?i)"


def _gate(f: str) -> str:
    subject = " and ".join(f"regexp_matches(text, {_text(_LONE + p)})" for p in gates.GATES[f])
    protected = f" and not (regexp_matches(text, {_text(_LONE + facts.HARASSMENT)}) and not regexp_matches(text, {_text(_LONE + facts.VAGUE_GROUND)}))" if f in gates.TERMINATION else ""
    return f"select '{f}' as field, doc_id from texts where {subject}{protected}"


@query("with said(k, said) as (values " + ", ".join(f"({k}, {_text(x)})" for k, x in enumerate(_CLAUSES)) + f"""),
texts as materialized (select doc_id, said || case when doc_id % 5 = 0 then ' Sexual harassment is dealt with.' else '' end || chr(10) || text as text from documents join said on k = doc_id % {len(_CLAUSES)}),
passed as (""" + "\n  union all ".join(map(_gate, sorted(gates.GATES))) + """)
select field, count(*) as n, sum(doc_id)::bigint as ids from passed group by field""")
def every_gate(spark, sf_dir):
    """Which documents, each behind a clause of the bank, let every gated field pass."""
    k = F.col("doc_id")
    said = F.get(F.array(*map(F.lit, _CLAUSES)), (k % len(_CLAUSES)).cast("int"))
    text = F.concat(said, F.when(k % 5 == 0, F.lit(" Sexual harassment is dealt with.")).otherwise(F.lit("")), F.lit("\n"), F.col("text"))
    fields = sorted(gates.GATES)
    asserted = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array_repeat(F.lit("true"), len(fields)))
    texts = table(spark, sf_dir, "documents").select(k, text.alias("text"))
    stopped = computed(texts, "stopped", gates.stopped(asserted, F.col("text")))  # an explosion would ask for its size first, and so work it out again
    passed = stopped.select(k, F.explode(F.array_except(F.array(*map(F.lit, fields)), "stopped")).alias("field"))
    return passed.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


_TYPES = list(guard.LEXICONS)
_EDGE = r"[^\pL\pN\pM_]"


def _shipped_score(t: str) -> str:
    lexicon = guard.LEXICONS[t]
    hits = " + ".join(f"{guard.WEIGHTS[k]} * regexp_matches(hay, {_text(f'(^|{_EDGE}){term}($|{_EDGE})')})::int" for k, terms in lexicon.items() for term in terms)
    return f"round_even(({hits}) / {sum(guard.WEIGHTS[k] * len(terms) for k, terms in lexicon.items())}, 4) as {t}"


@query("with openings(k, said) as (values " + ", ".join(f"({k}, {_text(papers.OPENINGS[t])})" for k, t in enumerate(_TYPES)) + r"""),
texts as (
  select doc_id, ['employment', 'rental', 'loan', 'lease'][doc_id % 4 + 1] as doc_type, case when doc_id % 5 = 0 then '' else a.said end || ' ' || coalesce(b.said, '') || ' ' || left(text, 200 + (doc_id % 9 * 100)::int) as text
  from documents join openings a on a.k = (doc_id // 4) % 3 left join openings b on b.k = (doc_id // 12) % 6),
hay as (select doc_id, doc_type, trim(regexp_replace(regexp_replace(translate(lower(text), '’‘', ''''''), '[^\pL\pN\pM_\s''-]', ' ', 'g'), '\s+', ' ', 'g')) as hay from texts),
scores as materialized (select doc_id, doc_type, case when hay = '' then 0 else len(string_split(hay, ' ')) end as words, """ + ", ".join(map(_shipped_score, _TYPES)) + f""" from hay),
top as (select *, greatest({', '.join(_TYPES)}) as best, case greatest({', '.join(_TYPES)}) """ + " ".join(f"when {t} then '{t}'" for t in _TYPES) + " end as slug, case doc_type " + " ".join(f"when '{t}' then {t}" for t in _TYPES) + f""" end as mine from scores),
judged as (
  select *, case when mine is null then 'unknown_type' when words < {guard.MIN_WORDS} then 'too_short' when best < {guard.MIN_SIGNAL} then 'unrecognised'
    when slug <> doc_type and best >= mine * {guard.MISMATCH_RATIO} then 'mismatch' when mine < {guard.MIN_SIGNAL} then 'unrecognised' else 'ok' end as status from top)
select doc_id, doc_type, words::int as words, {', '.join(_TYPES)}, status, case when status = 'mismatch' or (status = 'unrecognised' and best >= {guard.MIN_SIGNAL} and slug <> doc_type) then slug end as suggested from judged""")
def type_verdicts(spark, sf_dir):
    """Documents behind the openings of one type or two, read as each type and as one that is not known, by the shipped lexicons."""
    k, said = F.col("doc_id"), F.array(*(F.lit(papers.OPENINGS[t]) for t in _TYPES))
    kind = F.get(F.array(*map(F.lit, [*_TYPES, "lease"])), (k % 4).cast("int"))
    at = lambda n, m: F.get(said, (F.call_function("div", k, F.lit(n)) % m).cast("int"))
    text = F.concat(F.when(k % 5 == 0, F.lit("")).otherwise(at(4, 3)), F.lit(" "), F.coalesce(at(12, 6), F.lit("")), F.lit(" "), F.left("text", (k % 9 * 100 + 200).cast("int")))
    read = computed(table(spark, sf_dir, "documents").select(k, kind.alias("doc_type"), guard.normalised(text).alias("hay")), "hay", F.col("hay"))
    read = computed(read, "scores", guard.scores(F.col("hay")))
    read = computed(read, "verdict", guard.check(F.col("doc_type"), F.col("scores"), F.col("hay")))
    return read.select("doc_id", "doc_type", "verdict.words", *(F.col(f"scores.{t}").alias(t) for t in _TYPES), "verdict.status", "verdict.suggested")
