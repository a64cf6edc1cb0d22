import pytest
from pyspark.sql import functions as F

from contractlens.functions import text as tx
from contractlens.operators import docfacts, drafts, extract, facts, gates, guard, statutes, triage
from contractlens.sources import readers


def value(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


def held(spark, text, kind="employment"):
    row = spark.createDataFrame([(text,)], "t string").select(facts.read_facts(F.col("t"), F.lit(kind)).alias("f")).first()["f"].asDict()
    return {k: v for k, v in row.items() if v is not None}


@pytest.mark.parametrize(
    "text, want",
    [
        ("You owe [Insert amount here] on the day.", {"unfilled_placeholder": True}),
        ("The report [sic] is due.", {}),
        ("There is a minimum service period of two years and it is not negotiable.", {"bond_present": True, "compels_continued_service": True}),
        ("On resigning early you are liable to a recovery of upto Rs. 10,00,000 at once.", {"bond_present": True, "recovery_on_early_exit": True}),
        ("The cost of training is Rs. 50,000 for everyone.", {"training_cost_clawback": True}),
        ("Monday to Saturday, 11:00AM - 8:00PM", {"weekly_hours": 54.0, "weekly_hours_net": 48.0}),
        ("Full and final settlement is paid only upon handing in the badge.", {"settlement_conditional": True}),
        ("The induction is unpaid.", {"unpaid_work_period": True}),
        ("Leave is granted as per the company leave policy.", {"material_terms_elsewhere": True}),
        ("Secrets stay confidential and this shall survive for ever.", {"perpetual": True, "perpetual_confidentiality": True, "excludes_public_information": False}),
        ("Secrets stay confidential and this shall survive, but for what is in the public domain.", {}),
        ("We may terminate you with immediate effect at will.", {"termination_without_cure": True, "cause_undefined_or_vague": True}),
        ("We may terminate you with immediate effect after an inquiry.", {}),
        ("Sexual harassment leads to dismissal with immediate effect.", {}),
        ("We may terminate the contract for poor performance.", {"termination_without_cure": True, "cause_undefined_or_vague": True}),
        ("We may terminate the contract for poor performance after a warning.", {}),
    ],
)
def test_facts(spark, text, want):
    assert held(spark, text) == want


def test_other_types_read_blanks_alone(spark):
    assert held(spark, "A minimum service period and [Insert name]", "loan") == {"unfilled_placeholder": True}


def test_evidence_is_widened_and_cut(spark):
    assert value(spark, lambda t: tx.evidence(t, "licen[cs]e"), "a  sublicenses\nhere", "none", "x" * 200 + "license") == ["sublicenses", None, "x" * 90 + "..."]


def test_gates(spark):
    probe = lambda f: lambda t: gates.gated(f, F.lit(True), t)
    assert value(spark, probe("escalation_undefined"), "The rent may be revised.", "The rent is due.", "Fees may be revised.") == [True, None, None]
    assert value(spark, probe("cause_undefined_or_vague"), "Termination for sexual harassment.", "Termination for any reason.") == [None, True]
    assert value(spark, lambda t: gates.gated("escalation_undefined", F.lit(False), t), "nothing of it") == [False]
    assert value(spark, probe("garden_leave_days"), "no gate") == [True]


def test_document_facts(spark):
    near = lambda t: docfacts.in_provision(t, docfacts.PENAL, docfacts.AMOUNT)
    assert value(spark, near, "A penal charge of 2% is due.", "2. The sum is Rs. 5,000.\n3. DEFAULT INTEREST is due.", "penal charge " + "x" * 300 + " 2%") == [True, False, False]
    withheld = lambda t: docfacts.in_provision(t, docfacts.PENAL, docfacts.WITHHELD)
    assert value(spark, withheld, "Penal charges, as the bank may decide, are due.", "Penal charges are due.") == [True, False]
    assert value(spark, docfacts.term_months, "a term of twelve (12) months", "lease period: 24 months", "term of 11 months, later a term of 3 years", "none") == [12.0, 24.0, 36.0, None]
    row = spark.createDataFrame([("", "rental"), (None, "loan")], "t string, k string").select(docfacts.read_document(F.col("t"), F.col("k")).alias("f")).collect()
    assert row[0]["f"]["doc__registration_mentioned"] is False and row[0]["f"]["doc__term_months"] is None
    assert row[1]["f"]["doc__penal_charge_quantified"] is False and row[1]["f"]["doc__registration_mentioned"] is None


def test_registered_is_no_mention(spark):
    assert value(spark, lambda t: tx.matches(t, docfacts.REGISTRATION), "it shall not be registered", "subject to registration") == [False, True]


def test_guard(spark):
    lease = "The tenant pays rent to the landlord for the premises under this lease deed. The security deposit is held by the lessor and the lessee may not sublet. " * 8
    rows = [(lease, "rental"), (lease, "loan"), ("too short", "rental"), ("word " * 200, "rental"), (None, "rental"), (lease, "other"), ("किराया " * 200, "rental")]
    df = spark.createDataFrame(rows, "t string, k string")
    df = tx.computed(df, "hay", guard.normalised(F.col("t")))
    df = tx.computed(df, "s", guard.scores(F.col("hay")))
    got = [tuple(r) for r in df.select(guard.check(F.col("k"), F.col("s"), F.col("hay")).alias("v")).select("v.status", "v.suggested").collect()]
    assert got == [("ok", None), ("mismatch", "rental"), ("too_short", None), ("unrecognised", None), ("too_short", None), ("unknown_type", None), ("unrecognised", None)]


def test_triage(spark):
    reason = lambda t: triage.decide(t)["reason"]
    assert value(spark, reason, "either side may terminate", "severability and counterparts", "the tenant shall pay a deposit", "exhibit one", "short", "plain words " * 20, None) == ["safety", "boilerplate", "risk", "inert", "short", "unclear", "short"]


def test_anchor_and_widening(spark):
    anchors = F.array(F.lit("security deposit"), F.lit("two months"))
    assert value(spark, lambda t: statutes.anchor_present(anchors, t), "The Security-Deposit is", "two of the 12[months", "no") == [True, True, False]
    long = "a" * 1000 + " two months " + "b" * 900
    assert [len(x) for x in value(spark, lambda t: statutes.widened(t, anchors), long, "short")] == [1800, 5]


def test_html_and_lines(spark):
    page = "<html><head><style>p{}</style></head><nav>Menu</nav><p>One&nbsp;two</p><table><tr><td>x</td></tr></table><p>A &amp; B</p></html>"
    assert value(spark, readers.html_text, page, None) == ["Menu\nOne two\nA & B", ""]
    assert value(spark, lambda h: readers.html_text(h, False), page) == ["One two x A & B"]
    assert value(spark, readers.repaired_lines, "The tenant\nshall pay.\nThe landlord\n\nagree-\nment") == ["The tenant shall pay.\nThe landlord\nagreement"]


def test_draft_check(spark):
    texts = ["See section 74 of the Contract.", "See section 12.", 'The lease says "the deposit is never ever given back to anyone" here.', "This is **bold**.", "It is not market standard."]
    check = lambda t: drafts.problems(t, F.array(F.lit("74")), F.array(F.lit("indian_contract_act_1872")), F.array(F.lit("The deposit stays.")), F.lit(False))
    assert value(spark, check, *texts) == [[], ["section"], ["quote"], ["markdown"], ["comparison"]]


def test_model_answers():
    assert extract.best_object('noise {"a": 1} then {"category": "x", "params": {"p": [1, 2]}} end', {"category", "params"}) == '{"category": "x", "params": {"p": [1, 2]}}'
    assert extract.best_object('{"category": "x", "params": {"p": tr', {"category"}) is None
    assert extract.best_object('{"category": "x", "params": {"p": [1, 2', {"category"}) == '{"category": "x", "params": {"p": [1, 2]}}'
    assert extract.best_object(None, {"category"}) is None
