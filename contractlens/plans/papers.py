"""Papers of our own, put together from a bank of clauses, and small acts to cite from.

A paper is an opening that reads like its type, and those clauses of its type that a hash of its
number picks.  What each clause should raise is written beside it, so a whole audit can be checked
against plain counting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.operators import rulebook


@dataclass(frozen=True)
class Paragraph:
    """A clause: its code, title and text, and the (rule, severity) pairs that it raises.

    whole: its findings are of the whole document and stand at its first clause.
    """

    code: str
    title: str
    text: str
    raises: tuple[tuple[str, str], ...] = ()
    whole: bool = False


OPENINGS = {
    "employment": "This offer letter sets out the employment of the candidate. The employer engages the employee in the designation named above; salary and stipend are part of the remuneration on the payroll, an appointment letter follows, and the joining date is agreed by mail. Probation, appraisal, duties, reporting and benefits are explained to the employee in person by the company, and the intern is told of the internship in the same way. The candidate reads it at home, asks what seems unclear, and signs on the last page, where the employer signs as well. Nothing in this opening adds a duty or takes a right away; it says who the two sides are and what the words used below mean to both of them, so that neither needs to guess at it later.",
    "rental": "This rent agreement is made between the landlord, who is the lessor and licensor, and the tenant, who is the lessee and licensee. The premises are let furnished under this lease deed, and the tenancy gives possession to the tenant, who may occupy the house and not sublet it. Rent, maintenance, society dues and utilities are paid month by month. The two sides met at the house, walked through all of its rooms, and wrote down what they saw there. Nothing in this opening adds a duty or takes a right away; it says who the two sides are and what the words used below mean to both of them, so that neither needs to guess at it later. Copies are kept by each side in a safe place.",
    "loan": "This loan agreement is made between the lender and the borrower. The principal amount is paid out at disbursement and comes back in each instalment, called the emi, over the tenure of the loan. Prepayment, foreclosure, moratorium, amortisation and the processing fee are told in the key fact statement, as is every penal charge. The repayment plan, the interest rate, the sanction and the credit limit are printed beside it. Nothing in this opening adds a duty or takes a right away; it says who the two sides are and what the words used below mean to both of them, so that neither needs to guess at it later. The borrower keeps one copy and the lender keeps the other one in its file for as long as the loan is open.",
}
BANK = {
    "employment": (
        Paragraph("e1", "LATER WORK", "Following the termination of this engagement the employee shall not compete with the company in the same city for a year.", (("R-EMP-01", "medium"),)),
        Paragraph("e2", "LENGTH OF SERVICE", "There is a minimum service period of two years, and liquidated damages are due to the company where it is cut short.", (("R-EMP-03", "high"),)),
        Paragraph("e3", "WORKING TIME", "The office is open Monday to Saturday, 9:00 AM to 8:00 PM, and each member of the team is at the desk in that time.", (("R-EMP-16", "high"),)),
        Paragraph("e4", "LEAVING", "The full and final settlement and the relieving letter are handed over only upon the return of all things lent to the employee.", (("R-EMP-17", "high"),)),
        Paragraph("e5", "FIRST WEEKS", "The induction of two weeks is unpaid for each new joiner, and it starts on the first working day of the month.", (("R-EMP-18", "high"),)),
        Paragraph("e6", "BONUS", "A joining bonus of [Insert amount here] is paid out with the first salary that falls due after the joining date.", (("R-EMP-15", "high"),)),
        Paragraph("e7", "TIME OFF", "Leave is granted as per the company leave policy, which is kept in the office and shown there to those who ask.", (("R-EMP-19", "medium"),)),
        Paragraph("e8", "SECRETS", "What is learned at work stays confidential, and this duty shall survive the end of the work for all time to come.", (("R-EMP-12", "low"),)),
        Paragraph("e9", "DISPUTES", "A dispute goes to an arbitrator appointed by the company, who hears both sides and writes down the outcome.", (("R-EMP-13", "medium"),)),
        Paragraph("e10", "ENDING IT", "We may terminate you with immediate effect where we find that to be right, and we tell you so in writing.", (("R-EMP-10", "medium"),)),
        Paragraph("e11", "PAY TALKS", "Pay is talked over once a year between the employee and the head of the team, who writes the outcome down."),
    ),
    "rental": (
        Paragraph("r1", "DEPOSIT", "The tenant shall pay a security deposit equal to six (6) months rent before the keys are handed over to the tenant.", (("R-RENT-01", "high"),), whole=True),
        Paragraph("r2", "DEDUCTIONS", "What is taken off the deposit is at the sole discretion of the landlord, who shall tell the tenant of it by letter.", (("R-RENT-03", "high"),)),
        Paragraph("r3", "VISITS", "The landlord may enter the premises without prior notice to the tenant and shall leave them as they were found.", (("R-RENT-07", "high"),)),
        Paragraph("r4", "LOCK-IN", "The tenant shall not vacate before the last day, and the landlord may terminate this agreement at any time by letter.", (("R-RENT-04", "medium"),)),
        Paragraph("r5", "BREACH", "Any breach, howsoever minor, means that the deposit is kept by the landlord, who shall say so in a letter to the tenant.", (("R-RENT-15", "high"),)),
        Paragraph("r6", "REPAIRS", "All structural repairs are for the lessee to arrange at own cost, and the lessor shall be told when they are done.", (("R-RENT-11", "medium"),)),
        Paragraph("r7", "NOTICE", "The tenant shall give three (3) months written notice, and the landlord gives fifteen (15) days notice in writing.", (("R-RENT-06", "high"),)),
        Paragraph("r8", "TERM", "The tenancy runs for a period of 24 months from the day on which the keys are handed over, and shall then come to an end.", (("R-RENT-10", "medium"),), whole=True),
        Paragraph("r9", "GARDEN", "The garden shall be watered by the tenant in summer, and the tools for it stand in the shed behind the house."),
    ),
    "loan": (
        Paragraph("l1", "LATE PAYMENT", "Where an instalment is late, penal interest is added to the rate of interest until the arrears have been paid up.", (("R-LOAN-01", "high"), ("R-LOAN-04", "medium"))),
        Paragraph("l2", "DEFAULT", "On a default the whole balance is immediately due without notice, and the borrower shall pay it at the branch.", (("R-LOAN-06", "high"),)),
        Paragraph("l3", "RATE", "The lender may reset the interest rate at its sole discretion, and the borrower shall pay the new one from then on.", (("R-LOAN-07", "high"),)),
        Paragraph("l4", "OTHER MONEY", "The lender may set off what it is owed against any other account of the borrower that is held at the same branch.", (("R-LOAN-08", "medium"),)),
        Paragraph("l5", "THE SECURITY", "The lender may take possession of the security without notice to the borrower and shall keep it in a safe place.", (("R-LOAN-13", "high"),)),
        Paragraph("l6", "LATE SUMS", "Arrears of any penal charge shall be compounded with the balance at the end of the month in which they fell due.", (("R-LOAN-02", "high"), ("R-LOAN-04", "medium"))),
        Paragraph("l7", "STATEMENTS", "The lender shall send a statement of the account twice a year, and the borrower is free to ask for one in between."),
    ),
}


def picked(number: Column, code: str) -> Column:
    """Whether the paper of a number has a clause: five in eight of them do."""
    return F.substring(F.md5(F.concat_ws(":", number.cast("string"), F.lit(code)).cast("binary")), 1, 1).isin(list("0123456789"))


def kind(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BANK)), F.pmod(number, F.lit(3)).cast("int") + 1)


def papers(numbers: DataFrame, number: str = "doc_id") -> DataFrame:
    """(doc_id, doc_type, text) of the paper of each number."""

    def text(t: str) -> Column:
        own = F.array_compact(F.array(F.lit(f"OPENING\x01{OPENINGS[t]}"), *(F.when(picked(F.col(number), p.code), F.lit(f"{p.title}\x01{p.text}")) for p in BANK[t])))
        line = lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), F.replace(p, F.lit("\x01"), F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(".1 "))))
        return F.array_join(F.transform(own, line), "\n")

    own = numbers.select(F.col(number), kind(F.col(number)).alias("doc_type"))
    return own.select(F.col(number).alias("doc_id"), "doc_type", F.coalesce(*(F.when(F.col("doc_type") == t, text(t)) for t in BANK)).alias("text"))


def acts(spark: SparkSession) -> DataFrame:
    """(corpus_id, text) of small acts of our own that say what the rules rest on, section by section."""
    said: dict[str, dict[str, list[str]]] = {}
    for own in rulebook.RULES.values():
        for r in own:
            if s := r.get("source"):
                subject = s.get("provision") or s.get("query") or "agreements of this kind"
                said.setdefault(s["corpus_id"], {}).setdefault(s.get("section") or "1", []).append(f"as to {subject} it is laid down here that {', '.join(r['anchors'])} is what holds between the two sides")
    tail = "It holds for every agreement of its kind, and nothing in it turns on what the parties may have written otherwise."
    rows = [(c, "\n".join(f"{k}. This is the provision. {'. '.join(v)}. {tail}" for k, v in sections.items())) for c, sections in said.items()]
    return spark.createDataFrame(rows, "corpus_id string, text string")
