"""Triage: which clauses are worth a costly reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contractlens.functions.text import bound, contains_any, count_present

#: Phrases that keep a clause whatever else it holds (fixed values).
SAFETY = [
    "minimum period", "minimum service", "liquidated damages", "shall stand forfeited", "non-compete", "non compete", "restraint of trade", "shall not compete",
    "restricted period", "sole discretion", "sole opinion", "in perpetuity", "irrevocably assign", "outside the usual hours", "outside normal working",
    "off the premises", "moral rights", "clawback", "penal interest", "without notice", "immediate effect", "set off", "personal guarantee",
    "shall be forfeited", "bond amount", "service bond", "days notice", "days written notice", "notice of resignation", "notice period",
    "months notice", "terminate this", "may terminate",
]
#: Markers of boilerplate and of risk (fixed values).
INERT = [
    "capitalized terms", "shall have the meanings", "in witness", "counterparts", "severability", "headings are for convenience", "entire agreement",
    "notices shall be sent to", "signature", "witnesseth", "recitals", "table of contents", "exhibit ", "definitions",
]
RISKY = [
    "shall not", "restrict", "terminat", "penalty", "forfeit", "assign", "invention", "deposit", "notice", "compet", "solicit", "confidential", "indemnif",
    "waive", "discretion", "shall pay", "sum of", "bond", "minimum of", "liquidated", "arbitrat", "jurisdiction", "escalat", "renew", "sublet",
    "lock-in", "lock in", "clawback", "recover", "damages", "breach", "obligat", "covenant",
]
#: Under so many clauses a document is read in full.
MIN_CLAUSES = 25
SHORT_CHARS = 150


def safety_phrase(text: Column) -> Column:
    """The first safety phrase that occurs, or null."""
    low = F.lower(text)
    return F.get(F.filter(F.array(*map(F.lit, SAFETY)), lambda p: F.contains(low, p)), F.lit(0))


def decide(text: Column, safety=SAFETY, inert=INERT, risky=RISKY) -> Column:
    """(keep, reason, n_risk, n_inert) of a clause."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # each is worked out once: a lambda's body is, for each phrase
    counts = lambda x: F.struct(x.alias("low"), count_present(x, risky).alias("n_risk"), count_present(x, inert).alias("n_inert"))
    return bound(bound(bound(low, counts), lambda c: F.struct(_reason(c, safety).alias("reason"), c["n_risk"].alias("n_risk"), c["n_inert"].alias("n_inert"))), lambda c: F.struct(c["reason"].isin("safety", "risk", "unclear").alias("keep"), c["reason"].alias("reason"), c["n_risk"].alias("n_risk"), c["n_inert"].alias("n_inert")))


def _reason(c: Column, safety) -> Column:
    return (
        F.when(contains_any(c["low"], safety), F.lit("safety"))
        .when((c["n_inert"] >= 2) & (c["n_risk"] <= 1), F.lit("boilerplate"))
        .when(c["n_risk"] >= 1, F.lit("risk"))
        .when(c["n_inert"] > 0, F.lit("inert"))
        .when(F.length(c["low"]) < SHORT_CHARS, F.lit("short"))
        .otherwise(F.lit("unclear"))
    )
