"""The message to the other side: numbered points, and a check that it states no law of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.functions.text import squeeze

#: Titles of the acts (fixed values).
ACTS = {
    "indian_contract_act_1872": "the Indian Contract Act, 1872",
    "copyright_act_1957": "the Copyright Act, 1957",
    "specific_relief_act_1963": "the Specific Relief Act, 1963",
    "transfer_of_property_act_1882": "the Transfer of Property Act, 1882",
    "registration_act_1908": "the Registration Act, 1908",
    "model_tenancy_act_2021": "the Model Tenancy Act, 2021",
    "rbi_penal_charges_2023": "the RBI circular on penal charges dated 18 August 2023",
}
#: Phrases that compare with other contracts (fixed values).
COMPARISONS = ["comparable agreement", "similar agreement", "similar contract", "market standard", "not standard", "industry standard", "unusual compared", "atypical", "uncommon in"]
PAPERS = {"employment": "the offer letter", "rental": "the rent agreement", "loan": "the loan agreement"}
QUOTE, MIN_QUOTE, QUOTE_KEY = 260, 25, 60


def act_title(act: Column) -> Column:
    return F.coalesce(*(F.when(act == a, F.lit(t)) for a, t in ACTS.items()))


def legal_sentence(basis: Column, act: Column, section: Column) -> Column:
    """The sentence of a point that states law; null for a norm."""
    title = act_title(act)
    return (
        F.when((basis == "statutory") & title.isNotNull() & section.isNotNull(), F.concat(F.lit("See section "), section, F.lit(" of "), title, F.lit(".")))
        .when((basis == "regulatory") & title.isNotNull(), F.concat(F.lit("See "), title, F.lit(", which binds regulated lenders.")))
        .when((basis == "policy") & title.isNotNull() & section.isNotNull(), F.concat(F.lit("Section "), section, F.lit(" of "), title, F.lit(" is the benchmark, binding where a state has adopted it.")))
        .when((basis == "policy") & title.isNotNull(), F.concat(F.lit("The benchmark is "), title, F.lit(", binding where a state has adopted it.")))
    )


def clause_quote(text: Column, heading: Column, limit: int = QUOTE) -> Column:
    """A clause without its heading, cut at a length."""
    flat, head = squeeze(text), squeeze(F.coalesce(heading, F.lit("")))
    bare = F.trim(F.when((head != "") & F.startswith(flat, head), F.substring(flat, F.length(head) + 1, F.length(flat))).otherwise(flat))
    return F.when(F.length(bare) > limit, F.concat(F.rtrim(F.left(bare, F.lit(limit))), F.lit("..."))).otherwise(bare)


def draft(findings: DataFrame) -> DataFrame:
    """(doc_id, draft) from verified risky findings; documents without any have no row."""
    own = findings.where("verified and risky")
    where = F.when(F.coalesce(F.trim("heading"), F.lit("")) != "", F.concat(F.lit('Clause "'), F.trim("heading"), F.lit('"'))).otherwise(F.lit("One clause"))
    legal = legal_sentence(F.col("basis"), F.col("source.act"), F.col("source.section"))
    quote = clause_quote(F.col("clause_text"), F.col("heading"))
    point = F.concat(where, F.lit(". "), F.rtrim(F.col("message"), F.lit(".")), F.lit("."), F.coalesce(F.concat(F.lit(" "), legal), F.lit("")), F.when((F.col("scope") != "document") & (quote != ""), F.concat(F.lit('\n   As drafted: "'), quote, F.lit('"'))).otherwise(F.lit("")))
    rows = own.select("doc_id", "doc_type", F.struct("order", "rule_order", point.alias("point")).alias("p"))
    sorted_ = rows.groupBy("doc_id", "doc_type").agg(F.sort_array(F.collect_list("p")).alias("points"))  # findings of one document
    paper = F.coalesce(*(F.when(F.col("doc_type") == k, F.lit(v)) for k, v in PAPERS.items()), F.lit("the draft"))
    n = F.size("points")
    one = n == 1
    text = F.array_join(F.transform("points", lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p["point"])), "\n\n")
    opening = F.concat(F.lit("I have read "), paper, F.lit(" and would like to discuss "), n.cast("string"), F.when(one, F.lit(" point")).otherwise(F.lit(" points")), F.lit(" before I sign.\n\n"))
    closing = F.concat(F.lit("\n\nCould we talk "), F.when(one, F.lit("it")).otherwise(F.lit("them")), F.lit(" through first?"))
    return sorted_.select("doc_id", F.concat(opening, text, closing).alias("draft"))


def checked_draft(first: Column, second: Column, template: Column, wrong) -> Column:
    """A model's message, its second try if the first states what the findings don't support, else the template.

    wrong: a message to its :func:`problems`.
    """
    sound = lambda text: F.coalesce((F.trim(text) != "") & (F.size(wrong(text)) == 0), F.lit(False))
    return F.when(sound(first), first).when(sound(second), second).otherwise(template)


def straight(x: Column) -> Column:
    return F.translate(F.coalesce(x, F.lit("")), "“”„‟«»‘’", '""""""' + "''")


def problems(text: Column, sections: Column, acts: Column, passages: Column, has_norm: Column) -> Column:
    """What a drafted message states that the findings don't support, as an array.

    sections, acts and passages are arrays of the findings' sections, acts and texts (with headings).
    """
    cited = F.regexp_extract_all(text, F.lit(r"[Ss]ection\s+(\d+[A-Za-z]?)"), F.lit(1))
    named = F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+Act(?:,?\s+\d{4})?)"), F.lit(1)), F.lower)
    titles = F.transform(acts, lambda a: F.lower(act_title(a)))
    quoted = F.filter(F.split(straight(text), '"'), lambda q, i: i % 2 == 1)
    flat = F.transform(quoted, lambda q: F.lower(F.rtrim(squeeze(q), F.lit(". "))))
    hay = F.transform(passages, lambda p: F.lower(squeeze(straight(p))))
    unfound = F.exists(flat, lambda q: (F.length(q) >= MIN_QUOTE) & ~F.exists(hay, lambda h: F.contains(h, F.left(q, F.lit(QUOTE_KEY)))))
    compares = F.exists(F.array(*map(F.lit, COMPARISONS)), lambda p: F.contains(F.lower(text), p))
    return F.array_compact(
        F.array(
            F.when(F.exists(cited, lambda s: ~F.array_contains(sections, s)), F.lit("section")),
            F.when(F.exists(named, lambda n: ~F.exists(titles, lambda t: F.contains(t, n) | F.contains(n, t))), F.lit("act")),
            F.when(unfound, F.lit("quote")),
            F.when(F.contains(text, F.lit("**")) | F.contains(text, F.lit("##")), F.lit("markdown")),
            F.when(compares & ~has_norm, F.lit("comparison")),
        )
    )
