"""Documents that share their type and text are audited once, and each of them gets the whole result."""

import duckdb
from pyspark.sql import functions as F

from contractlens.operators import segment, statutes
from contractlens.plans import audit, papers, queries

SCHEMA = "doc_id string, doc_type string, text string"


def test_equal_texts_are_read_once(spark, monkeypatch):
    own = [tuple(r) for r in papers.papers(spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")).select(F.col("doc_id").cast("string"), "doc_type", "text").collect()]
    rows = own + [(f"{d}::b{k}", t, x) for d, t, x in own for k in range(3)] + [("other", "loan", own[0][2]), ("no text", "loan", None), ("empty", "loan", ""), ("no type", None, ""), ("nothing", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    # an extractor fails on a clause of one document, not on its copies'
    failed = segment.segment(docs.where("doc_id = '1'")).first()["clause_id"]
    errors = spark.createDataFrame([(failed,), (failed,), ("1::999::00000000",)], "clause_id string")
    seen, cut = [], segment.segment
    monkeypatch.setattr(segment, "segment", lambda docs: seen.append(docs.count()) or cut(docs))
    found, summary = audit.audit(docs, papers.acts(spark), errors=errors)
    assert seen == [4]  # three papers, and one of them as another type; the others can't be read
    by = {}
    for r in found.collect():
        d, order, digest = r["clause_id"].rsplit("::", 2)
        assert d == r["doc_id"] and int(order) == r["order"] and len(digest) == 8
        by.setdefault(d, []).append((r["rule_id"], r["order"], r["clause_text"], r["citation_span"]))
    told = {r["doc_id"]: r.asDict() for r in summary.collect()}
    assert len(told) == len(rows) == summary.count()
    assert {d for d in told if told[d].pop("unread")} == {"1"}
    for d, _, _ in own:
        for k in range(3):
            assert sorted(by[f"{d}::b{k}"]) == sorted(by[d]) and told[f"{d}::b{k}"] | {"doc_id": d} == told[d]
    assert told["other"]["type_status"] == "mismatch" and "other" not in by
    assert {d: (told[d]["doc_type"], told[d]["problem"]) for d in ("no text", "empty", "no type", "nothing")} == {"no text": ("loan", "too short"), "empty": ("loan", "too short"), "no type": (None, "unknown type"), "nothing": ("", "unknown type")}


def test_poisoned_citations_of_equal_papers_are_judged_once(spark, tmp_path, monkeypatch):
    """300 loan papers are 128 texts at most: their citations are judged by text and counted by paper."""
    ids = range(2, 902, 3)
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    judged, poison = [], statutes.poisoned
    monkeypatch.setattr(statutes, "poisoned", lambda found: judged.append(found.select("doc_id").distinct().count()) or poison(found))
    got = queries.QUERIES["poisoned_citations"](spark, str(tmp_path)).collect()
    assert 0 < judged[0] <= 128 < sum(r["n"] for r in got)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted((r["rule_id"], r["poison"], r["reason"], r["n"]) for r in got) == sorted(c.execute(queries.SQL["poisoned_citations"]).fetchall())


def test_registered_audit_reads_documents_of_many_clauses(spark, tmp_path):
    """A document of over 60 clauses has all of its findings; the library refuses it only where a ceiling is asked for."""
    forfeits = "What is taken off the deposit is at the sole discretion of the landlord, who shall tell the tenant of part {} of it by letter."
    text = papers.OPENINGS["rental"] + "\n" + "\n".join(f"{i}. {forfeits.format(i)}" for i in range(1, 66))
    spark.createDataFrame([(1, "fr", text), (2, "fr", papers.OPENINGS["rental"])], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.QUERIES["audit_full"](spark, str(tmp_path)).collect()}
    assert rows["1"]["problem"] is None and rows["1"]["clauses"] > 60 and rows["2"]["flagged"] == 0
    assert rows["1"]["flagged"] == 65 and "R-RENT-03" in rows["1"]["rules"].split(",")
