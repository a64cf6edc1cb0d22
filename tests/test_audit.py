"""Segmentation, cleaning and the whole audit on small papers of our own."""

import os

import pytest
from pyspark.sql import functions as F

from contractlens.operators import furniture, rulebook, segment, versions
from contractlens.plans import audit
from contractlens.streaming import stream
from tests.harness import DATA

LEASE = """RENT AGREEMENT BETWEEN THE PARTIES NAMED BELOW FOR THE HOUSE

1. TERM
1.1 The tenancy runs for a period of 24 months from the first of June and the lessee shall not vacate before its end. The lessor may terminate this agreement at any time. The paper shall not be registered with anyone.
2. DEPOSIT
2.1 The lessee shall pay a security deposit equal to six (6) months rent to the lessor. Upon any breach, howsoever minor, the entire security deposit is forfeit, at the sole discretion of the lessor, who may deduct what is owed.
3. ENTRY
3.1 The lessor may enter the premises and inspect them at any time without prior notice to the tenant, and the landlord keeps a key.
4. USE
4.1 The premises are for living only; the lessee pays rent, electricity, water, society maintenance and utilities each month and keeps the lease deed, and the landlord gives possession furnished. The tenant, lessee and licensee mean one and the same person here, the landlord, lessor and licensor likewise, and none may sublet or occupy beyond the tenancy.
"""


def test_numbers_must_follow_on():
    lines = "1. Scope\n1.1 first item\n2. Duties,\n1. unwelcome acts,\n2. Duties\n2.1 second item\nand its body".split("\n")
    assert segment.cut_at("dotted", lines) == ["1. Scope\n1.1 first item\n2. Duties,\n1. unwelcome acts,", "2. Duties\n2.1 second item\nand its body"]


def test_sizes():
    assert segment.hard_cut("One. Two; three. " + "x" * 10, 9) == ["One. Two;", "three.", "xxxxxxxxxx"]
    assert segment.tidy(["a" * 60, "b" * 10, "c" * 5000, "d" * 70]) == ["a" * 60 + "\n" + "b" * 10, "d" * 70]
    assert segment.tidy([]) == [] and segment.score([], 10) == -1 and segment.score(["a" * 100], 1000) == -1
    assert segment.score(["a" * 100], 100) == pytest.approx(1.15)


def test_letter_openings_are_no_clauses():
    assert not segment.operative("Date: 3 June\nDear Candidate") and segment.operative("Date: 3 June\nYou shall begin.")


def test_clauses_keep_their_place(spark):
    got = segment.segment(spark.createDataFrame([("d", "rental", LEASE), ("none", "rental", None), ("empty", "rental", "")], "doc_id string, doc_type string, text string")).orderBy("order").collect()
    assert {r["doc_id"] for r in got} == {"d"} and len(got) >= 4
    for r in got:
        assert LEASE[r["char_start"] : r["char_start"] + 60] == r["text"][:60] and r["char_end"] - r["char_start"] == len(r["text"])


def test_furniture(spark):
    text = "Acme Pvt Ltd\nfirst clause text\nPage 1 of 2\nAcme Pvt Ltd\nsecond clause text\nPage 2 of 2\nshort\nshort"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(furniture.strip_repeating_lines(F.col("t"))).collect()
    assert [r[0] for r in got] == ["first clause text\nsecond clause text\nshort\nshort", None, ""]
    banner = "last words.\nPRICING AND FEES\n\nClauses 4-10 | Rate\n4. Next"
    assert spark.createDataFrame([(banner,)], "t string").select(furniture.strip_section_banners(F.col("t"))).first()[0] == "last words.\n\n4. Next"


def test_pages(spark):
    rows = [("d", p, i, x) for p in (1, 2) for i, x in enumerate([f"Head {p}", "", f"text of part {p} " + "w" * 120, "more", "more still", f"- {p} of 2 -"])]
    kept = furniture.positional_furniture(spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, line string")).where("line <> ''").orderBy("page_no", "line_no").collect()
    assert [r["line"][:12] for r in kept][:2] == ["text of part", "more"]
    one = spark.createDataFrame([("d", 1, 0, "Head 1"), ("d", 1, 1, "page 1")], "doc_id string, page_no int, line_no int, line string")
    assert furniture.positional_furniture(one).count() == 2


def acts():
    out = {}
    for own in rulebook.RULES.values():
        for r in own:
            if s := r.get("source"):
                out.setdefault(s["corpus_id"], {}).setdefault(s.get("section") or "1", []).extend([*r["anchors"], s.get("provision") or s.get("query") or ""])
    tail = ". It holds for every agreement of its kind, and nothing in it turns on what the parties may have written otherwise."
    return [(c, "\n".join(f"{k}. This provision says " + "; ".join(v) + tail for k, v in d.items())) for c, d in out.items()]


def test_whole_audit(spark):
    docs = spark.createDataFrame([("lease", "rental", LEASE), ("wrong", "loan", LEASE), ("tiny", "rental", "no"), ("odd", "other", LEASE), ("null", "rental", None)], "doc_id string, doc_type string, text string")
    found, summary = audit.audit(docs, spark.createDataFrame(acts(), "corpus_id string, text string"))
    rows = {r["doc_id"]: r for r in summary.collect()}
    assert set(rows["lease"]["rules"].split(",")) >= {"R-RENT-01", "R-RENT-03", "R-RENT-04", "R-RENT-07", "R-RENT-10", "R-RENT-15"}
    assert rows["lease"]["type_status"] == "ok" and rows["lease"]["draft_allowed"] and rows["lease"]["high"] >= 4
    assert (rows["wrong"]["type_status"], rows["wrong"]["flagged"], rows["wrong"]["draft_allowed"]) == ("mismatch", 0, False)
    assert (rows["tiny"]["problem"], rows["odd"]["problem"], rows["null"]["problem"]) == ("too short", "unknown type", "too short")
    scoped = [r for r in found.where("rule_id = 'R-RENT-10'").collect()]
    assert len(scoped) == 1 and scoped[0]["citation_span"].startswith("17.") and not scoped[0]["from_text"]
    # without statutes grounded findings are withheld, norms stay
    bare = audit.audit(docs.where("doc_id = 'lease'"))[0]
    assert {r["basis"] for r in bare.select("basis").distinct().collect()} == {"norm"}


def test_drafts_differ(spark):
    schema = "doc_id string, idx int, heading string, text string"
    old = spark.createDataFrame([("d", 0, "1. Deposit", "the deposit is three months of rent in all"), ("d", 1, "2. Notice", "notice of one month"), ("d", 2, None, "this clause will go away entirely")], schema)
    new = spark.createDataFrame([("d", 0, "2. Notice", "notice of one month"), ("d", 1, "1. Deposit", "the deposit is two months of rent in all"), ("d", 2, None, "fresh words of another kind")], schema)
    pairs = versions.match_clauses(old, new)
    assert {(r["old_idx"], r["new_idx"]) for r in pairs.collect()} == {(1, 0), (0, 1), (2, None), (None, 2)}
    f = "doc_id string, idx int, rule_id string, severity string"
    before = spark.createDataFrame([("d", 0, "A", "high"), ("d", 1, "B", "low"), ("d", 1, "E", "low"), ("d", 2, "C", "low")], f)
    after = spark.createDataFrame([("d", 1, "A", "medium"), ("d", 0, "B", "low"), ("d", 2, "D", "low")], f)
    got = {r["rule_id"]: (r["status"], r["severity"]) for r in versions.diff(pairs, old, new, before, after).collect()}
    assert got == {"A": ("REWORDED", "medium"), "B": ("PERSISTED", "low"), "E": ("VANISHED", "low"), "C": ("RESOLVED", "low"), "D": ("NEW", "low")}


def test_stream_of_documents(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "doc_id string, doc_type string, text string"
    spark.createDataFrame([("lease", "rental", LEASE)], schema).write.json(str(source))
    query = stream.run_per_batch(spark.readStream.schema(schema).json(str(source)), segment.segment, str(out), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() >= 4


def test_token_budget_stream(spark, tmp_path):
    rows = [("k", 0, 50), ("k", 10_000_000, 60), ("k", 20_000_000, 40), ("k", 70_000_000, 50)]
    spark.createDataFrame(rows, "key string, us long, tokens long").coalesce(1).write.json(str(tmp_path / "calls"))
    calls = spark.readStream.schema("key string, us long, tokens long").json(str(tmp_path / "calls"))
    q = stream.token_budget(calls, 100).writeStream.format("memory").queryName("budget").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r["us"], r["used"], r["admitted"]) for r in spark.table("budget").orderBy("us").collect()]
    assert got == [(0, 0, True), (10_000_000, 50, False), (20_000_000, 50, True), (70_000_000, 40, True)]


def test_greedy_near_duplicates(spark):
    from contractlens.operators import curate

    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6)]
    docs = spark.createDataFrame([(i,) for i in range(1, 8)], "doc_id long")
    got = {r["doc_id"]: (r["kept"], r["match"]) for r in curate.kept_documents(spark.createDataFrame(edges, "a long, b long"), docs).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (False, 3), 5: (False, 1), 6: (True, None), 7: (True, None)}


def test_router(spark):
    from contractlens.operators import router

    rows = [(i, ("the tenant shall forfeit the deposit on breach number %d" if i % 2 else "headings are for ease of reading only %d") % (i % 7), i % 2) for i in range(80)]
    fitted, swept = router.train(spark.createDataFrame(rows, "clause_id long, text string, label int"), terms=50)
    kept = {r["clause_id"] % 2: r["keep"] for r in fitted.transform(spark.createDataFrame(rows[:2], "clause_id long, text string, label int")).collect()}
    assert kept[1] and swept.count() == 13 and fitted.threshold >= 0.2
    with pytest.raises(ValueError):
        router.train(spark.createDataFrame(rows[:6], "clause_id long, text string, label int"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_registered_router_keeps_its_terms(spark, monkeypatch):
    """The vocabulary of the registered query is all terms in two documents or more, up to TERMS, and its features are tf-idf."""
    from contractlens.operators import router
    from contractlens.plans import queries

    train, seen = router.train, {}

    def spy(rows, *a, **k):
        seen["fit"] = router.held_out(rows, "doc_id").where("not test")
        seen["fitted"], swept = train(rows, *a, **k)
        return seen["fitted"], swept

    monkeypatch.setattr(router, "train", spy)
    assert queries.QUERIES["router_lr"](spark, DATA).count() == 13
    fit, fitted = seen["fit"].cache(), seen["fitted"]
    weights = {(r[0], r[1]): r[2] for r in router.tfidf(fit, "doc_id", "text").collect()}
    vocabulary = fitted.words.stages[-1].vocabulary
    assert len(vocabulary) == min(len({t for _, t in weights}), router.TERMS) > 500
    if len(vocabulary) < router.TERMS:
        for r in router._weigh(fitted.words.transform(fit), fitted.idf).select("doc_id", "features").limit(5).collect():
            own = {vocabulary[i]: x for i, x in zip(r["features"].indices.tolist(), r["features"].values.tolist(), strict=True)}
            assert own == pytest.approx({t: x for (d, t), x in weights.items() if d == r["doc_id"]})


def test_registered_drafts_keep_short_lines(spark, tmp_path):
    """Every line of either draft has one row, however short."""
    from contractlens.plans import queries

    text = "short one\nshort two\nalpha beta gamma delta\nx\n\nshort one\n" + "a line of more than forty characters stands here too"
    spark.createDataFrame([(1, text), (2, "tiny"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    old, new = queries._drafts(spark, str(tmp_path))
    got = queries.QUERIES["draft_diff_fuzzy"](spark, str(tmp_path)).collect()
    for side, df in (("old_idx", old), ("new_idx", new)):
        want = sorted((r["doc_id"], r["idx"]) for r in df.collect())
        assert sorted((r["doc_id"], r[side]) for r in got if r[side] is not None) == want and len(want) > 5
    assert (1, 2, 2) in {(r["doc_id"], r["old_idx"], r["new_idx"]) for r in got}  # reworded, 22 characters


def test_registered_rules_read_events(spark, tmp_path):
    """The findings are those of the three fixed rows and of every event's JSON."""
    from contractlens.plans import queries

    def findings(name, props):
        spark.createDataFrame([(p,) for p in props], "props string").write.parquet(f"{tmp_path}/{name}/events.parquet")
        return sorted(map(tuple, queries.QUERIES["evaluate_clause"](spark, f"{tmp_path}/{name}").collect()))

    fixed = findings("none", [])
    own = ['{"guarantee_uncapped": true, "prepayment_penalty": true}', "no JSON", None]
    silent = findings("silent", ["{}"])
    got = findings("own", own)
    assert len(fixed) > 0 and {r for r in fixed if r[0] == "loan"} <= set(got)
    for r in (r for r in fixed if r[0] == "loan"):
        assert got.count(r) >= 2 * fixed.count(r)
    assert len(silent) >= len(fixed)


def test_sources(spark, tmp_path):
    import json
    import zipfile

    from contractlens.sources import readers

    (tmp_path / "a.txt").write_bytes("one\r\ntwo\rthré".encode() + b"\xff")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>para</w:t></w:r><w:r><w:t>graph</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "c.xls").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["problem"]) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("one\ntwo\nthré", None) and got["b.docx"] == ("paragraph\n", None)
    assert got["c.xls"] == (None, "files of type .xls are not supported") and got["d.docx"][0] is None
    rules = {"doc_type": "loan", "rules": [rulebook.LOAN[0]]}
    (tmp_path / "loan.json").write_text(json.dumps(rules))
    assert readers.load_rules(str(tmp_path / "loan.json"))[0] == "loan"
    assert readers.load_norms(spark, str(tmp_path / "none.json")) == {}
    clauses = spark.createDataFrame([("d", 0, "h", "t")], "doc_id string, idx int, heading string, text string")
    for v in ("v1", "v2", "v1"):
        readers.save_version(clauses, str(tmp_path / "versions"), v)
    assert readers.list_versions(spark, str(tmp_path / "versions")).count() == 2
    assert readers.load_version(spark, str(tmp_path / "versions"), "v1").count() == 1


def test_queue_and_tools(spark):
    from contractlens.operators import curate, statutes

    clauses = spark.createDataFrame([(f"{d}::{i}", d, i, "clause %s " % (i if d == "a" else f"{d}{i}") * 30) for d in "abc" for i in range(6)] + [("x", "d", 0, "short"), ("y", "e", 0, "clause 0 " * 30)], "clause_id string, doc_id string, order int, text string")
    queue = curate.build_queue(clauses, 9)
    rows = queue.collect()
    assert len(rows) == 9 and {r["doc_id"] for r in rows} == {"a", "b", "c"} and sum(r["split"] == "test" for r in rows) == 3
    assert curate.queue_spread(queue).first()[0] == 3
    statutes.tool_views(spark.createDataFrame(acts(), "corpus_id string, text string"))
    assert spark.sql("select span from statute_sections where corpus_id = 'ica_1872' and section = '74'").first()[0].startswith("74.")
    picked = statutes.propose_anchor(spark.createDataFrame([("R", 0, "not there", "the reasonable compensation"), ("R", 1, "reasonable compensation", "the reasonable compensation")], "rule_id string, ord int, phrase string, span string"))
    assert picked.first()["anchor"] == "reasonable compensation"
