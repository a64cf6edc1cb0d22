"""Operators that no registered query runs: indexes, readers, samples, drafts, retries and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from contractlens.functions import text as tx
from contractlens.functions.scratch import Scratch
from contractlens.operators import docfacts, drafts, evalstats, extract, facts, furniture, greedy, guard, router, rulebook, segment, statutes, triage, versions
from contractlens.plans import audit, papers
from contractlens.sources import readers
from contractlens.streaming import stream
from tests.test_readers import value


def test_windows_hold_what_is_near(spark):
    """Two hundred characters on either side of a lead, cut at the nearest boundary, the amount wholly within."""
    near = lambda t: docfacts.in_provision(t, docfacts.PENAL, docfacts.AMOUNT)
    texts = [
        "penal charge " + "x" * 180 + " 2% ", "penal charge " + "x" * 198 + " 2% ", "2% " + "x" * 190 + " penal charge", "2% " + "x" * 200 + " penal charge",
        "Rs. 500\n\npenal charge", "penal charge\n 4. Rs. 500", "penal charge\n4.1 Rs. 500", "Rs. 500\n3) penal charge", "penalty\n\npenal charge 2%", None,
    ]
    assert value(spark, near, *texts) == [True, False, True, False, False, False, True, False, True, None]
    shown = lambda t: docfacts.shown_near(t, docfacts.PENAL, docfacts.AMOUNT)
    assert value(spark, shown, "Late:\n\na penal  charge of 2%\n\nmore") == ["a penal charge of 2%"]
    assert value(spark, lambda t: docfacts.mention(t, docfacts.KEY_FACTS), "a" * 80 + " see the KFS here", "none") == ["a" * 51 + " see the KFS here", None]
    row = spark.createDataFrame([("A penal charge of 2%.", "loan")], "t string, k string").select(docfacts.read_contexts(F.col("t"), F.col("k")).alias("c")).first()["c"]
    assert row["doc__penal_charge_quantified"] == "A penal charge of 2%." and row["doc__kfs_present"] is None and row["doc__registration_mentioned"] is None


def test_saved_index(spark, tmp_path):
    acts = papers.acts(spark)
    statutes.save_index(acts, str(tmp_path / "index"))
    index = statutes.Index(spark, str(tmp_path / "index"))
    assert index.lookup("registration_act_1908", "17").first()["span"].startswith("17.") and index.lookup("none", "1").count() == 0
    found = index.search("landlord responsible for structural repairs", 2).orderBy("rank").collect()
    assert found[0]["corpus_id"] == "mta_2021" and "structural repairs" in found[0]["chunk"]
    n, mean = index.passages.count(), index.statistics().first()["mean"]
    assert index.statistics().first()["n"] == n and mean > 0
    files = acts.select(F.col("corpus_id").alias("stem"), F.lit(datetime.datetime(2024, 1, 1)).alias("modified"))
    built = F.lit(datetime.datetime(2024, 6, 1))
    assert not index.stale(files, built) and index.stale(files, F.lit(datetime.datetime(2023, 1, 1))) and index.stale(files.limit(1), built)


def test_acts_by_their_stems_are_cited(spark):
    own = papers.papers(spark.createDataFrame([(1,), (4,)], "doc_id long"))
    acts = papers.acts(spark)
    stems = {c["id"]: c["path"].rsplit("/", 1)[-1].removesuffix(".txt") for p in rulebook.PROFILES.values() for c in p["corpus"]}
    named = acts.replace(stems, subset=["corpus_id"])
    rows = lambda a: sorted(map(tuple, audit.audit(own, a)[0].select("doc_id", "rule_id", "citation_span").collect()))
    assert rows(acts) == rows(named) and any(r[2] for r in rows(acts))


def test_too_many_clauses_are_refused(spark):
    text = papers.OPENINGS["rental"] + "\n" + "\n".join(f"{i}. The landlord may enter the premises without prior notice to the tenant, number {i} of these, and shall leave them as found." for i in range(1, 66))
    found, summary = audit.audit(spark.createDataFrame([(1, "rental", text)], "doc_id long, doc_type string, text string"))
    row = summary.first()
    assert row["problem"] == "too many clauses" and row["clauses"] > 60 and row["flagged"] == 0 and found.count() == 0


def test_withheld_findings_are_read_again(spark):
    clauses = spark.createDataFrame([("a",), ("b",), ("c",)], "clause_id string")
    bad = [{"b", "c"}, {"c"}, set()]
    run = lambda left, k: left.select("clause_id", F.lit(k).alias("try"), F.when(F.col("clause_id").isin(list(bad[k])), F.lit("no span")).alias("reason"))
    got = {(r["clause_id"], r["try"], r["reason"]) for r in audit.retried(clauses, run).collect()}
    assert got == {("a", 0, None), ("b", 1, None), ("c", 1, "no span")}


def test_rule_labels_and_failures(spark):
    rows = [("rental", "The landlord may enter the premises without prior notice."), ("rental", "The garden is green."), ("other", "liquidated damages and a penalty"), (None, "plain")]
    got = audit.rule_labels(spark.createDataFrame(rows, "doc_type string, text string")).collect()
    assert [r["label"] for r in got] == [1, 0, 1, 0]
    answers = spark.createDataFrame([("a", '{"params": {}}'), ("b", "no JSON"), ("c", None)], "clause_id string, answer string")
    assert {r[0] for r in audit.failed_clauses(answers).collect()} == {"b", "c"}
    risky, fine = audit.split_findings(spark.createDataFrame([(True,), (False,), (False,)], "risky boolean"))
    assert (risky.count(), fine.count()) == (1, 2)


def test_drafts_of_a_model(spark):
    wrong = lambda t: drafts.problems(t, F.array(F.lit("74")), F.array(F.lit("indian_contract_act_1872")), F.array(F.lit("The deposit stays.")), F.lit(False))
    rows = [("See section 74.", "x"), ("See section 12.", "See section 74 again."), ("See section 12.", "**bold**"), (None, ""), ("", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(drafts.checked_draft(F.col("a"), F.col("b"), F.lit("template"), wrong).alias("d")).collect()
    assert [r[0] for r in got] == ["See section 74.", "See section 74 again.", "template", "template", "template"]


def test_samples_are_recorded_only_if_complete(spark, tmp_path):
    found, summary = audit.audit(papers.papers(spark.range(3).withColumnRenamed("id", "doc_id")), papers.acts(spark))
    readers.record_sample(found, summary, str(tmp_path / "s"), "one")
    readers.record_sample(found, summary, str(tmp_path / "s"), "two")
    index = spark.read.json(str(tmp_path / "s" / "index")).collect()
    assert {r["name"] for r in index} == {"one", "two"} and all(r["documents"] == 3 for r in index)
    assert spark.read.json(str(tmp_path / "s" / "one" / "findings")).count() == found.count()
    with pytest.raises(ValueError):
        readers.record_sample(found, summary.withColumn("unread", F.lit(1)), str(tmp_path / "s"), "three")


def test_suggestions_resume(spark, tmp_path):
    schema = "clause_id string, category string"
    asked = []

    def suggest(left):
        asked.append(sorted(r[0] for r in left.select("clause_id").collect()))
        return left.select("clause_id", F.lit("notice").alias("category"))

    clauses = spark.createDataFrame([(c,) for c in "abc"], "clause_id string")
    assert readers.suggest_pending(clauses.limit(2), str(tmp_path / "s"), suggest, schema).count() == 2
    assert readers.suggest_pending(clauses, str(tmp_path / "s"), suggest, schema).count() == 3
    assert sum(map(len, asked)) == 3


def test_versions_share_folders(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "doc_id string, idx int, heading string, text string"
    rows = [(f"d{i}", k, None, f"text {i} {k}") for i in range(200) for k in range(2)]
    readers.save_version(spark.createDataFrame(rows, schema), path, "1")
    readers.save_version(spark.createDataFrame([("d7", 0, None, "new")], schema), path, "1")
    readers.save_version(spark.createDataFrame([("d7", 0, None, "other")], schema), path, "2")
    got = readers.load_version(spark, path, "1")
    assert got.count() == 399 and [r["text"] for r in got.where("doc_id = 'd7'").collect()] == ["new"]
    assert readers.list_versions(spark, path).count() == 201
    assert len(list((tmp_path / "v").glob("version=1/bucket=*"))) <= readers.VERSION_BUCKETS


def test_pdf_pages_lose_their_furniture(spark, tmp_path, monkeypatch):
    body = lambda w: f"The first words of the {w} sheet are long enough to be no running head, and they go on for quite a while so that no rule takes them away.\nmore of the {w} sheet in a second line, unlike any other line of this file"
    page = lambda i: f"Acme Pvt Ltd\n{body(('first', 'second')[i - 1])}\nPage {i} of 2"
    texts = spark.createDataFrame([("a.pdf", readers.PAGE_BREAK.join(map(page, (1, 2)))), ("b.pdf", "only page"), ("c.pdf", "")], "path string, text string")
    got = {r["path"]: r["text"] for r in readers.without_page_furniture(texts).collect()}
    assert "Acme" not in got["a.pdf"] and "of 2" not in got["a.pdf"] and got["a.pdf"].count("first words") == 2 and got["b.pdf"] == "only page" and got["c.pdf"] == ""
    monkeypatch.setattr(readers, "pdf_pages", lambda data: (_ for _ in ()).throw(RuntimeError("broken")))
    assert readers.file_text("x.pdf", b"")[1].startswith("this is no readable PDF file")
    monkeypatch.setattr(readers, "pdf_pages", lambda data: ["one", "two"])
    assert readers.file_text("x.pdf", b"") == ("one\x0ctwo", None)
    files = spark.createDataFrame([("a", "x" * 5000, None), ("b", "short", None), ("c", None, "broken")], "path string, text string, problem string")
    assert [r["path"] for r in readers.statute_texts(files).collect()] == ["a"]


def test_texts_settings_and_exhibits(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("thré".encode() + b"\xff\r\nend")
    (tmp_path / "b.txt").write_bytes("kept �".encode())
    got = {r["stem"]: r["text"] for r in readers.read_text(spark, str(tmp_path)).collect()}
    assert got == {"a": "thré\nend", "b": "kept �"} and readers.file_text("a.txt", (tmp_path / "a.txt").read_bytes())[0] == got["a"]
    (tmp_path / "env").write_text("# comment\nA=1\nB = 'two'\n\nC=3\n")
    assert readers.settings(str(tmp_path / "env"), {"B": "other", "C": "3"}) == ({"A": "1", "B": "other", "C": "3"}, ["B"])
    hits = spark.createDataFrame([("u1", "EX-10.1"), ("u1", "ex-10.2"), ("u2", "EX-99"), ("u3", None)], "url string, file_type string")
    assert [r["url"] for r in readers.listed_exhibits(hits).collect()] == ["u1"]


def test_small_tables(spark):
    assert {tuple(r) for r in readers.corpus_alias(spark).collect()} >= {("ica_1872", "indian_contract_act_1872"), ("mta_2021", "model_tenancy_act_2021")}
    fields = readers.required_parameters(spark).groupBy("doc_type").count().collect()
    assert {r[0]: r[1] for r in fields} == {"employment": 31, "rental": 21, "loan": 18}
    rows = spark.createDataFrame([("d", "NEW", "low", "B"), ("d", "NEW", "high", "A"), ("d", "RESOLVED", "high", "C"), ("d", "REWORDED", "none", "D")], "doc_id string, status string, severity string, rule_id string")
    assert [r["rule_id"] for r in versions.ordered(rows).collect()] == ["A", "B", "D", "C"]
    hay = spark.createDataFrame([("the tenant and the landlord's rent",)], "h string")
    assert hay.select(guard.matched(F.col("h"), guard.LEXICONS["rental"])).first()[0] == ["tenant", "landlord", "rent", "landlord's"]
    found = spark.createDataFrame([("d", "R", 1)], "doc_id string, rule_id string, n int")
    assert readers.findings_json(found).first()["json"] == '{"doc_id":"d","rule_id":"R","n":1}'
    assert [r["n"] for r in evalstats.confusions(spark.createDataFrame([("a", "b")] * 3 + [("b", "a")], "truth string, guess string"), top=1).collect()] == [3]


def test_answers_of_a_model(spark):
    find = extract.json_answer(("category", "params"))
    rows = spark.createDataFrame([('say {"category": "x", "params": {}} end',), ("none",), (None,)], "a string")
    assert [r[0] for r in rows.select(find("a")).collect()] == ['{"category": "x", "params": {}}', None, None]


def test_last_finding_of_a_rule_counts(spark):
    schema = "doc_id string, idx int, heading string, text string"
    side = spark.createDataFrame([("d", 0, None, "the same words on both sides")], schema)
    pairs = versions.match_clauses(side, side)
    found = spark.createDataFrame([("d", 0, "A", "high", 2), ("d", 0, "A", "low", 1)], "doc_id string, idx int, rule_id string, severity string, ord int").repartition(2)
    assert versions.diff(pairs, side, side, found, found).first()["severity"] == "high"
    assert versions.diff(pairs, side, side, found.drop("ord"), found.drop("ord")).first()["severity"] == "low"


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x

    assert stream.with_retries(call, wait=waits.append, jitter=lambda: 0.5)(7) == 7 and waits == [1.5, 2.5]
    calls.clear()
    with pytest.raises(OSError):
        stream.with_retries(call, attempts=2, wait=waits.append)(7)
    assert stream.backoff_seconds(10, 0.0) == 30


def streamed(spark, tmp_path, rows, schema, name, make):
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / name))
    q = make(spark.readStream.schema(schema).json(str(tmp_path / name))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_cache_and_first_findings_as_streams(spark, tmp_path):
    day = 86_400_000_000
    got = streamed(spark, tmp_path, [("t", 0), ("t", 10 * day), ("t", 31 * day), ("t", 60 * day), ("u", 5)], "text string, us long", "cache", stream.cached)
    assert sorted((r["us"], r["hit"]) for r in got) == [(0, False), (5, False), (10 * day, True), (31 * day, False), (60 * day, True)]
    now = datetime.datetime(2024, 1, 1)
    rows = [("d", "R", now), ("d", "R", now + datetime.timedelta(hours=1)), ("d", "S", now)]
    got = streamed(spark, tmp_path, rows, "doc_id string, rule_id string, ts timestamp", "first", stream.first_findings)
    assert sorted(r["rule_id"] for r in got) == ["R", "S"]


def test_places_are_those_of_one_window(spark):
    from pyspark.sql.window import Window

    from contractlens.operators import curate

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("k"), (F.col("id") * 37 % 1001).alias("x"))
    rows = rows.unionByName(rows.select(F.lit(None).cast("string").alias("g"), "k", "x").limit(10))
    plain = rows.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    got = curate.numbered(rows, "g", F.col("k"), "p", F.substring("k", 1, 2)).drop("n")
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.select(*plain.columns).collect()))
    assert curate.splits(rows, "x", 8) == sorted(set(curate.splits(rows, "x", 8))) and len(curate.splits(rows, "x", 8)) == 7


@pytest.mark.parametrize("least", [0.0, 0.5, 0.85, 1.0])
def test_containment_equals_all_pairs(spark, least):
    """A line that half of all documents have, copies, subsets and lone documents."""
    import random

    from contractlens.operators import curate

    r = random.Random(5)
    sets = {i: {f"l{r.randrange(40)}" for _ in range(r.randint(1, 9))} | ({"hot"} if i % 2 else set()) for i in range(60)}
    sets |= {100: {"hot"}, 101: {"hot"}, 102: sets[3], 103: sets[3] | {"z1", "z2"}}
    pieces = spark.createDataFrame([(d, x) for d, own in sets.items() for x in own] * 2, "doc_id long, digest string")
    lead = {d: min(e for e in sets if sets[e] == sets[d]) for d in sets}
    own = [d for d in sets if lead[d] == d]
    want = {(a, b, n, round(n / min(len(sets[a]), len(sets[b])), 6)) for a in own for b in own if a < b and (n := len(sets[a] & sets[b])) and n / min(len(sets[a]), len(sets[b])) >= least}
    got = {(x["a"], x["b"], x["shared"], round(x["overlap"], 6)) for x in curate.containment(pieces, least).collect()}
    assert got == want


def test_equal_passages_tie_exactly(spark):
    rows = [(i, "alpha beta gamma delta beta " + ("tail " * (i % 2))) for i in range(40)]
    asked = spark.createDataFrame([("q", "beta delta alpha unknown beta")], "query_id string, query string")
    got = statutes.bm25(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), asked, "doc_id", "text", k=20).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(0, 40, 2)) and len({r["score"] for r in got}) == 1
    assert tx.tokens is statutes.tokens


def test_a_large_block_is_cut_once(monkeypatch):
    calls, cut = [], segment._resplit
    monkeypatch.setattr(segment, "_resplit", lambda b: calls.append(b) or cut(b))
    blocks, name = segment.best_split("words of one line; " * 500)
    assert len(calls) == 1 and name == "numbered_caps" and len(blocks) == 4


def test_shared_parts_are_worked_out_once(spark):
    rows = spark.createDataFrame([("employment", "A minimum tenure is asked; Monday to Friday 9:00 to 18:00."), ("rental", "minimum tenure"), (None, "minimum tenure")], "kind string, text string")
    written = lambda c: rows.select(c.alias("v"))._jdf.queryExecution().analyzed().toString()
    assert written(triage.decide(F.col("text"))).count("lower(") == 1
    read = facts.read_facts(F.col("text"), F.col("kind"))
    assert written(read).count("perpetuity|shall") == 2  # the pattern has it twice
    got = rows.select(read.alias("v")).select("v.bond_present", "v.weekly_hours", "v.weekly_hours_net").collect()
    assert [tuple(r) for r in got] == [(True, 45.0, 40.0), (None, None, None), (None, None, None)]


def test_lines_that_only_digits_tell_apart(spark):
    texts = ["page 12345\nb\npage 67890\npage 1\nb", "@12345\n@99999\n@1\nrow 11\nrow 22", "same old line\nother\nsame old line", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(furniture.strip_repeating_lines(F.col("text")).alias("t"))
    assert [r[0] for r in rows.collect()] == ["b\nb", "row 11\nrow 22", "other", "", None]
    assert rows.select(furniture.strip_repeating_lines(F.lit("a\nb"), 3)).first()[0] == "a\nb"


def test_terms_are_looked_up_without_cutting_words(spark):
    terms = ["rent", "notice period", "lock-in", "landlord's", "set off", "off"]
    rows = spark.createDataFrame([("rent a notice period",), ("the notice  periods rent-free lock-in",), ("landlord's set off",), ("block-in offer",), ("",)], "t string")
    df = rows.select(guard.present(F.col("t"), terms).alias("v"))
    assert [r[0] for r in df.collect()] == [["rent", "notice period"], ["rent", "lock-in"], ["off", "set off", "landlord's"], [], []]
    assert "zip_with" not in df._jdf.queryExecution().analyzed().toString() and "zipwith" not in df._jdf.queryExecution().analyzed().toString()


def test_what_every_pass_reads_is_written_once(spark, monkeypatch):
    names, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: names.append(name) or table(self, df, name))
    kept = greedy.decide(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), spark.range(1, 5).select(F.col("id").alias("doc_id")))[0]
    assert sorted(map(tuple, kept.collect())) == [(1, True, None), (2, False, 1), (3, True, None), (4, True, None)]
    rows = [(i, ("bad words here " if i % 3 == 0 else "good words there ") * 3, int(i % 3 == 0)) for i in range(60)]
    fitted, swept = router.train(spark.createDataFrame(rows, "clause_id long, text string, label int"), terms=20)
    assert names.count("edges") == 1 and names.count("counted") == 1
    assert sorted(map(str, swept.collect())) and "text" in fitted.transform(spark.createDataFrame([(1, "bad words")], "clause_id long, text string")).columns


def test_drafts_are_compared_by_digests_alone(spark):
    old = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c d")], "doc_id long, idx int, text string")
    new = spark.createDataFrame([(1, 0, "a  B"), (1, 1, "c e")], "doc_id long, idx int, text string")
    pairs = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, 0.5)], "doc_id long, old_idx int, new_idx int, similarity double")
    found = spark.createDataFrame([(1, 0, "R", "low"), (1, 1, "R", "low")], "doc_id long, idx int, rule_id string, severity string")
    digests = lambda df: df.select("doc_id", "idx", tx.text_digest(F.col("text")).alias("hash"))
    want = sorted(map(str, versions.diff(pairs, old, new, found, found).collect()))
    assert sorted(map(str, versions.diff(pairs, digests(old), digests(new), found, found).collect())) == want
    assert sum("REWORDED" in w for w in want) == sum("PERSISTED" in w for w in want) == 1
