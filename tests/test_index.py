"""The stored index against searches over the texts."""

from contractlens.operators import index, statutes

TEXTS = [(i, f"a{i % 3}", " ".join(f"w{(i * k + k) % 11}" for k in range(3 + i % 7))) for i in range(40)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_changed_and_removed_owners(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "terms"), "key long, owner string, text string"
    asked = spark.createDataFrame([("x", "w1 w2 w2"), ("y", "w7"), ("z", "nothing of it")], "query_id string, query string")
    index.write(spark.createDataFrame(TEXTS, schema), path)
    whole = lambda texts: statutes.bm25(spark.createDataFrame(texts, schema), asked, "key", "text", k=4)
    assert rows(index.Terms(spark, path).search(asked, 4)) == rows(whole(TEXTS))
    changed = [(i, o, t + " w7 w7 fresh") for i, o, t in TEXTS if o == "a1"] + [(100, "new", "w1 w7")]
    kept = [t for t in TEXTS if t[1] == "a2"]
    for _ in range(2):  # a generation that is written again replaces itself
        index.write(spark.createDataFrame(changed, schema), path, 1, spark.createDataFrame([("a0",)], "owner string"))
    terms = index.Terms(spark, path)
    assert rows(terms.search(asked, 4)) == rows(whole(changed + kept))
    assert terms.totals().first()["n"] == len(changed + kept)
    monkeypatch.setattr(index, "LISTED", 1)
    assert rows(index.Terms(spark, path).search(asked, 4)) == rows(whole(changed + kept))
    assert index.update(spark, spark.createDataFrame(kept, schema), path) == 2
    assert rows(index.Terms(spark, path).search(asked, 4)) == rows(whole(changed + kept))


def test_a_search_reads_postings_of_its_terms_alone(spark, tmp_path):
    path = str(tmp_path / "terms")
    index.write(spark.createDataFrame(TEXTS, "key long, owner string, text string"), path)
    terms = index.Terms(spark, path)
    own = [r[0] for r in spark.createDataFrame([("w1",)], "t string").select(index.bucket("t")).collect()]
    plan = terms.postings(["w1"], own)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1] and "In(term" in plan.replace("EqualTo(term", "In(term")
    read = terms.search(spark.createDataFrame([("q", "w1")], "query_id string, query string")).inputFiles()
    assert all("/owners/" in f or "/postings/" in f or "search-" in f for f in read)


def test_few_queries_go_to_the_passages(spark, monkeypatch):
    passages = spark.createDataFrame([*TEXTS, *((i + 100, o, t) for i, o, t in TEXTS), (7, "a1", "w1 again"), (None, "a2", "w1 w2"), (200, "a0", None)], "key long, owner string, text string").repartition(3)
    asked = [(q, o, " ".join(f"w{(q * 3 + j) % 11}" for j in range(q))) for q in range(1, 9) for o in ("a0", "a1")] + [(None, "a2", "w1"), (99, "a0", "nothing of it")]
    queries = spark.createDataFrame(asked, "query_id long, owner string, query string")

    def found(within, k):
        return statutes.bm25(passages, queries, "key", "text", k=k, within=within)

    def rows(df):
        return sorted(map(str, df.collect()))

    with monkeypatch.context() as m:
        m.setattr(statutes, "SMALL_QUERIES", 0)
        want = {(w, k): rows(found(w, k)) for w in (None, "owner") for k in (1, 3, 1000)}
    for cells in (1, 64, statutes.CELLS):
        monkeypatch.setattr(statutes, "CELLS", cells)
        for (w, k), own in want.items():
            df = found(w, k)
            assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
            assert rows(df) == own
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert rows(found(None, 3)) == want[None, 3]
        assert rows(statutes.bm25(passages, queries.where("query_id = 99"), "key", "text", k=3)) == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
