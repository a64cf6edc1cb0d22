"""The registered queries on the small tables, with their SQL, and the pipeline against plain stages."""

import os

import pytest

from contractlens.llm import queries
from tests.harness import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert same(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_a_row_for_each_document(spark, name):
    docs = {r[0] for r in queries.documents(spark, DATA).select("doc_id").collect()}
    assert {r[0] for r in queries.QUERIES[name](spark, DATA).select("doc_id").collect()} == docs


def test_pipeline(spark, tokenizers):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from contractlens.llm import quality_classifier, quality_rules
    from tests.llm.test_operators import plain_components, plain_fingerprint, plain_kept

    docs = queries.documents(spark, DATA)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r[0] for r in quality_rules.ledger(docs).where(quality_rules.passes()).select("doc_id").collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").selectExpr("doc_id", "quality as label")
    good = {r[0] for r in quality_classifier.classify(docs, labels).where("predicted = 1").select("doc_id").collect()}
    left = sorted(kept & good)
    groups = plain_components(left, [plain_fingerprint(rows[i]) for i in left])
    left = [(i, rows[i]) for i, c in zip(left, groups, strict=True) if i == c]
    final = [(i, t if len(w) == len(k) else " ".join(k)) for (i, t), (_, w, k) in zip(left, plain_kept(left, 35), strict=True)]
    plain = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in final}
    got = {r[0]: r[1] for r in corpus_pipeline.run(spark, DATA).groupBy("doc_id").agg({"length": "sum"}).collect()}
    assert got == want
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "simhash near-dedup", "substring dedup", "best-fit packing"]


def test_pipeline_on_odd_rows(spark, docs, tokenizers):
    """Null and repeated ids, null, empty and very long texts, other columns of clashing names; then no rows at all."""
    import corpus_pipeline
    from contractlens.llm.common import Scratch

    keep = "doc_id long, text string, lang string, quality_score double, failures long, score_ string, c0_ int, h string, held long"
    rows = [(r["doc_id"], r["text"], "en", 0.1, 3, "s", 1, "h", 9) for r in docs.select("doc_id", "text").collect()]
    rows += [(i, f"clean prose {i} " + " ".join(f"w{i * 7 + k * k % 83}" for k in range(90)), "fr", None, None, None, None, None, None) for i in (70, 70, 71)]
    whole = spark.createDataFrame(rows, keep)
    for table in (whole, whole.where("doc_id = -1")):
        scratch, now = Scratch(spark, "odd"), table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            was, now = now, scratch.table(stage(spark, now, DATA), f"stage{k}")
            assert k == 4 or now.columns == was.columns
            assert k == 4 or now.count() <= was.count()
        assert table is whole or now.count() == 0
