"""The streamed audit against the audit of the whole table, over a failure, restarts and an early end."""

import pytest
from pyspark.sql import functions as F

from contractlens.plans import audit, papers
from contractlens.streaming import audits

SCHEMA = "doc_id long, doc_type string, text string, ts timestamp"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve papers in four files, one of them there twice."""
    path = tmp_path_factory.mktemp("papers")
    own = papers.papers(spark.range(12).withColumnRenamed("id", "doc_id")).withColumn("ts", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000))
    for k in range(4):
        part = own.where(F.col("doc_id").between(3 * k, 3 * k + 2))
        (part.unionByName(own.where("doc_id = 1")) if k == 2 else part).coalesce(1).write.mode("append").json(str(path))
    return str(path)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(folder)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "rule_id", "severity", "clause_id").collect()))


def test_a_broken_and_restarted_stream_gives_the_audits_rows(spark, folder, tmp_path):
    acts = papers.acts(spark)
    calls = []

    def breaks(batch, acts):
        calls.append(1)
        got = audit.audit(batch, acts)
        if len(calls) == 2:  # after its findings were computed, before all was written
            raise RuntimeError("lost")
        return got

    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    with pytest.raises(Exception, match="lost"):
        audits.finished(audits.audit_stream(audits.once(source(spark, folder)), acts, path, checkpoint, work=breaks))
    assert audits.finished(audits.audit_stream(audits.once(source(spark, folder)), acts, path, checkpoint))
    whole = spark.read.schema(SCHEMA).json(folder).dropDuplicates(["doc_id"]).select("doc_id", "doc_type", "text")
    findings, summary = audit.audit(whole, acts)
    assert rows(audits.committed(spark, path, "findings")) == rows(findings)
    columns = summary.columns
    assert sorted(map(str, audits.committed(spark, path, "summary").select(columns).collect())) == sorted(map(str, summary.collect()))
    # a batch without a mark is not read
    audits._write(findings.limit(3), f"{path}/findings", 99)
    assert rows(audits.committed(spark, path, "findings")) == rows(findings)


def test_an_early_end_reads_no_later_file(spark, folder, tmp_path):
    path, checkpoint, read = str(tmp_path / "out"), str(tmp_path / "state"), []

    def work(batch, acts):
        ids = [r[0] for r in batch.select("doc_id").collect()]
        read.extend(ids)
        found = spark.createDataFrame([(i, "R") for i in ids], "doc_id long, rule_id string")
        return found, found.withColumn("flagged", F.lit(1))

    assert not audits.finished(audits.audit_stream(source(spark, folder), None, path, checkpoint, most=3, work=work))
    assert len(read) == 3 and audits.found(spark, path) == 3
    # the rest is there for a later run
    assert audits.finished(audits.audit_stream(source(spark, folder), None, path, checkpoint, work=work))
    assert sorted(read) == sorted([*range(12), 1])
