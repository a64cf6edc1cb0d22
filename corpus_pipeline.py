"""A corpus pipeline of training-data operators; each stage is written and read again.

All stages take whole texts, however long, and other columns by their place, so their names may be
those that an operator uses inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.llm import packing, quality_classifier, quality_rules, simhash, substring_dedup
from contractlens.llm.common import Scratch
from contractlens.llm.queries import _tokenizer, documents


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go.

    A null or empty text has few words and goes; null ids, repeated rows and other columns stay as
    they are; an empty table stays empty.
    """
    return quality_rules.keep_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It is fitted on all labelled documents, as the rules have taken most of the bad ones.

    A null or empty text gets the score of the feature that every document has; a null id is never
    labelled; repeated rows each stay or go alike; without labels of two classes every score is the
    share of label 1, 0.5 without any, and below the threshold all go; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    logits = quality_classifier.fit(documents(spark, sf_dir), labels)
    return quality_classifier.keep_documents(docs, logits)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, told by what it holds and not by its id alone.

    Null and empty texts are one group; a row without an id stays only if its whole group has none;
    rows equal in all columns are one; an empty table stays empty.
    """
    return simhash.one_row_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that recur go.

    Null and short texts stay as they are; a text that loses all its words stays as the empty text;
    null and repeated ids are told apart by their texts; an empty table stays empty.
    """
    return substring_dedup.strip_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents are packed into sequences of tokens.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table stays empty.
    """
    return packing.pack(docs, _tokenizer("byte_bpe_50k.json"))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("simhash near-dedup", near_duplicates), ("substring dedup", passages), ("best-fit packing", sequences)]
#: Hashed features, fingerprints and a vocabulary's ids are beyond SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = documents(spark, sf_dir)
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
