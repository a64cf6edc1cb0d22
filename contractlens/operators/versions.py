"""Comparing drafts: which clause became which, and what became of each finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contractlens.functions.text import heading_key, text_digest, token_set
from contractlens.operators import matching

STATUSES = ("NEW", "REWORDED", "PERSISTED", "VANISHED", "RESOLVED")


def prepared(clauses: DataFrame) -> DataFrame:
    """clauses (doc_id, idx, heading, text) with their digest, heading key and tokens."""
    return clauses.select("doc_id", "idx", "heading", "text", text_digest(F.col("text")).alias("hash"), heading_key(F.col("heading")).alias("key"), token_set(F.col("text")).alias("tokens"))


def exact_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, old_idx, new_idx): the k-th clause of a digest meets the k-th of it on the other side."""
    nth = Window.partitionBy("doc_id", "hash").orderBy("idx")
    side = lambda df, name: df.select("doc_id", "hash", F.col("idx").alias(name), F.row_number().over(nth).alias("k"))
    return side(old, "old_idx").join(side(new, "new_idx"), ["doc_id", "hash", "k"]).select("doc_id", "old_idx", "new_idx")


def match_clauses(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, old_idx, new_idx, similarity): exact, by heading, by body; what is left has no partner.

    Clauses are dealt out by document, once, and matched there (see :mod:`matching`); a document's
    clauses are what bounds a task.
    """
    side = lambda df, new: prepared(df).select("doc_id", F.lit(new).alias("side"), F.col("idx").cast("int").alias("idx"), F.unhex("hash").alias("digest"), F.array_join("key", " ").alias("key"), F.array_join("tokens", " ").alias("tokens"))
    # words are joined: an array of short texts takes several times their room in a shuffle
    rows = side(old, False).unionByName(side(new, True)).repartition("doc_id").sortWithinPartitions("doc_id")
    kind = old.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(matching.match, f"doc_id {kind}, old_idx int, new_idx int, similarity double")


def status(before: Column, after: Column, has_new: Column, changed: Column) -> Column:
    """What became of a rule's finding on a pair of clauses."""
    return (
        F.when(before & after, F.when(changed, F.lit("REWORDED")).otherwise(F.lit("PERSISTED")))
        .when(before, F.when(~has_new | changed, F.lit("RESOLVED")).otherwise(F.lit("VANISHED")))
        .otherwise(F.lit("NEW"))
    )


def diff(pairs: DataFrame, old: DataFrame, new: DataFrame, old_findings: DataFrame, new_findings: DataFrame) -> DataFrame:
    """(doc_id, old_idx, new_idx, rule_id, status, severity, similarity) for every finding of either draft.

    findings: doc_id, idx, rule_id, severity, and ord if there is one; of several of a rule on a
    clause the last by ord counts, without ord the least severe, as findings lie high ones first.
    old and new have a text, or its digest as ``hash``.
    """
    hashes = lambda df, side: df.select("doc_id", F.col("idx").alias(f"{side}_idx"), (F.col("hash") if "hash" in df.columns else text_digest(F.col("text"))).alias(f"{side}_hash"))
    keyed = pairs.join(hashes(old, "old"), ["doc_id", "old_idx"], "left").join(hashes(new, "new"), ["doc_id", "new_idx"], "left")
    place = lambda df: F.struct(F.col("ord") if "ord" in df.columns else F.lit(0), F.coalesce(*(F.when(F.col("severity") == x, F.lit(i)) for i, x in enumerate(("high", "medium", "low", "none")))))
    own = lambda df, side: df.groupBy("doc_id", F.col("idx").alias(f"{side}_idx"), "rule_id").agg(F.max_by("severity", place(df)).alias(f"{side}_severity"))
    before = keyed.join(own(old_findings, "old"), ["doc_id", "old_idx"]).select("doc_id", "old_idx", "new_idx", "rule_id", "old_severity")
    after = keyed.join(own(new_findings, "new"), ["doc_id", "new_idx"]).select("doc_id", "old_idx", "new_idx", "rule_id", "new_severity")
    same = lambda a, b: a.eqNullSafe(b)
    b, a = before.alias("b"), after.alias("a")
    on = (F.col("b.doc_id") == F.col("a.doc_id")) & same(F.col("b.old_idx"), F.col("a.old_idx")) & same(F.col("b.new_idx"), F.col("a.new_idx")) & (F.col("b.rule_id") == F.col("a.rule_id"))
    both = b.join(a, on, "full_outer").select(*(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ("doc_id", "old_idx", "new_idx", "rule_id")), "old_severity", "new_severity")
    k = keyed.select(F.col("doc_id").alias("d_"), F.col("old_idx").alias("o_"), F.col("new_idx").alias("n_"), "similarity", (~same(F.col("old_hash"), F.col("new_hash"))).alias("changed"))
    joined = both.join(k, (F.col("doc_id") == F.col("d_")) & same(F.col("old_idx"), F.col("o_")) & same(F.col("new_idx"), F.col("n_")))
    what = status(F.col("old_severity").isNotNull(), F.col("new_severity").isNotNull(), F.col("new_idx").isNotNull(), F.col("changed"))
    out = joined.withColumn("status", what)
    similarity = F.when(F.col("status") == "REWORDED", F.col("similarity")).when(F.col("status") == "PERSISTED", F.lit(1.0))
    return out.select("doc_id", "old_idx", "new_idx", "rule_id", "status", F.coalesce("new_severity", "old_severity").alias("severity"), similarity.alias("similarity"))


def ordered(changes: DataFrame) -> DataFrame:
    """Changes by status, then by severity."""
    rank = lambda c, names: F.coalesce(*(F.when(c == n, F.lit(i)) for i, n in enumerate(names)))
    return changes.orderBy("doc_id", rank(F.col("status"), STATUSES), rank(F.col("severity"), ("high", "medium", "low", "none")), "rule_id")


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("doc_id").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES))

