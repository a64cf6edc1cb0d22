"""The document audit: guard, document facts, clauses, triage, facts, gates, rules, citations, verdicts."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from contractlens.functions.scratch import Scratch
from contractlens.functions.text import computed, once
from contractlens.operators import docfacts, extract, facts, gates, guard, router, rulebook, rules, segment, statutes, triage

MIN_TEXT, MAX_CLAUSES, MAX_TRIES = 100, 60, 2
Extractor = Callable[[Column, Column], dict[str, Column]]
#: Every field that some rule reads.
FIELDS = sorted({f for own in rulebook.RULES.values() for f in rules.required_params(own)})
CLAUSE_FIELDS = [f for f in FIELDS if not f.startswith("doc__")]


def document_columns(docs: DataFrame) -> DataFrame:
    """docs (doc_id, doc_type, text) with verdict, document facts and whether they can be read."""
    own = docs.select("doc_id", "doc_type", F.coalesce("text", F.lit("")).alias("text"))
    own = computed(own, "hay", guard.normalised(F.col("text")))
    own = computed(own, "scores", once(guard.scores, "hay"))
    own = computed(own, "verdict", once(guard.check, "doc_type", "scores", "hay"))
    own = computed(own, "doc_facts", once(docfacts.read_document, "text", "doc_type"))
    return own.withColumn("problem", unreadable(F.col("doc_type"), F.col("text"))).drop("hay")


def unreadable(doc_type: Column, text: Column) -> Column:
    """Why a document can't be audited, before it is cut; null if it can."""
    return F.when(~doc_type.isin(list(rulebook.RULES)) | doc_type.isNull(), F.lit("unknown type")).when(F.length(F.trim(F.coalesce(text, F.lit("")))) < MIN_TEXT, F.lit("too short"))


def first_clauses(clauses: DataFrame, n: int) -> DataFrame:
    """The first n clauses of each document."""
    return clauses.where(F.col("order") < n)


def clause_facts(clauses: DataFrame, extractor: Extractor | None = extract.keyword_params, supplied: str | None = None) -> DataFrame:
    """clauses (doc_type, text, doc_facts) with ``params``, ``evidence`` and ``dropped``.

    Params are a map of field to text, without the fields that nothing is said of.  The order is the
    reader's facts, the extracted or supplied ones without those that only the reader may set, the
    gates, the reader over them, and the document's facts below.
    """
    out = computed(clauses, "read", once(facts.read_facts, "text", "doc_type")).withColumn("evidence", once(facts.read_evidence, "text", "read"))
    if supplied:
        given = rules.values_of(F.struct(*(c.alias(f) for f, c in rules.params_columns(F.col(supplied), CLAUSE_FIELDS).items())))
    elif extractor:
        given = once(_extracted(extractor), "doc_type", "text")
    else:
        given = F.create_map().cast("map<string,string>")
    out = computed(out, "given", given)
    out = computed(out, "dropped", gates.stopped(F.col("given"), F.col("text")))
    out = computed(out, "read", rules.values_of(F.col("read")))
    passed = F.map_filter("given", lambda f, v: ~F.array_contains("dropped", f) & ~F.map_contains_key("read", f))
    return computed(out, "params", F.map_concat(rules.values_of(F.col("doc_facts")), passed, "read")).drop("read", "given")


_extractors: dict[Extractor, Callable[[Column, Column], Column]] = {}


def _extracted(extractor: Extractor) -> Callable[[Column, Column], Column]:
    """An extractor's fields as a map of field to text, those left out that no rule reads or only the reader may set."""

    def build(kind: Column, text: Column) -> Column:
        fields = [c.alias(f) for f, c in extractor(kind, text).items() if f in CLAUSE_FIELDS and f not in rulebook.READER_ONLY]
        return rules.values_of(F.struct(*fields)) if fields else F.create_map().cast("map<string,string>")

    return _extractors.setdefault(extractor, build)


def clause_findings(clauses: DataFrame, norms: dict | None = None) -> DataFrame:
    """clauses with params (a map of field to text, or a struct of fields) get ``findings``, by the rules of their own type."""
    mapped = isinstance(clauses.schema["params"].dataType, T.MapType)
    return computed(clauses, "findings", once(_judged(mapped, json.dumps(norms, sort_keys=True)), "doc_type", "params"))  # an explosion would ask for its size first, and so work it out again


@cache
def _judged(mapped: bool, norms: str) -> Callable[[Column, Column], Column]:
    """Findings of (doc_type, params); norms are in JSON."""
    return lambda kind, params: rules.by_type(kind, rulebook.RULES, rules.in_map(params) if mapped else lambda f: params[f], json.loads(norms))


def text_key(doc_type: Column, text: Column) -> Column:
    """What documents of one type and one text share; an absent text is an empty one."""
    return F.concat(F.sha2(F.coalesce(text, F.lit("")), 256), F.coalesce(F.concat(F.lit(":"), doc_type), F.lit("")))


def of_documents(copies: DataFrame, rows: DataFrame) -> DataFrame:
    """rows of texts (doc_id is the key of a text) as rows of each document that has the text; copies (key, doc_id, doc_type)."""
    told = rows.withColumnRenamed("doc_id", "key").drop("doc_type")
    if "clause_id" in rows.columns:
        told = told.withColumn("tail", F.substr("clause_id", F.length("key") + 1)).drop("clause_id")
    out = copies.join(told, "key")
    if "clause_id" in rows.columns:
        out = out.withColumn("clause_id", F.concat(F.col("doc_id").cast("string"), "tail"))
    return out.select(*rows.columns)


def audit(
    docs: DataFrame,
    acts: DataFrame | None = None,
    extractor: Extractor | None = extract.keyword_params,
    norms: dict | None = None,
    errors: DataFrame | None = None,
    again: Sequence[Extractor] = (),
    most: int | None = MAX_CLAUSES,
) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, doc_type, text) to (findings, summary by document).

    acts (corpus_id, text) are what findings are cited from; without them those that need a source
    are withheld.  errors (clause_id) are clauses that an extractor failed on: they count as unread.
    A clause with a withheld finding is read again by each extractor of ``again`` in turn, and its
    last reading counts; ``tries`` says how many there were.
    Documents of more than ``most`` clauses are refused and have no findings; with None all are read.
    """
    copies, clauses, shown, told = readings(docs, acts, extractor, norms, again, most)
    findings, summed = of_documents(copies, shown), of_documents(copies, told)
    if errors is not None:
        failed = of_documents(copies, clauses.select("doc_id", "clause_id")).join(errors, "clause_id", "left_semi")
        unread = failed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("failed"))
        summed = summed.join(unread, "doc_id", "left").withColumn("unread", F.coalesce("failed", F.lit(0).cast("long"))).drop("failed")
    return findings, summed


def readings(
    docs: DataFrame, acts: DataFrame | None = None, extractor: Extractor | None = extract.keyword_params, norms: dict | None = None, again: Sequence[Extractor] = (), most: int | None = MAX_CLAUSES
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The audit by text: (copies, clauses, findings, summary), for :func:`of_documents` to tell of each document.

    What an audit says hangs on a document's type and text alone, so documents that share both are
    read once.  copies (key, doc_id, doc_type) has a row for each document; in the others ``doc_id``
    is that key.  Keys, texts, verdicts, clauses and findings are written once, as what follows reads
    them more than once.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    copies = scratch.table(docs.select(text_key(F.col("doc_type"), F.col("text")).alias("key"), "doc_id", "doc_type"), "copies")
    texts = docs.select("doc_type", F.coalesce("text", F.lit("")).alias("text")).distinct()
    texts = texts.select(text_key(F.col("doc_type"), F.col("text")).alias("doc_id"), "doc_type", "text")
    texts = scratch.table(texts.repartition(_parts(docs.sparkSession)), "texts")  # few texts would else be one task
    documents = scratch.table(document_columns(texts).drop("text"), "documents")
    readable = texts.where(unreadable(F.col("doc_type"), F.col("text")).isNull())
    clauses = computed(segment.segment(readable), "triage", once(triage.decide, "text"))
    clauses = clauses.withColumn("keep", F.col("triage.keep") | (F.col("n_clauses") < triage.MIN_CLAUSES))
    clauses = scratch.table(clauses.join(documents.select("doc_id", "doc_facts"), "doc_id"), "clauses")
    scratch.drop("texts")

    def reading(left: DataFrame, k: int) -> DataFrame:
        read = clause_findings(clause_facts(left, [extractor, *again][k]), norms)
        found = read.select("doc_id", "doc_type", "clause_id", "order", "heading", F.col("text").alias("clause_text"), "evidence", "params", F.lit(k + 1).alias("tries"), F.explode("findings").alias("f"))
        found = found.select("*", "f.*").drop("f", "sort_rank")
        found = found.withColumn("from_text", (F.size(F.array_intersect("fields", F.map_keys("evidence"))) > 0) & F.forall(F.array_intersect("fields", F.map_keys("params")), lambda x: F.map_contains_key("evidence", x)))
        found = scratch.table(found, f"found{k}")  # citing, checking and counting all read it
        cited = statutes.cite(found, acts) if acts is not None else found.withColumns({"citation_span": F.lit(None).cast("string"), "citation_source": F.lit(None).cast("string")})
        return statutes.verify(cited)

    whole = clauses.where("keep") if most is None else clauses.where("keep").where(F.col("n_clauses") <= most)
    verified = retried(whole, reading, 1 + len(again)) if again else reading(whole, 0)
    first = Window.partitionBy("doc_id", "rule_id").orderBy("order")  # a document's clauses at most
    kept = verified.where("verified").withColumn("k", F.row_number().over(first)).where("scope <> 'document' or k = 1").drop("k")
    verdicts = documents.select("doc_id", F.col("verdict.status").alias("type_status"), F.col("verdict.suggested").alias("type_suggested"))
    shown = scratch.table(kept.join(verdicts, "doc_id").where("type_status <> 'mismatch'"), "shown")
    clauses = clauses.withColumn("failed", F.lit(False))
    return copies, clauses, shown, summary(documents, clauses, shown, most)


def _parts(spark: SparkSession) -> int:
    """Into how many parts texts are dealt out: some for each core, and as many as shuffles have."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def retried(clauses: DataFrame, run: Callable[[DataFrame, int], DataFrame], most: int = MAX_TRIES) -> DataFrame:
    """Verified findings of run(clauses, try), a clause with a withheld one being read again, most times in all.

    An extractor that gives the same answer each time gains nothing by it; one that doesn't may cite
    better.  The last reading counts.
    """
    scratch = Scratch(clauses.sparkSession, "retries")
    left, out = clauses, []
    for k in range(most):
        found = scratch.table(run(left, k), f"found{k}")
        bad = scratch.table(found.where("reason is not null").select("clause_id").distinct(), f"bad{k}")
        out.append(found if k == most - 1 else found.join(bad, "clause_id", "left_anti"))
        left = left.join(bad, "clause_id", "left_semi")
    return reduce(DataFrame.unionByName, out)


def split_findings(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, reassurances): what is risky, and what speaks for a paper."""
    return found.where("risky"), found.where("not risky")


def rule_labels(clauses: DataFrame, extractor: Extractor | None = extract.keyword_params) -> DataFrame:
    """clauses (doc_type, text) with ``label``: 1 if a rule of their type fires, the weak label where the type has no rules."""
    none = F.struct(*(F.lit(None).cast(rulebook.KINDS.get(f, "boolean")).alias(f) for f in docfacts.FACTS))
    read = clause_findings(clause_facts(clauses.withColumn("doc_facts", none), extractor))
    fired = F.when(F.size("findings") > 0, F.lit(1)).otherwise(F.lit(0))
    label = F.when(F.col("doc_type").isin(list(rulebook.RULES)), fired).otherwise(router.weak_label(F.col("text")))
    return read.select(*clauses.columns, label.alias("label"))


def failed_clauses(answers: DataFrame) -> DataFrame:
    """answers (clause_id, answer JSON): the clauses whose reading failed, as the audit's errors."""
    return answers.where(F.try_parse_json("answer").isNull()).select("clause_id").distinct()


def summary(documents: DataFrame, clauses: DataFrame, shown: DataFrame, most: int | None = MAX_CLAUSES) -> DataFrame:
    """One row for each document with its counts and what may be done with them; over most clauses it is refused, with None never."""
    risky = shown.where("risky").groupBy("doc_id").agg(
        F.countDistinct("clause_id").alias("flagged"), F.count_if(F.col("severity") == "high").alias("high"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"),
        F.array_join(F.sort_array(F.collect_set(F.replace(F.col("category"), F.lit("_"), F.lit(" ")))), ",").alias("checks"),
    )
    sizes = clauses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("clauses"), F.count_if(~F.col("keep")).alias("skipped_by_triage"), F.count_if(F.coalesce("failed", F.lit(False))).alias("unread"))
    status = F.col("verdict.status")
    over = F.lit(False) if most is None else F.col("clauses") > most
    problem = F.coalesce("problem", F.when(F.col("clauses").isNull(), F.lit("no clauses")).when(over, F.lit("too many clauses")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return documents.join(sizes, "doc_id", "left").join(risky, "doc_id", "left").select(
        "doc_id", "doc_type", problem.alias("problem"), *map(zero, ("clauses", "flagged", "high", "skipped_by_triage", "unread")),
        F.coalesce("rules", F.lit("")).alias("rules"), F.coalesce("checks", F.lit("")).alias("checks"), status.alias("type_status"), F.col("verdict.suggested").alias("type_suggested"),
        (~status.isin("mismatch", "unrecognised")).alias("draft_allowed"),
    )


def supplied(params: DataFrame) -> DataFrame:
    """params (params JSON) with the fields that rules read as a struct."""
    return computed(params, "params", rules.typed_params(F.col("params"), FIELDS))


def evaluate_clause(params: DataFrame, norms: dict | None = None) -> DataFrame:
    """params (doc_type, params JSON) to findings, without gates, readers or verification."""
    return clause_findings(supplied(params), norms)
