"""Evaluation and labels: accuracy, intervals, confusions, thresholds, label checks, report counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contractlens.functions.stats import wilson

WEIGHTS = {"high": 3, "medium": 2, "low": 1}
THRESHOLDS = [x / 100 for x in range(20, 85, 5)]
MIN_RECALL = 0.99
PRICE = 0.004


def accuracy(rows: DataFrame, by: list[str] | None = None, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """n, hits, accuracy, its interval, and the share of the most common truth."""
    by = by or []
    counts = rows.groupBy(*by, truth).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(guess)).alias("hits"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("n").alias("most"))
    n, hits = F.col("n"), F.col("hits")
    return sums.select(*by, "n", "hits", F.round(hits / n, 4).alias("accuracy"), F.round(wilson(hits, n), 4).alias("low"), F.round(wilson(hits, n, True), 4).alias("high"), F.round(F.col("most") / n, 4).alias("majority"))


def confusions(rows: DataFrame, truth: str = "truth", guess: str = "guess", top: int | None = None) -> DataFrame:
    """(truth, guess, n) of wrong pairs, the most common first."""
    out = rows.where(F.col(truth) != F.col(guess)).groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), truth, guess)
    return out if top is None else out.limit(top)


def sweep(scored: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """scored (label, p): precision, recall, F1 and kept share at each threshold, in one pass."""
    one = F.col("label") == 1
    sums = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(one).alias("pos"), *(f for i, t in enumerate(thresholds) for f in (F.count_if(F.col("p") >= t).alias(f"k{i}"), F.count_if((F.col("p") >= t) & one).alias(f"h{i}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("kept"), F.col(f"h{i}").alias("hits")) for i, t in enumerate(thresholds))))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.select("n", "pos", rows.alias("r")).select("n", "pos", "r.*").withColumn("precision", ratio(F.col("hits"), F.col("kept"))).withColumn("recall", ratio(F.col("hits"), F.col("pos")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select("threshold", "kept", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"), F.round(ratio(F.col("kept"), F.col("n")), 4).alias("keep_rate"))


def best_threshold(swept: DataFrame, default: float = 0.2, least: float = MIN_RECALL) -> float:
    """The highest threshold with enough recall."""
    row = swept.where(F.col("recall") >= least).agg(F.max("threshold")).first()
    return default if row[0] is None else row[0]


def costs(kept: Column, n: Column) -> list[Column]:
    return [n.alias("clauses"), kept.alias("kept"), (n - kept).alias("skipped"), F.round(n * PRICE, 4).alias("cost_without"), F.round(kept * PRICE, 4).alias("cost_with"), F.round(F.coalesce(F.try_divide(n - kept, n), F.lit(0.0)), 4).alias("reduction")]


def pooled(by_type: DataFrame) -> DataFrame:
    """Accuracy over types from their rounded accuracies."""
    return by_type.agg(F.sum(F.bround(F.col("accuracy") * F.col("n"))).alias("hits"), F.sum("n").alias("n")).select("n", "hits", F.round(F.col("hits") / F.col("n"), 4).alias("accuracy"))


def severity_score(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == s, F.lit(w)) for s, w in WEIGHTS.items()), F.lit(0))


def document_scores(findings: DataFrame, by: str = "doc_id") -> DataFrame:
    """findings, high ones, weighted score and rules of each document."""
    return findings.groupBy(by).agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "high").alias("high"), F.sum(severity_score(F.col("severity"))).alias("score"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))


def groundedness(cited: DataFrame) -> DataFrame:
    """cited (doc_type, basis, reason): how many grounded rules resolve, by type."""
    own = cited.where("basis <> 'norm'").groupBy("doc_type").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("reason").isNull()).alias("grounded"))
    return own.withColumn("rate", F.round(F.col("grounded") / F.col("checked"), 4))


def issues(findings: DataFrame) -> DataFrame:
    """(doc_id, rule_id, severity, evidence, places): one row for each rule, its evidence without repeats.

    findings: doc_id, rule_id, severity, ord, heading, evidence (text).
    """
    rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(("high", "medium", "low"))), F.lit(3))
    key = F.lower(F.trim(F.regexp_replace("evidence", r"\s+", " ")))
    nth = Window.partitionBy("doc_id", "rule_id", "key").orderBy("ord")
    own = findings.withColumn("rank", rank).withColumn("key", key).withColumn("k", F.row_number().over(nth))
    shown = F.sort_array(F.collect_list(F.when(F.col("k") == 1, F.struct("ord", "evidence"))))
    places = F.sort_array(F.collect_list(F.struct("ord", "heading")))
    grouped = own.groupBy("doc_id", "rule_id").agg(F.min_by("severity", "rank").alias("severity"), shown.alias("shown"), places.alias("places"))
    return grouped.select("doc_id", "rule_id", "severity", F.array_join(F.transform("shown", lambda x: x["evidence"]), " / ").alias("evidence"), F.array_join(F.transform("places", lambda x: x["heading"]), " / ").alias("places"))


SEVERITIES = ("none", "low", "medium", "high")


def label_problems(taxonomy: Column) -> Column:
    """What is wrong with a label row (category, risky, severity, rationale, labeler), as an array."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(F.array_contains(taxonomy, c("category")), F.lit(False)), F.lit("category")),
            F.when(~F.coalesce(c("severity").isin(*SEVERITIES), F.lit(False)), F.lit("severity")),
            F.when(F.coalesce(c("risky"), F.lit(False)) & (c("severity") == "none"), F.lit("risky without severity")),
            F.when(~F.coalesce(c("risky"), F.lit(False)) & c("severity").isin("low", "medium", "high"), F.lit("severity without risk")),
            F.when(F.coalesce(c("risky"), F.lit(False)) & (F.trim(F.coalesce("rationale", F.lit(""))) == ""), F.lit("no rationale")),
        )
    )


def distribution(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Counts of each known value, zeros included."""
    names = rows.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    return names.join(rows.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def coerce_suggestion(category: Column, severity: Column, rationale: Column, taxonomy: list[str]) -> Column:
    """A model's suggestion with its fields put back where they belong."""
    swapped = severity.isin(taxonomy) & category.isin(*SEVERITIES)
    cat = F.when(swapped, severity).when(category.isin(taxonomy), category).otherwise(F.lit("boilerplate"))
    sev = F.when(swapped, category).when(severity.isin(*SEVERITIES), severity).otherwise(F.lit("none"))
    return F.struct(cat.alias("category"), sev.alias("severity"), F.trim(F.coalesce(rationale, F.lit(""))).alias("rationale"))


def diagnosis(extracted: Column, fired: Column, withheld: Column, failures: Column, clauses: Column) -> Column:
    """Where a document's findings got lost, if there are none."""
    return F.when(failures >= clauses, F.lit("extractor dead")).when(failures > 0, F.lit("extractor flaky")).when(extracted == 0, F.lit("nothing extracted")).when((fired == 0) & (withheld == 0), F.lit("nothing fired")).when(fired == 0, F.lit("all withheld")).otherwise(F.lit("ok"))


def token_estimate(prompt: Column, max_tokens: int, typical: int = 300) -> Column:
    """About four characters a token, and a usual reply."""
    return F.floor(F.length(prompt) / 4).cast("int") + min(max_tokens, typical)


def triage_coverage(decided: DataFrame, by: str = "doc_type") -> DataFrame:
    """decided (by, keep): kept, skipped and the share that is skipped."""
    sums = decided.groupBy(by).agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("skipped"))
    return sums.withColumn("skip_rate", F.round(F.col("skipped") / (F.col("kept") + F.col("skipped")), 4))


def blind(labels: DataFrame) -> DataFrame:
    """Labels that were given without seeing a suggestion."""
    return labels.where(~F.coalesce("assisted", F.lit(False)))


def labelled(clauses: DataFrame, labels: DataFrame, key: str = "clause_id") -> DataFrame:
    """Labels whose clause is there, with it."""
    return labels.join(clauses.select(key, "text"), key)


def with_suggestions(clauses: DataFrame, suggestions: DataFrame, key: str = "clause_id") -> DataFrame:
    """All clauses, with a suggestion where there is one; of several the surest."""
    names = [c for c in suggestions.columns if c != key]
    best = suggestions.groupBy(key).agg(F.max_by(F.struct(*names), "confidence").alias("s"))
    return clauses.join(best, key, "left").select(*clauses.columns, *(F.col(f"s.{c}").alias(f"suggested_{c}") for c in names))


def alerts(findings: DataFrame) -> DataFrame:
    """Findings that are worth a sign to the reader: grounded, verified and high."""
    return findings.where("basis <> 'norm' and verified and severity = 'high'")


def unmuted(pages: DataFrame, muted: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose host is not on the list (host)."""
    hosts = muted.select(F.lower("host").alias("host_")).distinct()
    return pages.withColumn("host_", F.lower(F.parse_url(F.col(url), F.lit("HOST")))).join(hosts, "host_", "left_anti").drop("host_")


def counters(read: DataFrame) -> DataFrame:
    """read (doc_id, extracted, fired, withheld, failed by clause): sums and :func:`diagnosis` of each document."""
    sums = read.groupBy("doc_id").agg(F.count(F.lit(1)).alias("clauses"), *(F.sum(c).alias(c) for c in ("extracted", "fired", "withheld")), F.count_if("failed").alias("failures"))
    return sums.withColumn("diagnosis", diagnosis(F.col("extracted"), F.col("fired"), F.col("withheld"), F.col("failures"), F.col("clauses")))
