"""The triage router: weak labels, TF-IDF features and a logistic regression of pyspark.ml."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.functions.scratch import Scratch
from contractlens.functions.text import count_present
from contractlens.operators import evalstats
from contractlens.operators.curate import numbered

#: Markers (fixed values).
STRONG = [
    "non-compet", "noncompet", "restraint of trade", "restrictive covenant", "forfeit", "liquidated damages", "penalty", "bond", "minimum service",
    "clawback", "sole discretion", "sole and exclusive property", "invention", "non-solicit", "nonsolicit", "garden leave", "perpetuit", "in perpetuity",
    "injunctive relief", "waives the", "waive any", "shall vest in", "irrevocably assign", "at its sole", "without cause",
]
WEAK = ["terminat", "notice", "breach", "obligat", "covenant", "confidential", "deposit", "escalat", "arbitrat", "sublet", "discretion", "indemnif", "restrict", "assign", "shall not", "shall pay", "damages"]
INERT = ["capitalized terms", "shall have the meanings", "in witness", "counterparts", "severability", "headings", "entire agreement", "notices shall be sent", "witnesseth", "recitals", "exhibit ", "definitions", "table of contents", "signature page", "for convenience of reference"]
TERMS, MIN_DF, C, HELD_OUT, THRESHOLD, MIN_CLASS, MAX_POSITIVE = 20_000, 2, 2.0, 0.25, 0.2, 10, 0.45


def weak_label(text: Column, strong=STRONG, weak=WEAK, inert=INERT) -> Column:
    """1 if a clause looks risky by its markers, else 0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    s, w, i = (count_present(low, x) for x in (strong, weak, inert))
    return F.when((i >= 2) & (s == 0), F.lit(0)).when((s >= 1) | (w >= 5), F.lit(1)).otherwise(F.lit(0))


def held_out(rows: DataFrame, key: str, share: float = HELD_OUT) -> DataFrame:
    """rows with ``test``: of each label the same share, in the order of a seeded hash; rows of one key stay together.

    Only keys are ordered; the last one held out of each label is joined back, so texts aren't shuffled.
    """
    place = F.struct(F.xxhash64(F.col(key), F.lit(42)).alias("hash"), F.col(key).alias("key"))
    keys = rows.select(F.col("label").alias("_label"), place.alias("_last"))
    placed = numbered(keys, "_label", F.col("_last"), "nth", F.shiftright(F.col("_last.hash"), 56))
    last = placed.where(F.col("nth") <= F.floor(F.col("n") * share)).groupBy("_label").agg(F.max("_last").alias("_last"))  # a row for each label
    marked = rows.join(F.broadcast(last), F.col("label").eqNullSafe(F.col("_label")), "left")
    return marked.withColumn("test", F.coalesce(place <= F.col("_last"), F.lit(False))).drop("_label", "_last")


def tfidf(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): sublinear term counts times smooth idf, each document of length one; terms in MIN_DF documents."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\w{2,}"), F.lit(0))
    pairs = F.when(F.size("w") >= 2, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    counts = rows.select(key, words.alias("w")).select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= MIN_DF)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    idf = F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = counts.join(df, "term").crossJoin(F.broadcast(n)).withColumn("raw", (1 + F.ln("tf")) * idf)  # n is one row
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def _weigh(counts: DataFrame, idf: list[float]) -> DataFrame:
    """counts with ``features``: a Python function, as no expression makes sparse vectors, and dense ones are as long as the vocabulary."""
    weights = np.array(idf)

    @F.udf(VectorUDT())
    def features(v):
        raw = (1 + np.log(v.values)) * weights[v.indices]
        return SparseVector(v.size, v.indices, raw / max(float(np.sqrt(raw @ raw)), 1e-12))

    return counts.withColumn("features", features("counts"))


class Router:
    """A fitted router: vocabulary, idf, model and threshold."""

    def __init__(self, words: PipelineModel, idf: list[float], model: PipelineModel, threshold: float):
        self.words, self.idf, self.model, self.threshold = words, idf, model, threshold

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with ``p`` and ``keep``."""
        return self.scored(self.words.transform(rows), rows.columns)

    def scored(self, counted: DataFrame, columns: list[str]) -> DataFrame:
        """Rows whose terms are counted already with ``p`` and ``keep``."""
        p = vector_to_array("probability")[1]
        return self.model.transform(_weigh(counted, self.idf)).select(*columns, p.alias("p")).withColumn("keep", F.col("p") >= self.threshold)

    def save(self, path: str) -> None:
        self.words.write().overwrite().save(f"{path}/words")
        self.model.write().overwrite().save(f"{path}/model")
        _session().createDataFrame([(self.idf, self.threshold)], "idf array<double>, threshold double").write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, path: str) -> Router:
        row = _session().read.parquet(f"{path}/weights").first()
        return cls(PipelineModel.load(f"{path}/words"), list(row[0]), PipelineModel.load(f"{path}/model"), row[1])


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def train(rows: DataFrame, key: str = "clause_id", text: str = "text", terms: int = TERMS) -> tuple[Router, DataFrame]:
    """rows (key, text, label) to a router and its threshold table on the held-out share.

    terms is the size of the vocabulary; it stays bounded whatever the corpus.
    """
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # two labels
    if min(counts.get(0, 0), counts.get(1, 0)) < MIN_CLASS:
        raise ValueError(f"each class needs {MIN_CLASS} clauses or more: {counts}")
    share = counts[1] / sum(counts.values())
    if share > MAX_POSITIVE:
        warnings.warn(f"{share:.0%} of the clauses are positive: the labels keep too much for a router to save anything", stacklevel=2)
    scratch = Scratch(rows.sparkSession, "router")
    split = scratch.table(held_out(rows.select(key, text, "label"), key), "split")
    fit = split.where("not test")
    words = Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="w1", pattern=r"\W+", minTokenLength=2), NGram(n=2, inputCol="w1", outputCol="w2"), SQLTransformer(statement="SELECT *, concat(w1, w2) AS terms FROM __THIS__"), CountVectorizer(inputCol="terms", outputCol="counts", minDF=MIN_DF, vocabSize=min(terms, TERMS))]).fit(fit)
    counted = scratch.table(words.transform(split).select(key, "label", "test", "counts"), "counted")  # texts are cut into terms once for all passes below
    fit = counted.where("not test")
    seen = IDF(inputCol="counts", outputCol="idf").fit(fit)  # its document frequencies; its weights lack the + 1
    n = seen.numDocs
    idf = [math.log((1 + n) / (1 + d)) + 1 for d in seen.docFreq]
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, F.lit(total / (2 * counts[1]))).otherwise(F.lit(total / (2 * counts[0])))
    ready = _weigh(fit, idf).withColumn("weight", weight).withColumn("label", F.col("label").cast("double"))
    model = Pipeline(stages=[LogisticRegression(weightCol="weight", regParam=1 / (C * n), elasticNetParam=0.0, standardization=False, maxIter=50)]).fit(ready)
    router = Router(words, idf, model, THRESHOLD)
    swept = evalstats.sweep(router.scored(counted.where("test"), [key, "label"]))
    router.threshold = evalstats.best_threshold(swept, THRESHOLD)
    return router, swept


def benchmark(scored: DataFrame) -> DataFrame:
    """scored (doc_type, keep): counts and costs by type."""
    sums = scored.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("k"))
    return sums.select("doc_type", *evalstats.costs(F.col("k"), F.col("n")))
