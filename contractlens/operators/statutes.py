"""Statute retrieval and citation checks: sections by window functions, passages by BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from contractlens.functions.scratch import Scratch
from contractlens.functions.text import bound, sentences, squeeze, tokens
from contractlens.operators import index
from contractlens.operators.rulebook import PROFILES

WINDOW_SENTENCES, STRIDE, MIN_CHUNK = 4, 2, 80
K1, B = 1.5, 0.75
MIN_SECTION, MIN_SPAN, OPENING = 40, 120, 120
WIDTHS = (900, 1800, 3200)
#: Asked terms, over all queries, up to which they are broadcast.
SMALL_QUERIES = 200_000
#: Scores, and weights to add up, that a task holds at once.
CELLS = 1 << 20
#: A line that opens a section (fixed value).
MARKER = r"^\s*(?:\d+\[\s*)?(?:section\s+)?(\d+[A-Z]{0,2})\s*[.:\-–—]"


def chunks(acts: DataFrame, flags: str = "(?U)") -> DataFrame:
    """acts (corpus_id, text) to overlapping windows of sentences: (corpus_id, start, chunk).

    Windows under MIN_CHUNK characters are left out; the last one is the first that reaches the end.
    """
    cut = acts.select("corpus_id", sentences(F.col("text"), flags).alias("s")).withColumn("n", F.size("s"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(STRIDE))
    rows = cut.select("corpus_id", "n", F.explode(starts).alias("start"), "s").select("corpus_id", "start", (F.col("start") + WINDOW_SENTENCES >= F.col("n")).alias("last"), F.array_join(F.slice("s", F.col("start") + 1, F.lit(WINDOW_SENTENCES)), " ").alias("chunk"))
    kept = rows.where(F.length("chunk") >= MIN_CHUNK)
    first_last = Window.partitionBy("corpus_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("over", F.coalesce(F.max(F.col("last").cast("int")).over(first_last), F.lit(0))).where("over = 0").select("corpus_id", "start", "chunk")


def postings(passages: DataFrame, key: str = "chunk_id", text: str = "chunk", terms: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep columns, size, term, tf): term frequencies and the size of each passage in tokens; of some terms only, if given.

    Each passage has a row without a term too, for its size alone, so one pass gives all statistics.
    """
    own = passages.select(key, *keep, tokens(F.col(text)).alias("t")).select("*", F.size("t").alias("size"))
    found = own.select(key, *keep, "size", F.explode(F.concat(F.array(F.lit(None).cast("string")), "t")).alias("term"))
    if terms is not None:
        found = found.join(terms.withColumn("asked_", F.lit(True)), "term", "left").where("term is null or asked_").drop("asked_")
    return found.groupBy(key, *keep, "size", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(passages: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "chunk", pool: Column | None = None, k: int | None = None, within: str | None = None) -> DataFrame:
    """queries (query_id, query) against passages: (query_id, key, score, rank), raw scores over zero ranked, ties to the smaller key.

    Statistics are of all passages even where a pool, or a column that query and passage must share,
    restricts what is returned.  Texts are read once; up to SMALL_QUERIES asked terms are broadcast,
    so that a term of every passage makes no large group.  A repeated query term counts as often.
    The weights of a pair are summed in the order of its terms: equal passages tie exactly.
    """
    scratch = Scratch(passages.sparkSession, "bm25")
    both = [within] if within else []
    asked, few = _asked(queries, both, scratch)
    post = scratch.table(postings(passages, key, text, few(asked.select("term").distinct()), tuple(both)), "postings")
    totals = post.where("term is null").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    hits = post.where("term is not null")
    return ranked(hits, asked, totals, key, scratch, few, both, hits if pool is None else hits.join(passages.where(pool).select(key), key, "left_semi"), k)


def _asked(queries: DataFrame, both: list[str], scratch: Scratch):
    """(query_id, term, times) of queries, and how its rows are joined: broadcast while they are few."""
    asked = scratch.table(queries.select("query_id", *both, F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", *both, "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    return asked, F.broadcast if asked.count() <= SMALL_QUERIES else (lambda df: df)


def ranked(post: DataFrame, asked: DataFrame, totals: DataFrame, key: str, scratch: Scratch, few, both: list[str], hits: DataFrame, k: int | None) -> DataFrame:
    """(query_id, key, score, rank) of hits, by the document frequencies of post (key, size, term, tf) and one row of totals (n, mean).

    Few queries go to the passages: a task scores whole passages and keeps the best k of each query, so
    pairs of query and passage are never shuffled.
    """
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    known = scratch.table(asked.join(df, "term").crossJoin(F.broadcast(totals)), "known")  # totals are one row
    if k and few is F.broadcast:
        scored = _best(hits.crossJoin(F.broadcast(totals)).select("term", *both, key, weight.alias("weight")), known.select("term", *both, "query_id", (F.col("times") * idf).alias("worth")), both, key, k)
    else:
        met = hits.join(few(known), ["term", *both])
        parts = F.sort_array(F.collect_list(F.struct("term", (F.col("times") * idf * weight).alias("w"))))  # terms of one query
        raw = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["w"])
        scored = met.groupBy("query_id", key).agg(raw.alias("raw")).where("raw > 0")
    placed = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), key)))
    return (placed if k is None else placed.where(F.col("rank") <= k)).select("query_id", key, F.round("raw", 3).alias("score"), "rank")


def _best(hits: DataFrame, known: DataFrame, both: list[str], key: str, k: int) -> DataFrame:
    """hits (term, both, key, weight) against known (term, both, query_id, worth; SMALL_QUERIES rows at most): (query_id, key, raw) with the best k of each query among them."""
    rows = known.toArrow()
    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in [*both, "term"]]))
    ids = rows["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    query, worth = ids.indices.to_numpy(), rows["worth"].to_numpy()
    first = np.ones(len(query), bool)
    if len(query) > 1:
        first[1:] = np.any([pc.not_equal(rows[c].combine_chunks()[1:], rows[c].combine_chunks()[:-1]).to_numpy(zero_copy_only=False) for c in [*both, "term"]], axis=0)
    start = np.append(np.flatnonzero(first), len(query))
    terms = hits.sparkSession.createDataFrame(rows.filter(pa.array(first)).select(["term", *both]).append_column("t", pa.array(np.arange(len(start) - 1, dtype=np.int32))), known.select("term", *both, F.lit(0).alias("t")).schema)
    own = hits.join(F.broadcast(terms), ["term", *both]).select(key, "t", "weight")
    dictionary = ids.dictionary

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ends, t, weight in _whole(batches):
            for q, at, raw in _scores(ends, t, weight, start, query, worth, len(dictionary), k):
                yield pa.RecordBatch.from_arrays([dictionary.take(pa.array(q)), keys.take(pa.array(at)), pa.array(raw)], ["query_id", key, "raw"])

    kind = T.StructType([known.schema["query_id"], hits.schema[key], T.StructField("raw", T.DoubleType())])
    return own.repartition(key).sortWithinPartitions(key, "t", "weight").mapInArrow(scored, kind)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in the order of their key as (keys, where each one's rows end, t, weight), a key's rows never cut in two."""
    held: list[pa.RecordBatch] = []

    def given(rows: pa.Table):
        runs = pc.run_end_encode(rows.column(0).combine_chunks())
        return runs.values, runs.run_ends.to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy()

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch.column(0)).run_ends.to_numpy()
        cut = int(ends[-2]) if len(ends) > 1 else 0
        if held and held[-1].column(0)[-1] != batch.column(0)[0]:  # the key held ended with its batch
            yield given(pa.Table.from_batches(held))
            held = []
        if cut:
            yield given(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield given(pa.Table.from_batches(held))


def _scores(ends: np.ndarray, t: np.ndarray, weight: np.ndarray, start: np.ndarray, query: np.ndarray, worth: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, passage, score) of the best k over zero of each of n queries, some passages at a time; passages are in the order of ties.

    The queries of term t, and what it is worth in them, are at start[t] to start[t + 1].
    """
    asked = np.diff(start)[t]
    upto = np.cumsum(asked)[ends - 1]  # weights to add up, until the end of each passage
    a = 0
    while a < len(ends):
        before, low = (upto[a - 1], ends[a - 1]) if a else (0, 0)
        b = min(len(ends), a + max(1, CELLS // n), max(a + 1, int(np.searchsorted(upto, before + CELLS, "right"))))
        rows, times = slice(low, ends[b - 1]), asked[low : ends[b - 1]]
        at = np.arange(times.sum()) + np.repeat(start[t[rows]] - np.cumsum(times) + times, times)
        passage = np.repeat(np.arange(b - a), np.diff(ends[a:b], prepend=low))
        cell = query[at] * np.int64(b - a) + np.repeat(passage, times)
        raw = np.bincount(cell, worth[at] * np.repeat(weight[rows], times), n * (b - a)).reshape(n, b - a)
        chosen = raw > 0
        if k < b - a:
            least = np.partition(raw, b - a - k, axis=1)[:, b - a - k, None]
            over, level = raw > least, (raw == least) & chosen
            chosen = over | level & (np.cumsum(level, axis=1) <= k - over.sum(axis=1, keepdims=True))
        q, p = np.nonzero(chosen)
        yield q, p + a, raw[q, p]
        a = b


def sections(acts: DataFrame) -> DataFrame:
    """acts (corpus_id, text) to (corpus_id, section, span, pos): from a marker to the next, the longest of a section."""
    lines = acts.select("corpus_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    marked = lines.withColumn("section", F.regexp_extract("line", "(?i)" + MARKER, 1))
    order = Window.partitionBy("corpus_id").orderBy("at")
    numbered = marked.withColumn("part", F.sum((F.col("section") != "").cast("int")).over(order)).where("part > 0")
    spans = numbered.groupBy("corpus_id", "part").agg(F.max("section").alias("section"), F.min("at").alias("pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    spans = spans.withColumn("span", squeeze(F.col("raw"))).where(F.length("span") >= MIN_SECTION)
    longest = Window.partitionBy("corpus_id", "section").orderBy(F.desc(F.length("span")), "pos")
    return spans.withColumn("k", F.row_number().over(longest)).where("k = 1").select("corpus_id", F.upper("section").alias("section"), "span", "pos")


def plain_words(x: Column) -> Column:
    """Lower case without amendment marks and soft hyphens, other signs as spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"\d+\[|­", "")), "[^a-z0-9]+", " "))


def anchor_present(anchors: Column, span: Column) -> Column:
    """Whether all words over two letters of some anchor stand in the span; yes without anchors."""
    words = lambda a: F.filter(F.split(plain_words(a), " "), lambda w: F.length(w) > 2)
    shown = lambda hay: F.exists(anchors, lambda a: bound(words(a), lambda own: (F.size(own) > 0) & F.forall(own, lambda w: F.contains(hay, w))))
    return F.coalesce(F.size(anchors) == 0, F.lit(True)) | bound(plain_words(span), shown)


def widened(span: Column, anchors: Column) -> Column:
    """The narrowest of the widths that shows an anchor or doesn't grow any more."""
    cuts = [F.left(span, F.lit(w)) for w in WIDTHS]
    out = cuts[-1]
    for i in range(len(cuts) - 2, -1, -1):
        stop = anchor_present(anchors, cuts[i]) | (F.length(span) <= WIDTHS[i])
        out = F.when(stop, cuts[i]).otherwise(out)
    return out


def canonical(corpus_id: Column) -> Column:
    """The short id of an act that is named by its file's stem; others stay as they are."""
    stems = {c["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]: c["id"] for p in PROFILES.values() for c in p["corpus"]}
    return F.coalesce(*(F.when(corpus_id == stem, F.lit(own)) for stem, own in sorted(stems.items())), corpus_id)


def cite(findings: DataFrame, acts: DataFrame) -> DataFrame:
    """findings with source and anchors get citation_source and citation_span.

    acts (corpus_id, text), named by their short ids or by the stems of their files.  A section is
    looked up; where there is none the best passage by BM25 of that act answers the query, the
    provision or the act's name.
    """
    acts = acts.withColumn("corpus_id", canonical(F.col("corpus_id")))
    found = sections(acts)
    act = canonical(F.col("source.corpus_id"))
    hit = findings.withColumn("act_", act).join(found.select(F.col("corpus_id").alias("c_"), F.col("section").alias("s_"), F.col("span").alias("span_")), (F.col("act_") == F.col("c_")) & (F.upper("source.section") == F.col("s_")), "left")
    ask = F.coalesce("source.query", "source.provision", F.replace(F.col("source.act"), F.lit("_"), F.lit(" ")))
    passages = chunks(acts).withColumn("chunk_id", F.concat_ws("#", "corpus_id", F.lpad(F.col("start").cast("string"), 6, "0")))
    queries = findings.where("basis <> 'norm'").select(act.alias("corpus_id"), ask.alias("query")).distinct().withColumn("query_id", F.concat_ws("|", "corpus_id", "query"))
    best = bm25(passages, queries, k=1, within="corpus_id").select(F.col("query_id").alias("q_"), "chunk_id")
    best = best.join(passages.select("chunk_id", F.col("chunk").alias("chunk_")), "chunk_id").drop("chunk_id")
    both = hit.withColumn("ask_", F.concat_ws("|", "act_", ask)).join(best, F.col("ask_") == F.col("q_"), "left")
    grounded = F.col("basis") != "norm"
    span = F.when(F.col("span_").isNotNull(), widened(F.col("span_"), F.col("anchors"))).otherwise(F.col("chunk_"))
    return both.withColumn("citation_span", F.when(grounded, span)).withColumn("citation_source", F.when(grounded & span.isNotNull(), F.concat_ws(" s.", "source.corpus_id", "source.section"))).drop("act_", "c_", "s_", "span_", "ask_", "q_", "chunk_")


def reject_reason(basis: Column, section: Column, span: Column, anchors: Column) -> Column:
    """Why a finding is withheld; null if it stands."""
    tight = squeeze(F.coalesce(span, F.lit("")))
    opens = F.exists(F.split(F.regexp_replace(F.upper(F.left(tight, F.lit(OPENING))), "[^A-Z0-9]+", " "), " "), lambda w: w == F.upper(section))
    return (
        F.when(basis == "norm", F.lit(None).cast("string"))
        .when(span.isNull() | (tight == ""), F.lit("no span"))
        .when(section.isNotNull() & ~opens, F.lit("wrong section"))
        .when(F.length(tight) < MIN_SPAN, F.lit("heading only"))
        .when(~anchor_present(anchors, span), F.lit("no anchor"))
    )


def verify(findings: DataFrame) -> DataFrame:
    """findings with ``reason`` (null if it stands) and ``verified``."""
    out = findings.withColumn("reason", reject_reason(F.col("basis"), F.col("source.section"), F.col("citation_span"), F.col("anchors")))
    return out.withColumn("verified", F.col("reason").isNull())


def stale(files: DataFrame, indexed: DataFrame, built_at: Column) -> bool:
    """Whether an index (stem) of files (stem, modified) is out of date."""
    newer = files.where(F.col("modified") > built_at).limit(1)
    differ = files.select("stem").exceptAll(indexed.select("stem")).unionByName(indexed.select("stem").exceptAll(files.select("stem"))).limit(1)
    return bool(newer.count() or differ.count())


def corpus_check(cited: DataFrame) -> DataFrame:
    """(doc_type, rule_id, cause) of the grounded rules that don't resolve; cited as of :func:`verify`."""
    cause = F.when(F.col("source.corpus_id").isNull(), F.lit("no corpus id")).otherwise(F.col("reason"))
    return cited.where("basis <> 'norm'").select("doc_type", "rule_id", cause.alias("cause")).where("cause is not null")


def propose_anchor(candidates: DataFrame) -> DataFrame:
    """candidates (rule_id, ord, phrase, span): the first phrase of each rule that its span shows."""
    shown = candidates.where(anchor_present(F.array("phrase"), F.col("span")))
    return shown.groupBy("rule_id").agg(F.min_by("phrase", "ord").alias("anchor"))


def save_index(acts: DataFrame, path: str) -> None:
    """The index of acts (corpus_id, text): sections, passages and their postings, as tables below a folder."""
    sections(acts).write.mode("overwrite").parquet(f"{path}/sections")
    passages = chunks(acts).withColumn("chunk_id", F.concat_ws("#", "corpus_id", F.lpad(F.col("start").cast("string"), 6, "0")))
    passages.write.mode("overwrite").parquet(f"{path}/passages")
    index.write(acts.sparkSession.read.parquet(f"{path}/passages").select("chunk_id", "corpus_id", F.col("chunk").alias("text")), f"{path}/terms")


class Index:
    """A saved index; searches read the stored postings of the asked terms."""

    def __init__(self, spark: SparkSession, path: str):
        self.sections, self.passages = (spark.read.parquet(f"{path}/{name}") for name in ("sections", "passages"))
        self.terms = index.Terms(spark, f"{path}/terms")

    def statistics(self) -> DataFrame:
        """(term, df, n, mean): document frequencies beside the number of passages and their mean size."""
        return self.terms.postings().groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(self.terms.totals()))  # totals are one row

    def lookup(self, corpus_id: str, section: str) -> DataFrame:
        """(corpus_id, section, span) of a section."""
        return self.sections.where((F.col("corpus_id") == canonical(F.lit(corpus_id))) & (F.col("section") == section.upper())).select("corpus_id", "section", "span")

    def search(self, query: str, k: int = 5) -> DataFrame:
        """(rank, chunk_id, corpus_id, chunk, score) of the best passages."""
        asked = self.passages.sparkSession.createDataFrame([("q", query)], "query_id string, query string")
        found = self.terms.search(asked, k).select("rank", F.col("key").alias("chunk_id"), "score")
        return found.join(self.passages.select("chunk_id", "corpus_id", "chunk"), "chunk_id").select("rank", "chunk_id", "corpus_id", "chunk", "score")

    def stale(self, files: DataFrame, built_at: Column) -> bool:
        """Whether files (stem, modified) are newer than the index or others than its acts."""
        return stale(files.withColumn("stem", canonical(F.col("stem"))), self.passages.select(F.col("corpus_id").alias("stem")).distinct(), built_at)


def poisoned(findings: DataFrame) -> DataFrame:
    """Grounded findings with citations made wrong in each of three ways, for the verifier to reject.

    ``poison`` names the way: the text of another section (where one is cited), a heading alone,
    words without an anchor (where there is one).
    """
    grounded = findings.where("basis <> 'norm' and citation_span is not null")
    other = F.concat(F.lit("999. "), F.regexp_replace("citation_span", r"^\s*\S+\s*", ""))
    head = F.left("citation_span", F.lit(40))
    bare = F.concat(F.coalesce("source.section", F.lit("1")), F.lit(". "), F.repeat(F.lit("nothing of the kind is said here; "), F.lit(8)))
    way = lambda name, span: F.struct(F.lit(name).alias("poison"), span.alias("span"))
    ways = F.array_compact(F.array(F.when(F.col("source.section").isNotNull(), way("other section", other)), way("heading alone", head), F.when(F.size("anchors") > 0, way("no anchor", bare))))
    return grounded.withColumn("way", F.explode(ways)).withColumn("citation_span", F.col("way.span")).withColumn("poison", F.col("way.poison")).drop("way")


def tool_views(acts: DataFrame) -> None:
    """Views that answer a lookup by corpus and section, and a table of passages to search."""
    sections(acts).createOrReplaceTempView("statute_sections")
    chunks(acts).createOrReplaceTempView("statute_passages")
