"""Corpus curation: near-duplicate documents, duplicate clauses, sampling, splits and norms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contractlens.functions.scratch import Scratch
from contractlens.functions.stats import index_percentile
from contractlens.functions.text import text_digest
from contractlens.operators import greedy

NEAR, IDENTICAL, MIN_USABLE, MAX_USABLE, TEST_SHARE, MIN_SAMPLES = 0.85, 0.999, 150, 4500, 0.35, 8


def containment(pieces: DataFrame, least: float = 0.0) -> DataFrame:
    """pieces (doc_id, digest) to (a, b, shared, overlap) for a < b: shared digests over the smaller set.

    Two sets can only reach the share if they have one of the rarest digests of the smaller set in
    common: of n digests, all but the last ceil(share * n) - 1 when the rarest come first.  So a
    line that every document has brings no two of them together.  Documents of one digest set are
    one node, so copies give no pairs among themselves (they are in :func:`same_sets`).
    """
    scratch = Scratch(pieces.sparkSession, "containment")
    pieces = scratch.table(pieces.distinct(), "pieces")
    own = scratch.table(pieces.join(same_sets(pieces).where("doc_id = leader").select("doc_id"), "doc_id", "left_semi"), "own")
    rarity = own.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    listed = own.join(rarity, "digest").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "digest"))).alias("all"))  # lines of one document
    sets = scratch.table(listed.select("doc_id", F.transform("all", lambda x: x["digest"]).alias("digests"), F.size("all").alias("size")), "sets")
    prefix = F.slice("digests", F.lit(1), (F.col("size") - F.greatest(F.ceil(F.col("size") * least).cast("int"), F.lit(1)) + 1))
    small = scratch.table(sets.select(F.col("doc_id").alias("s"), F.col("size").alias("ns"), F.explode(prefix).alias("digest")), "prefixes")
    large = sets.select(F.col("doc_id").alias("l"), F.col("size").alias("nl"), F.explode("digests").alias("digest"))
    # of two sets of one size either may be the smaller: the one of the lower id
    met = small.join(large, (small["digest"] == large["digest"]) & (F.struct("ns", "s") < F.struct("nl", "l"))).select("s", "l").distinct()
    met = scratch.table(met, "met")
    sides = met.join(sets.select(F.col("doc_id").alias("s"), F.col("digests").alias("ds"), F.col("size").alias("ns")), "s").join(sets.select(F.col("doc_id").alias("l"), F.col("digests").alias("dl")), "l")
    counted = sides.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"), F.size(F.array_intersect("ds", "dl")).cast("long").alias("shared"), "ns")
    return counted.select("a", "b", "shared", (F.col("shared") / F.col("ns")).alias("overlap")).where((F.col("shared") > 0) & (F.col("overlap") >= least))


def same_sets(pieces: DataFrame) -> DataFrame:
    """(doc_id, leader): the smallest doc_id with the same set of digests."""
    sets = pieces.distinct().groupBy("doc_id").agg(F.sha1(F.array_join(F.sort_array(F.collect_list("digest")), ",").cast("binary")).alias("set"))
    leaders = sets.groupBy("set").agg(F.min("doc_id").alias("leader"))
    return sets.join(leaders, "set").select("doc_id", "leader")


def kept_documents(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, kept, match) by the greedy rule: kept unless near a kept smaller one; match is the smallest of those.

    edges (a, b) with a < b.  The rounds follow the logarithm of the largest component, not the
    longest chain (see :mod:`greedy`).
    """
    return greedy.decide(edges, docs)[0]


def first_of_digest(pieces: DataFrame, digest: str = "digest", order: tuple[str, ...] = ("doc_id", "piece_no")) -> DataFrame:
    """pieces with ``first``: whether it is the first of its digest over the corpus."""
    least = pieces.groupBy(digest).agg(F.min(F.struct(*order)).alias("least"))
    return pieces.join(least, digest).withColumn("first", F.struct(*order) == F.col("least")).drop("least")


def numbered(rows: DataFrame, by: str, key: Column, name: str, bucket: Column) -> DataFrame:
    """rows with ``name``, their place from 1 in the order of key among those of one ``by``, and ``n``, how many those are.

    bucket must grow with the key.  Places are counted within a bucket and buckets are summed up, so
    no task holds a whole group, and a group of a third of all rows is dealt out like the others.
    """
    keyed = rows.withColumn("bucket_", bucket).withColumn("key_", key)
    sums = keyed.groupBy(by, "bucket_").agg(F.count(F.lit(1)).alias("own_"))
    order = Window.partitionBy(by).orderBy("bucket_")  # a row for each bucket
    before = sums.withColumn("before_", F.sum("own_").over(order) - F.col("own_")).withColumn("n", F.sum("own_").over(Window.partitionBy(by)))
    before = before.select(F.col(by).alias("by_"), F.col("bucket_").alias("in_"), "before_", "n")
    placed = keyed.withColumn("at_", F.row_number().over(Window.partitionBy(by, "bucket_").orderBy("key_")))
    same = F.col(by).eqNullSafe(F.col("by_")) & F.col("bucket_").eqNullSafe(F.col("in_"))
    return placed.join(before, same).withColumn(name, (F.col("at_") + F.col("before_")).cast("int")).drop("bucket_", "key_", "at_", "by_", "in_", "before_")


def splits(rows: DataFrame, value: str, parts: int = 256) -> list:
    """Values that cut rows into parts of about one size; few, so they come to the driver."""
    found = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()[0]
    return sorted(set(found or []))


def round_robin(rows: DataFrame, n: int, by: str = "doc_id", key: Column | None = None) -> DataFrame:
    """n rows dealt from each group in turn, a group's rows in the order of a hash (or key).

    No group gives more than n, so each task passes on n rows of a group at most.
    """
    key = F.md5(F.concat_ws("|", *rows.columns)) if key is None else key
    dealt = rows.withColumn("round", F.row_number().over(Window.partitionBy(by).orderBy(key))).where(F.col("round") <= n)
    return dealt.orderBy("round", by).limit(n)


def blind_split(rows: DataFrame, by: str, key: Column) -> DataFrame:
    """rows with ``split``: of each group the first share of at least one row is test, the rest dev; key is a hash in hexadecimal."""
    placed = numbered(rows, by, key, "rank_", F.substring(key, 1, 2))
    return placed.withColumn("split", F.when(F.col("rank_") <= F.greatest(F.lit(1), F.floor(F.col("n") * TEST_SHARE)), F.lit("test")).otherwise(F.lit("dev"))).drop("rank_", "n")


def even_spread(rows: DataFrame, limit: int, by: str, order: str) -> DataFrame:
    """At most limit rows of each group, at even steps of its order (a number)."""
    cuts = splits(rows, order)
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    at = numbered(rows, by, F.col(order), "rank_", bucket).withColumn("i", F.col("rank_") - 1)
    few = F.col("n") <= limit
    # row i is taken if some k has floor(k * n / limit) = i
    k = F.ceil(F.col("i") * limit / F.col("n"))
    return at.where(few | ((F.floor(k * F.col("n") / limit) == F.col("i")) & (k < limit))).drop("i", "n", "rank_")


def build_queue(clauses: DataFrame, n: int) -> DataFrame:
    """Usable clauses, each digest once, dealt in turn from the documents, the first share of the deal as test."""
    first = clauses.where(usable(F.col("text"))).withColumn("digest", text_digest(F.col("text")))
    own = first_of_digest(first, order=("doc_id", "order")).where("first").drop("first", "digest")
    dealt = round_robin(own, n, "doc_id", F.md5("clause_id")).withColumn("all", F.lit(1))
    place = Window.partitionBy("all").orderBy("round", "doc_id")  # n rows, which the caller bounds
    return dealt.withColumn("k", F.row_number().over(place)).withColumn("split", F.when(F.col("k") <= F.greatest(F.lit(1), F.floor(F.lit(n) * TEST_SHARE)), F.lit("test")).otherwise(F.lit("dev"))).drop("all", "k", "round")


def queue_spread(queue: DataFrame) -> DataFrame:
    """Documents and the least and most clauses that one has."""
    return queue.groupBy("doc_id").count().agg(F.count(F.lit(1)).alias("documents"), F.min("count").alias("least"), F.max("count").alias("most"))


def usable(text: Column) -> Column:
    return F.length(text).between(MIN_USABLE, MAX_USABLE)


def norms_numeric(samples: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """(field, n, median, p75, p90, min, max) of fields with MIN_SAMPLES values or more, by index percentile.

    Equal values are counted before they are shuffled; the buckets of a field that hold a place
    asked for are the only ones whose values are ordered, so no task sorts a whole field.
    """
    scratch = Scratch(samples.sparkSession, "norms")
    own = samples.select(F.col(field).alias("field"), F.col(value).alias("value")).where("value is not null")
    cuts = own.groupBy(F.col("field").alias("of_")).agg(F.percentile_approx("value", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))  # a row for each field
    cut = own.join(F.broadcast(cuts), F.col("field").eqNullSafe(F.col("of_"))).select("field", "value", F.size(F.filter("cuts", lambda c: c < F.col("value"))).alias("bucket"))
    counts = scratch.table(cut.groupBy("field", "bucket", "value").agg(F.count(F.lit(1)).alias("c")), "counts")
    buckets = counts.groupBy("field", "bucket").agg(F.sum("c").alias("own"), F.min("value").alias("low"), F.max("value").alias("high"))
    every = Window.partitionBy("field")  # 64 rows at most
    buckets = buckets.withColumn("before", F.sum("own").over(every.orderBy("bucket")) - F.col("own")).withColumn("n", F.sum("own").over(every)).withColumn("min", F.min("low").over(every)).withColumn("max", F.max("high").over(every))
    at = lambda q: F.least(F.floor(F.col("n") * q), F.col("n") - 1) + 1
    asked = {"lower": F.floor((F.col("n") + 1) / 2), "upper": F.floor(F.col("n") / 2) + 1, "p75": at(0.75), "p90": at(0.9)}
    places = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), r.cast("long").alias("place")) for name, r in asked.items()))).alias("p")
    wanted = buckets.where(F.col("n") >= MIN_SAMPLES).select("field", "bucket", "own", "before", "n", "min", "max", places).where("p.place > before and p.place <= before + own")
    wanted = scratch.table(wanted.select(F.col("field").alias("f_"), F.col("bucket").alias("b_"), "n", "min", "max", "p.name", (F.col("p.place") - F.col("before")).alias("offset")), "wanted")  # four rows for each field
    hit = counts.join(F.broadcast(wanted.select("f_", "b_").distinct()), F.col("field").eqNullSafe(F.col("f_")) & (F.col("bucket") == F.col("b_")), "left_semi")
    through = F.sum("c").over(Window.partitionBy("field", "bucket").orderBy("value"))
    ranked = hit.withColumn("through", through).withColumn("from", F.col("through") - F.col("c"))
    found = ranked.join(F.broadcast(wanted), F.col("field").eqNullSafe(F.col("f_")) & (F.col("bucket") == F.col("b_")) & (F.col("offset") > F.col("from")) & (F.col("offset") <= F.col("through")))
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    out = found.groupBy("field", "n", "min", "max").agg(((pick("lower") + pick("upper")) / 2).alias("median"), pick("p75").alias("p75"), pick("p90").alias("p90"))
    return out.select(F.col("field").alias(field), "n", "median", "p75", "p90", "min", "max")


def norms_from_arrays(samples: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """The same percentiles for groups that are known to be small."""
    values = samples.where(F.col(value).isNotNull()).groupBy(field).agg(F.collect_list(value).alias("v")).where(F.size("v") >= MIN_SAMPLES)
    return values.select(field, F.size("v").alias("n"), index_percentile(F.col("v"), 0.75).alias("p75"), index_percentile(F.col("v"), 0.9).alias("p90"))


def norms_boolean(samples: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """(field, n, true_rate) of fields with MIN_SAMPLES values or more."""
    own = samples.where(F.col(value).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("int")).alias("rate"))
    return own.where(F.col("n") >= MIN_SAMPLES).select(field, "n", F.bround("rate", 3).alias("true_rate"))


def norms_map(numeric: pd.DataFrame) -> dict:
    """The percentiles as the rule compiler takes them; one row for each field."""
    return {r["field"]: {"p75": r["p75"], "p90": r["p90"]} for r in numeric.to_dict("records")}
