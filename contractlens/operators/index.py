"""A stored inverted index: postings cut by term, sizes by owner, and generations of both.

Postings lie in folders by a bucket of their term, in the order of the term, so a search reads the
buckets of its terms and of those only the row groups that may hold them; passages are not read.
An owner (an act, or a document) belongs to the last generation that names it: a change writes the
postings of changed owners alone, and document frequencies and the mean size follow from what is
current.  Writing a generation again replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.functions.scratch import Scratch
from contractlens.functions.text import tokens

BUCKETS = 64
#: Distinct asked terms up to which the scan itself is told them.
LISTED = 1000


def bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write(passages: DataFrame, path: str, generation: int = 0, removed: DataFrame | None = None) -> None:
    """passages (key, owner, text; by place) as a generation; removed (owner) are owners that have no passages any more.

    The first generation replaces what is there.
    """
    key, owner, text = passages.columns
    own = passages.select(F.col(key).alias("key"), F.col(owner).alias("owner"), tokens(F.col(text)).alias("t")).withColumn("size", F.size("t"))
    counts = own.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    if removed is not None:
        counts = counts.unionByName(removed.select(F.col(removed.columns[0]).alias("owner"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total")))
    found = own.select("key", "owner", "size", F.explode("t").alias("term")).groupBy("key", "owner", "size", "term").agg(F.count(F.lit(1)).alias("tf"))
    cut = found.withColumn("bucket", bucket("term")).withColumn("generation", F.lit(generation)).repartitionByRange("bucket", "term", "key").sortWithinPartitions("bucket", "term", "key")
    for name, df, by in (("postings", cut, ["generation", "bucket"]), ("owners", counts.withColumn("generation", F.lit(generation)), ["generation"])):
        out = df.write.mode("overwrite").partitionBy(*by)
        (out.option("partitionOverwriteMode", "dynamic" if generation else "static")).parquet(f"{path}/{name}")


def update(spark: SparkSession, passages: DataFrame, path: str, removed: DataFrame | None = None) -> int:
    """A new generation with the passages of changed owners; returns its number."""
    last = spark.read.parquet(f"{path}/owners").agg(F.max("generation")).first()[0]
    write(passages, path, last + 1, removed)
    return last + 1


class Terms:
    """The current postings and their statistics."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        owners = spark.read.parquet(f"{path}/owners")
        self.last = owners.agg(F.max("generation")).first()[0]
        latest = F.max_by(F.struct("generation", "n", "total"), "generation").alias("x")
        self.owners = owners.groupBy("owner").agg(latest).select("owner", "x.*")

    def totals(self) -> DataFrame:
        """One row: n passages and the mean of their sizes."""
        return self.owners.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))

    def postings(self, terms: list[str] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """(key, owner, size, term, tf) of the current generations; of some buckets and terms only, if given."""
        post = self.spark.read.parquet(f"{self.path}/postings")
        if buckets is not None:
            post = post.where(F.col("bucket").isin(buckets))
        if terms is not None:
            post = post.where(F.col("term").isin(terms))
        if self.last:  # an owner's older generations don't count
            post = post.join(self.owners.select("owner", "generation"), ["owner", "generation"], "left_semi")
        return post.select("key", "owner", "size", "term", "tf")

    def search(self, queries: DataFrame, k: int | None = 5) -> DataFrame:
        """queries (query_id, query) to (query_id, key, score, rank), as :func:`statutes.bm25` ranks them."""
        from contractlens.operators import statutes

        scratch = Scratch(self.spark, "search")
        asked, few = statutes._asked(queries, [], scratch)
        distinct = asked.select("term").distinct()
        buckets = [r[0] for r in distinct.select(bucket("term")).distinct().collect()]  # BUCKETS at most
        listed = [r[0] for r in distinct.limit(LISTED + 1).collect()]
        post = self.postings(listed if len(listed) <= LISTED else None, buckets)
        if len(listed) > LISTED:
            post = post.join(few(distinct), "term", "left_semi")
        return statutes.ranked(post, asked, self.totals(), "key", scratch, few, [], post, k)
