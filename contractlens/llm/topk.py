"""Exact top-k by inner product, by selection in histograms of all scores.

Every query is scored against every row.  A pass over the rows gives, for each query, the number
of scores in each bin of its range; the bin that holds the k-th highest is the next range, until
the scores above its lower end are few or the bin is a single place.  A last pass keeps the scores
from there on, and ties go to the smaller id.

Bins lie on a scale of places: a score's place is the rank of its double among those of whole
numbers, so a place keeps the order, and eight passes settle scores of any size.  The bin of the
k-th score is found in Spark; one row for each query comes to the driver.

Queries are taken in groups, bounded by the numbers in their vectors and in their histograms, and
each group is broadcast; rows are never shuffled.  Where the lengths of two vectors allow it the
product is exact in double precision; other pairs are multiplied as whole numbers of any size.

Defined cases: vectors that are null, or hold null, NaN or infinity (or a component that scaling
makes infinite), or differ in length from the group's, take no part; neither do rows without an id.
A score that does not fit a long counts as the nearest long.  Repeated ids are rows of their own (a
row is never its own id's candidate).  Fewer than k candidates give all; an empty table, or none to
ask for, gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contractlens.llm.common import Scratch

K = 5
SCALE = 256
#: Bins of a histogram, as a power of two.
BIN_BITS = 8
BINS = 1 << BIN_BITS
#: Numbers in a group's query matrix (16 MB) and in its histograms (64 MB).
GROUP_NUMBERS, HISTOGRAM_NUMBERS = 2 << 20, 8 << 20
#: A query is settled when so many scores at most stand from its k-th highest bin on.
FEW = 64
#: Scores that a task holds at once.
SCORES_AT_ONCE = 4 << 20
#: Up to here whole numbers are exact in double precision.
EXACT = float(1 << 53)
#: Queries of this length or more make groups of their own, so that they slow down no others.
LONG = float(1 << 26)
MOST = (1 << 63) - 1
_ONE = int(np.float64(1).view(np.int64))


def integer_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as doubles; rows that take no part are left out."""
    x = F.col("embedding")
    whole = lambda c: F.floor(F.lit(scale) * c.cast("double"))
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(scaled(c)) & (F.abs(scaled(c)) < F.lit(float("inf"))), F.lit(False)))
    # a double beyond a long is whole already, and floor() would cut it to a long
    floored = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < F.lit(EXACT), whole(c).cast("double")).otherwise(scaled(c)))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), floored.alias("v"))


def places(scores: np.ndarray) -> np.ndarray:
    """The place of each whole number on a scale that keeps the order: 0 for 0, then double by double."""
    size = np.abs(scores)
    return np.where(size < 1, 0, np.sign(scores).astype(np.int64) * (size.view(np.int64) - (_ONE - 1)))


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths, infinite where a square is."""
    with np.errstate(over="ignore"):
        return np.sqrt((vectors * vectors).sum(1))


class Group:
    """Queries of one length and what is known of their k-th highest scores."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, longest: float):
        self.ids, self.vectors, self.copies = ids, vectors, copies
        own = lengths(vectors)
        self.reach = float(own.max(initial=0.0))
        with np.errstate(over="ignore", invalid="ignore"):
            bound = np.minimum(np.nan_to_num(np.ceil(own * longest * (1 + 1e-9)), nan=0.0, posinf=2.0**63), 2.0**63)
        top = places(bound) + 1
        self.low = -top  # [low, low + (BINS << shift)) holds the place of the k-th
        self.shift = np.array([max(0, int(2 * t + 1).bit_length() - BIN_BITS) for t in top.tolist()], dtype=np.int64)
        self.open = np.ones(len(ids), dtype=bool)

    def scores(self, which: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores as longs) of some queries against rows."""
        plain = lengths(rows) * self.reach < EXACT
        with np.errstate(over="ignore", invalid="ignore"):
            close = self.vectors[which] @ np.where(plain[:, None], rows, 0.0).T
        exact = close.astype(np.int64)
        far = np.flatnonzero(~plain)
        if len(far):
            whole = [[int(x) for x in q] for q in self.vectors[which].tolist()]
            for j in far.tolist():
                row = [int(x) for x in rows[j].tolist()]
                exact[:, j] = [max(-MOST, min(MOST, sum(map(int.__mul__, q, row)))) for q in whole]
            close[:, far] = exact[:, far].astype(np.float64)
        return places(close), exact


def _scores(batch: pa.RecordBatch, size: int):
    """(ids, matrix) of the rows of a batch whose vectors have the size, in parts."""
    column = batch.column("v")
    lengths = np.diff(column.offsets.to_numpy())
    own = np.flatnonzero(lengths == size)
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    if size == 0:
        yield ids[own], np.zeros((len(own), 0))
        return
    values = column.values.to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1][own]
    for i in range(0, len(own), 1024):
        yield ids[own[i : i + 1024]], values[starts[i : i + 1024, None] + np.arange(size)]


def _parts(group: Group, rows: int):
    step = max(1, SCORES_AT_ONCE // max(rows, 1))
    return (slice(i, i + step) for i in range(0, len(group.ids), step))


def _count(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Group = held.value
        counts = np.zeros((len(g.ids), BINS + 1), dtype=np.int64)  # the last: beyond the range
        for batch in batches:
            for ids, rows in _scores(batch, g.vectors.shape[1]):
                for part in _parts(g, len(ids)):
                    open_ = np.flatnonzero(g.open[part]) + part.start
                    if not len(open_):
                        continue
                    bins = np.clip((g.scores(open_, rows)[0] - g.low[open_, None]) >> g.shift[open_, None], -1, BINS)
                    bins[g.ids[open_, None] == ids[None, :]] = -1
                    q, _ = np.nonzero(bins >= 0)
                    flat = q * (BINS + 1) + bins[bins >= 0]
                    counts[open_] += np.bincount(flat, minlength=len(open_) * (BINS + 1)).reshape(len(open_), -1)
        q, b = np.nonzero(counts)
        for i in range(0, len(q), 1 << 16):
            x, y = q[i : i + (1 << 16)], b[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(counts[x, y])], ["q", "bin", "n"])

    return run


def _best(found: np.ndarray, k: int) -> np.ndarray:
    """Of columns (query, id, score) the k best of each query: high scores first, then small ids."""
    found = found[:, np.lexsort((found[1], -found[2], found[0]))]
    first = np.searchsorted(found[0], found[0])
    return found[:, np.arange(found.shape[1]) - first < k]


def _keep(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Group = held.value
        best, new, size = np.zeros((3, 0), dtype=np.int64), [], 0
        for batch in batches:
            for ids, rows in _scores(batch, g.vectors.shape[1]):
                for part in _parts(g, len(ids)):
                    which = np.arange(len(g.ids))[part]
                    place, scores = g.scores(which, rows)
                    q, c = np.nonzero((place >= g.low[part, None]) & (g.ids[part, None] != ids[None, :]))
                    new.append(np.stack([q + part.start, ids[c], scores[q, c]]))
                    size += len(q)
                    if size > 1 << 18:  # many equal scores: a task needs no more than k of them
                        best, new, size = _best(np.concatenate([best, *new], axis=1), k), [], 0
        q, ids, scores = _best(np.concatenate([best, *new], axis=1), k)
        for i in range(0, len(q), 1 << 16):
            part = slice(i, i + (1 << 16))
            columns = [q[part], g.ids[q[part]], g.copies[q[part]], ids[part], scores[part]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "query_id", "copies", "vec_id", "score"])

    return run


def _refine(g: Group, rows: DataFrame, k: int) -> None:
    """Passes over the rows until the k-th highest score of each query is known closely enough."""
    spark = rows.sparkSession
    down = Window.partitionBy("q").orderBy(F.desc("bin"))  # a row for each bin of a query
    while g.open.any():
        held = spark.sparkContext.broadcast(g)
        sums = rows.mapInArrow(_count(held), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        enough = sums.withColumn("above", F.sum("n").over(down)).where(F.col("above") >= k)
        cut = enough.groupBy("q").agg(F.max(F.struct("bin", "above")).alias("b")).select("q", "b.bin", "b.above").toPandas()  # a row for each query of the group
        held.destroy()
        settled = np.ones(len(g.ids), dtype=bool)  # a query that is not there has fewer than k candidates: all are kept
        for q, b, above in zip(cut["q"].tolist(), cut["bin"].tolist(), cut["above"].tolist(), strict=True):
            g.low[q] += b << int(g.shift[q])
            settled[q] = above <= max(FEW, k) or not g.shift[q]
            g.shift[q] = max(0, g.shift[q] - BIN_BITS)
        g.open &= ~settled


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that is_query holds for, against all others.

    vectors: (vec_id, v) as of :func:`integer_vectors`.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.table(vectors, "rows")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    # equal rows ask once; equal ids with different vectors fall into different groups
    asked = rows.where(is_query).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    queries = scratch.table(asked.withColumn("size", F.size("v")).withColumn("far", norm >= LONG), "queries")
    out = []
    for size, far, n in sorted(tuple(r) for r in queries.groupBy("size", "far").count().collect()):  # two rows for each vector length
        longest = rows.where(F.size("v") == size).agg(F.max(norm)).first()[0]
        per = max(1, min(GROUP_NUMBERS // max(1, size), HISTOGRAM_NUMBERS // (BINS + 1)))
        groups = -(-n // per)
        own = queries.where((F.col("size") == size) & (F.col("far") == far))
        for i in range(groups):
            # pmod of a hash deals queries evenly; a group is collected with twice its share as the bound
            part = own.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)) == i).select("vec_id", "v", "copies").toPandas()
            if not len(part):
                continue
            matrix = np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), size)
            g = Group(part["vec_id"].to_numpy(np.int64), matrix, part["copies"].to_numpy(np.int64), longest)
            _refine(g, rows, k)
            held = spark.sparkContext.broadcast(g)
            found = rows.mapInArrow(_keep(held, k), "q long, query_id long, copies long, vec_id long, score long")
            order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
            best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            each = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            out.append(scratch.table(each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), f"best{size}_{far}_{i}"))
            held.destroy()
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, out)
