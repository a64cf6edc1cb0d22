"""The greedy rule over a graph of neighbours: in the order of the ids, a node is kept unless it has a kept smaller neighbour.

What a node becomes can hang on a chain of any length, so rounds of joins alone would be as many as
the longest chain.  A few rounds decide what hangs on little; what is then open is cut into its
connected components, each of which one task goes through in the order of its ids, holding only the
ids that go.  Components of more than LIMIT edges are cut into blocks of the order, which follow one
another: each round joins what the earlier blocks decided and goes through one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.functions.scratch import Scratch

#: Rounds of joins before components are looked for, and edges that one task goes through.
ROUNDS, LIMIT = 3, 5_000_000
#: Edges of a partition that are joined into trees at once.
LOCAL = 500_000


def _trees(names: list[str]):
    """Edges of a partition as edges to the smallest node of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        def flushed(kinds) -> pa.RecordBatch:
            own = [(x, top(x)) for x in list(up)]
            own = [(x, y) for x, y in own if x != y]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in own], k) for i, k in enumerate(kinds)], names)

        kinds = None
        for batch in batches:
            kinds = [c.type for c in batch.columns]
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = top(a), top(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > LOCAL:
                yield flushed(kinds)
                up.clear()
        if up:
            yield flushed(kinds)

    return run


def components(edges: DataFrame, scratch: Scratch, name: str = "component") -> tuple[DataFrame, int]:
    """edges of two columns to (node, component) of all nodes but the smallest of a component, which names it; and the number of rounds.

    Stars of large and small neighbours in turn, each round a written table; ids of any ordered type.
    """
    a, b = edges.columns
    kind = edges.schema[a].dataType.simpleString()
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    now, was, k = scratch.table(clean.mapInArrow(_trees(["u", "v"]), f"u {kind}, v {kind}"), f"{name}0"), None, 0
    while True:
        size = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if size == was or not size[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")), k
        was, k = size, k + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least{k}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        scratch.drop(f"{name}-least{k}")
        now = new


def _gone_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, b, a, dropped), in this order, to (doc_id, kept, match)."""
    component, node, match, seen = None, None, None, False
    gone: set = set()
    out: list[tuple] = []
    for batch in batches:
        kind = batch.column(1).type
        for c, b, a, dropped in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not seen or b != node or c != component:
                if seen:
                    out.append((node, match is None, match))
                    if match is not None:
                        gone.add(node)
                if c != component:
                    gone.clear()
                component, node, match, seen = c, b, None, True
            if match is None and not dropped and a not in gone:
                match = a
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((kind, pa.bool_(), kind))], ["doc_id", "kept", "match"])
            out = []
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((node, match is None, match), (kind, pa.bool_(), kind), strict=True)], ["doc_id", "kept", "match"])


def decide(edges: DataFrame, docs: DataFrame) -> tuple[DataFrame, int]:
    """edges (a, b), a < b, to (doc_id, kept, match) of all documents, and the number of rounds that it took; match is the smallest kept neighbour."""
    scratch = Scratch(docs.sparkSession, "kept")
    kind = docs.schema["doc_id"].dataType.simpleString()
    edges = scratch.table(edges.select("a", "b"), "edges")  # every round reads them
    later = edges.select(F.col("b").alias("doc_id")).distinct()
    state = scratch.table(docs.select("doc_id").distinct().join(later, "doc_id", "left_anti").select("doc_id", F.lit(True).alias("kept"), F.lit(None).cast(kind).alias("match")), "state0")
    open_, k = scratch.table(later, "open0"), 0
    while k < ROUNDS and open_.limit(1).count():
        k += 1
        known = edges.join(open_, edges["b"] == open_["doc_id"], "left_semi").join(state.select(F.col("doc_id").alias("a"), F.col("kept").alias("a_kept")), "a", "left")
        ready = known.groupBy(F.col("b").alias("doc_id")).agg(F.count_if(F.col("a_kept").isNull()).alias("unknown"), F.min(F.when(F.col("a_kept"), F.col("a"))).alias("match"), F.min(F.when(F.col("a_kept").isNull(), F.col("a"))).alias("least"))
        # a match counts once no smaller neighbour is open
        decided = ready.where("unknown = 0 or match < least").select("doc_id", F.col("match").isNull().alias("kept"), "match")
        state = scratch.table(state.unionByName(decided), f"state{k}")
        open_ = scratch.table(open_.join(state, "doc_id", "left_anti"), f"open{k}")
        scratch.drop(f"state{k - 1}")
        scratch.drop(f"open{k - 1}")
    if not open_.limit(1).count():
        return state, k

    # what is open hangs on open neighbours, and on kept ones that are larger than these
    known = state.where("kept").select(F.col("doc_id").alias("a"))
    own = edges.join(open_, edges["b"] == open_["doc_id"], "left_semi")
    rest = scratch.table(own.join(known.unionByName(open_.select(F.col("doc_id").alias("a"))), "a", "left_semi").select("a", "b"), "rest")
    found, rounds = components(rest.join(known, "a", "left_anti"), scratch)
    found = scratch.table(found, "components")
    k += rounds
    named = rest.join(found.select(F.col("node").alias("b"), "component"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    named = scratch.table(named, "named")
    large = named.groupBy("component").count().where(F.col("count") > LIMIT).select("component", "count")
    large = scratch.table(large, "large")
    schema = f"doc_id {kind}, kept boolean, match {kind}"
    order = ["component", "b", "a"]
    parts = [state, named.join(large, "component", "left_anti").select(*order, F.lit(False).alias("dropped")).repartition("component").sortWithinPartitions(*order).mapInArrow(_gone_through, schema)]
    edges_in_large = large.agg(F.sum("count")).first()[0] or 0
    if edges_in_large:
        blocks = math.ceil(edges_in_large / LIMIT)
        cut = named.join(large, "component", "left_semi").select(*order).repartitionByRange(blocks, "component", "b").withColumn("block", F.spark_partition_id())
        cut = scratch.table(cut, "cut")
        for n in range(blocks):
            k += 1
            before = parts[2].where("not kept").select(F.col("doc_id").alias("a"), F.lit(True).alias("dropped")) if len(parts) > 2 else None
            now = cut.where(F.col("block") == n).drop("block")
            now = now.join(before, "a", "left").withColumn("dropped", F.coalesce("dropped", F.lit(False))) if before is not None else now.withColumn("dropped", F.lit(False))
            through = scratch.table(now.select(*order, "dropped").repartition("component").sortWithinPartitions(*order).mapInArrow(_gone_through, schema), f"block{n}")
            parts[2:] = [parts[2].unionByName(through) if len(parts) > 2 else through]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = scratch.table(out, "decided")
    left = open_.join(out, "doc_id", "left_anti").select("doc_id", F.lit(True).alias("kept"), F.lit(None).cast(kind).alias("match"))
    return out.unionByName(left), k
