"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most 2r bits exactly if some value lies within r bits of
both.  So every distinct fingerprint stands for all variants within r bits, equal variants meet,
and those that collide are linked.  With r = 2 a fingerprint has 2081 variants.

Variants are dealt out by a linear code of their bits: a fingerprint goes once to each shard in
which one of its variants falls, and the shard makes just those variants.  That is the shuffle on
variants with each fingerprint written once for a shard instead of once for a variant.  The
number of shards follows the number of distinct fingerprints, so that a shard's variants are
bounded, and a task takes one shard after the other from sorted input.

Copies share a fingerprint and are one node.  Within a bucket each fingerprint is linked to the
next one only, and a task passes on a spanning forest, so large groups give no pairs.

Defined cases: a null or empty text has fingerprint zero, linked like any other; a null doc_id
takes no part in the smallest doc_id (null if its whole component has none); repeated rows each
get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import Scratch, small_batches, text_buffers
from contractlens.llm.components import components, forest

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Variants a shard is meant for, 64 MB of fingerprints at most; from 64 shards on their number follows the input.
SHARD_VARIANTS = 1 << 23
#: Partitions that shards are dealt to at most; a task holds one shard at a time, however many it gets.
PARTITIONS = 1 << 16
#: Variants that a shard makes at once.
VARIANTS_AT_ONCE = 1 << 21
#: Links that a task holds before it passes their forest on.
HELD_LINKS = 1 << 21
_U = np.uint64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: majority of the bits of its shingles' XXH64, as unsigned."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, ones = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        to = min(n, i + (1 << 16))
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i:to].tolist(), ends[i + shingle - 1 : to + shingle - 1].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            raw = memoryview(data)
            values = [fingerprint(bytes(raw[a:b]), shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(np.array(values, dtype=_U).view(np.int64))], [*keep, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep columns, fp): fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(_fingerprints(shingle, list(keep)), f"{schema}, fp long")


class Ball:
    """The offsets of weight 0 to r, by their code; the code of x ^ e is code(x) ^ code(e)."""

    def __init__(self, radius: int, code_bits: int):
        self.code_bits = code_bits
        # a column of the code for each bit of a fingerprint: fixed, spread out, none of them zero
        step = np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)
        self.columns = np.maximum((step ^ (step >> _U(29))) >> _U(64 - code_bits), _U(1))
        bits = _U(1) << np.arange(64, dtype=_U)
        masks = [_U(0)]
        for k in range(1, radius + 1):
            masks += [np.bitwise_xor.reduce(bits[list(c)]) for c in combinations(range(64), k)]
        self.masks = np.array(masks, dtype=_U)
        codes = self.code(self.masks)
        order = np.argsort(codes, kind="stable")
        self.masks, self.codes = self.masks[order], codes[order]
        self.reach = np.unique(self.codes)

    def code(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=_U)
        for i in range(64):
            out ^= ((x >> _U(i)) & _U(1)) * self.columns[i]
        return out

    def of(self, code: int) -> np.ndarray:
        a, b = np.searchsorted(self.codes, [_U(code), _U(code)], side="left")[0], np.searchsorted(self.codes, _U(code), side="right")
        return self.masks[a:b]


def links(fps: np.ndarray, shard: int, ball: Ball) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints with a common variant in the shard."""
    fps = np.unique(fps)
    codes = ball.code(fps)
    order = np.argsort(codes, kind="stable")
    fps, codes = fps[order], codes[order]
    per = [(fps[a:b], offsets) for a, b in _runs(codes) if len(offsets := ball.of(int(codes[a]) ^ shard))]
    total = sum(len(x) * len(e) for x, e in per)
    rounds = max(1, -(-total // VARIANTS_AT_ONCE))
    found = [np.zeros(0, _U)], [np.zeros(0, _U)]
    for k in range(rounds):  # variants of one residue at a time: equal ones fall in the same round
        variants, owners = [], []
        for x, e in per:
            for i in range(0, len(x), max(1, VARIANTS_AT_ONCE // len(e))):
                part = x[i : i + max(1, VARIANTS_AT_ONCE // len(e))]
                v = (part[:, None] ^ e[None, :]).ravel()
                o = np.repeat(part, len(e))
                if rounds > 1:
                    own = (v * _U(0xBF58476D1CE4E5B9) >> _U(32)) % _U(rounds) == _U(k)
                    v, o = v[own], o[own]
                variants.append(v)
                owners.append(o)
        if not variants:
            continue
        v, o = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(v)
        v, o = v[order], o[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        a, b = o[same], o[same + 1]
        near = np.bitwise_count(a ^ b) <= 2 * int(np.bitwise_count(ball.masks).max())  # verify
        pair = np.unique(np.stack([a[near], b[near]], 1), axis=0) if near.any() else np.zeros((0, 2), _U)
        found[0].append(pair[:, 0])
        found[1].append(pair[:, 1])
    return np.concatenate(found[0]), np.concatenate(found[1])


def _runs(sorted_values: np.ndarray):
    edges = np.flatnonzero(np.diff(sorted_values, prepend=sorted_values[:1] ^ _U(1), append=sorted_values[-1:] ^ _U(1)))
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _deal(radius: int, code_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(radius, code_bits)
        held: list[np.ndarray] = []

        def flush():
            x = np.unique(np.concatenate(held))
            codes = ball.code(x)
            shards, rows = [], []
            for reach in ball.reach:
                to = codes ^ reach
                order = np.argsort(to, kind="stable")
                for a, b in _runs(to[order]):
                    shards.append(int(to[order[a]]))
                    rows.append(np.sort(x[order[a:b]]).tobytes())
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(shards[i : i + 256], pa.int64()), pa.array(rows[i : i + 256], pa.binary())], ["shard", "fps"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(_U))
            if sum(map(len, held)) >= 1 << 16:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return run


def _meet(radius: int, code_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(radius, code_bits)
        a = b = np.zeros(0, dtype=np.int64)
        held: list[bytes] = []
        last = None

        def met(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x, y = links(np.frombuffer(b"".join(held), dtype=_U), last, ball)
            held.clear()
            return forest(np.concatenate([a, x.view(np.int64)]), np.concatenate([b, y.view(np.int64)]))

        def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])

        for batch in batches:  # sorted by shard
            for shard, fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and shard != last:
                    a, b = met(a, b)
                    if len(a) > HELD_LINKS:
                        yield from out(a, b)
                        a = b = np.zeros(0, dtype=np.int64)
                last = shard
                held.append(fps)
        if held:
            a, b = met(a, b)
        yield from out(a, b)

    return run


def fingerprint_links(fps: DataFrame, distinct: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that span the graph of fingerprints at radius or fewer differing bits.

    fps: one long column of distinct values; distinct: how many there are.
    """
    if radius % 2:
        raise ValueError("ball hashing needs an even radius")
    ball = sum(math.comb(64, k) for k in range(radius // 2 + 1))
    code_bits = min(32, max(6, (max(distinct, 1) * ball // SHARD_VARIANTS).bit_length()))
    dealt = fps.mapInArrow(_deal(radius // 2, code_bits), "shard long, fps binary")
    sharded = dealt.repartition(min(1 << code_bits, PARTITIONS), "shard").sortWithinPartitions("shard")
    return sharded.mapInArrow(_meet(radius // 2, code_bits), "a long, b long")


def _rooted(prints: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """prints (doc_id, fp): (fp, least, root), a row for each fingerprint, with its smallest doc_id and its component."""
    nodes = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), nodes.count(), radius), scratch)
    # written tables on both sides of a join let Spark split the partition of a large group
    return scratch.table(nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, shingle), "prints")
    rooted = _rooted(prints, radius, scratch)
    smallest = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = scratch.table(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, with all their columns, for tables whose ids name rows.

    Of several rows with that doc_id one stays.  Rows without a doc_id can't be named and all stay.
    Where ids repeat or are missing, :func:`one_row_of_each` tells rows apart by what they hold.
    """
    kept = near_duplicates(docs, radius).where("doc_id = component_id").groupBy("doc_id").count().withColumnsRenamed({"doc_id": "_kept_id", "count": "_kept_n"})
    kept = Scratch(docs.sparkSession, "kept").table(kept, "kept")
    # the ids grow with the documents: never broadcast, and hashed, so that texts are not sorted
    ids = kept.select("_kept_id").hint("shuffle_hash")
    out = docs.join(ids, F.col("doc_id") == F.col("_kept_id"), "left_semi")
    if kept.where("_kept_n > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id is null"))


def one_row_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Exactly one row of each group of near-duplicates, with all its columns.

    The row with the smallest doc_id stays, one without a doc_id only if its whole group has none; of
    several such rows the one of the least fingerprint and then of the least hash of all columns, so
    the choice is the same on every run.  Rows that are equal in all of these are one.  Different
    texts under one doc_id, or without one, are rows of their own.
    """
    scratch = Scratch(docs.sparkSession, "survivors")
    names = [f"c{i}_" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    mark = F.xxhash64(*(F.to_json(c) if "map<" in kind else F.col(c) for c, kind in plain.dtypes))
    marked = plain.select("*", mark.alias("mark_"))
    prints = fingerprints(marked.select(F.col(id_).alias("doc_id"), F.col(text).alias("text"), "mark_"), keep=("doc_id", "mark_"))
    # one row for each different row of docs: copies are counted before they meet anything
    kinds = scratch.table(prints.groupBy("doc_id", "mark_", "fp").agg(F.count(F.lit(1)).alias("copies")), "kinds")
    rooted = _rooted(kinds, radius, scratch)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "mark_", "copies")
    kept = kinds.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("k"))
    kept = scratch.table(kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.mark_").alias("kept_mark"), F.col("k.copies").alias("copies")), "kept")
    # the ids grow with the documents: never broadcast, and hashed, so that texts are not sorted
    same = (F.col("mark_") == F.col("kept_mark")) & F.col(id_).eqNullSafe(F.col("kept_id"))
    out = marked.join(kept.select("kept_id", "kept_mark").hint("shuffle_hash"), same, "left_semi")
    if kept.where("copies > 1").limit(1).count():
        out = out.dropDuplicates([id_, "mark_"])
    return out.select(*names).toDF(*docs.columns)
