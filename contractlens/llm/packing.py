"""Best-fit packing of documents into sequences by a linear grouping scheme.

Only the histogram of piece lengths decides the packing, and it has as many entries as a sequence
has tokens, whatever the corpus.  So the plan is made on the driver from bounded data:

1. lengths above an eighth of a sequence are dealt into groups of equal cardinality, and each
   group's lengths are rounded up to its largest (de la Vega and Lueker);
2. the few rounded sizes give a configuration programme (Gilmore and Gomory), solved by column
   generation; its solution is rounded down;
3. the actual lengths take the places of the rounded ones, which leaves room;
4. what is left, and the small ones, go best-fit into that room, longest first.

The plan says which ranks of which length go to which run of sequences.  Pieces are ranked within
their length without a shuffle of the texts, and look their place up in the plan.

Defined cases: a null or empty text is a document of the end id alone; a text of any length, long
runs of blanks included, is encoded whole; a null doc_id stays null; repeated rows are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contractlens.llm.common import Scratch, small_batches

LENGTH = 1024
END = 2
#: Lengths up to LENGTH / SMALL are small.
SMALL = 8
GROUPS = 96

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary as packed little-endian uint32.

    Where the ids are in the order of the merges, the faster of two libraries gives the same ids;
    texts that hold an added token's string go to the other, and so do those that the faster one
    refuses (its pattern search gives up on runs of about a million blanks), before anything is
    put out.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.words = self._ranks(spec)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(added) or r"(?!)")

    @staticmethod
    def _ranks(spec: dict):
        """The same vocabulary for the faster library, if its ids are in the order of its merges."""
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab = model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or merged != sorted(merged) or min(merged) < 256:
            return None
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if word not in added}
        # the pattern that byte-level vocabularies of this kind cut texts with (fixed value)
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.words is not None and not self.added.search(text):
            with contextlib.suppress(ValueError):
                return self.words.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, length: int, end: int, with_ids: bool):
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), np.zeros(length + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            row, piece, start, size, crc, rank, raw = [], [], [], [], [], [], []
            for d, raw_ids in enumerate(enc.ids(t or "") for t in batch.column("text").to_pylist()):
                ids = memoryview(raw_ids + tail)
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // length)):
                    to = at + length if k else (n - 1) % length + 1
                    own = ids[4 * at : 4 * to]
                    row.append(d)
                    piece.append(k)
                    start.append(at)
                    size.append(to - at)
                    crc.append(zlib.crc32(own))
                    rank.append(int(seen[to - at]))
                    seen[to - at] += 1
                    if with_ids:
                        raw.append(bytes(own))
                    at = to
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc)), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return run


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of each document, with a rank among those of the same length in the same task."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, length, end, with_ids), schema)


class Plan:
    """Runs of equal sequences: (how many, free tokens, [(length, first rank, offset)])."""

    def __init__(self, counts: np.ndarray, length: int = LENGTH, groups: int = GROUPS):
        self.length = length
        self.left = counts.astype(np.int64).copy()  # not yet placed, by length
        self.next = np.zeros(length + 1, dtype=np.int64)  # rank of the next one to place
        self.done: list[tuple[int, list]] = []  # runs without room
        self.open: dict[int, list[tuple[int, list]]] = {}  # by free tokens
        self._put(int(self.left[length]), [], length, 1)
        for sizes, runs in self._configurations(groups):
            self._substitute(sizes, runs)
        for size in range(length, 0, -1):
            self._best_fit(size)

    def _take(self, size: int, n: int) -> int:
        first = int(self.next[size])
        self.next[size] += n
        self.left[size] -= n
        return first

    def _keep(self, n: int, slots: list, used: int) -> None:
        if n:
            (self.done if used == self.length else self.open.setdefault(self.length - used, [])).append((n, slots))

    def _put(self, n: int, slots: list, size: int, copies: int, used: int = 0) -> None:
        """n sequences of a run get so many more pieces of a size each."""
        if n:
            more = [(size, self._take(size, n), used + size * j) for j in range(copies)]
            self._keep(n, slots + more, used + size * copies)

    def _configurations(self, groups: int):
        """Yields (the lengths in each group, longest first, with counts) and runs of configurations."""
        low = self.length // SMALL
        sizes = [s for s in range(self.length - 1, low, -1) if self.left[s]]
        if not sizes:
            return
        total = int(sum(self.left[s] for s in sizes))
        dealt: list[list[list[int]]] = []  # groups of [length, count]
        k, room = 0, 0
        for s in sizes:
            n = int(self.left[s])
            while n:
                if not room:
                    room = total * (k + 1) // groups - total * k // groups
                    k += 1
                    if room:
                        dealt.append([])
                    continue
                took = min(n, room)
                dealt[-1].append([s, took])
                n, room = n - took, room - took
        merged: list[list[list[int]]] = []  # groups of one rounded size are one
        for g in dealt:
            if merged and merged[-1][0][0] == g[0][0]:
                merged[-1] += g
            else:
                merged.append(g)
        rounded = np.array([g[0][0] for g in merged])
        need = np.array([sum(n for _, n in g) for g in merged], dtype=float)
        yield merged, _column_generation(rounded, need, self.length)

    def _substitute(self, groups: list, runs: list) -> None:
        """Actual lengths take the rounded places; a run is cut where one of its lengths changes."""
        for config, n in runs:
            slots = [g for g, copies in config for _ in range(copies)]
            while n:
                heads: list[list] = []  # where each slot takes from now
                for g in dict.fromkeys(slots):
                    while groups[g] and not groups[g][0][1]:
                        groups[g].pop(0)
                m, chosen = n, []
                for g in dict.fromkeys(slots):
                    copies = slots.count(g)
                    have = groups[g][0][1] if groups[g] else 0
                    if have >= copies:
                        m = min(m, have // copies)
                        chosen += [(groups[g][0], copies)]
                    else:  # the last ones of a length: one sequence takes from several lengths
                        m = min(m, 1)
                        short = copies
                        for run in groups[g]:
                            use = min(short, run[1])
                            if use:
                                chosen.append((run, use))
                                short -= use
                heads = chosen
                used, out = 0, []
                for run, copies in heads:
                    for _ in range(copies):
                        out.append((run[0], self._take(run[0], m), used))
                        used += run[0]
                        run[1] -= m
                if out:
                    self._keep(m, out, used)
                n -= m

    def _best_fit(self, size: int) -> None:
        free = sorted(r for r in self.open if r >= size and self.open[r])
        for room in free:
            while self.open[room] and self.left[size]:
                n, slots = self.open[room].pop()
                used, copies = self.length - room, room // size
                whole = min(n, int(self.left[size]) // copies)
                if whole < n:
                    rest = [(s, r + whole, o) for s, r, o in slots]
                    more = min(int(self.left[size]) - whole * copies, copies)
                    if not whole and not more:
                        self.open[room].append((n, slots))
                        break
                    self._put(whole, slots, size, copies, used)
                    if more:
                        self._put(1, rest, size, more, used)
                        rest = [(s, r + 1, o) for s, r, o in rest]
                    self._keep(n - whole - bool(more), rest, used)
                else:
                    self._put(n, slots, size, copies, used)
            if not self.left[size]:
                return
        copies = self.length // size
        whole, more = divmod(int(self.left[size]), copies)
        self._put(whole, [], size, copies)
        if more:
            self._put(1, [], size, more)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted keys (length << 48 | first rank), first sequence and offset of each; and the number of sequences."""
        keys, sequences, offsets, at = [], [], [], 0
        for n, slots in [*self.done, *(r for runs in self.open.values() for r in runs)]:
            for size, rank, offset in slots:
                keys.append(size << 48 | rank)
                sequences.append(at)
                offsets.append(offset)
            at += n
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        return np.array(keys, dtype=np.int64)[order], np.array(sequences, dtype=np.int64)[order], np.array(offsets, dtype=np.int64)[order], at


def _column_generation(sizes: np.ndarray, need: np.ndarray, room: int, rounds: int = 3000) -> list:
    """Configurations [(group, copies), ...] with whole numbers of sequences, at most the need."""
    k = len(sizes)
    columns = np.diag((room // sizes).astype(float))  # each a configuration of one size
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ need
    for _ in range(rounds):
        price = inverse.sum(0)  # duals: every sequence costs one
        best, used = _knapsack(sizes, price, room)
        if best <= 1 + 1e-7:
            break
        enter = np.bincount(used, minlength=k).astype(float)
        way = inverse @ enter
        if not (way > 1e-9).any():
            break
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        columns[:, out] = enter
        x = np.maximum(x - step * way, 0)
        x[out] = step
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot
    whole = np.floor(x + 1e-6).astype(np.int64)
    spare = need.astype(np.int64).copy()
    runs = []
    for j in np.argsort(-whole, kind="stable"):
        config = [(g, int(round(columns[g, j]))) for g in range(k) if columns[g, j] > 0.5]
        n = int(min([whole[j], *(spare[g] // c for g, c in config)])) if config else 0
        if n:
            runs.append((config, n))
            for g, c in config:
                spare[g] -= n * c
    return runs


def _knapsack(sizes: np.ndarray, price: np.ndarray, room: int) -> tuple[float, list[int]]:
    """The worthiest configuration: its value and its groups, with repeats."""
    use = np.flatnonzero(price > 1e-12)
    s, p = sizes[use], price[use]
    order = np.argsort(s, kind="stable")
    use, s, p = use[order], s[order], p[order]
    value, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(s, np.arange(room + 1), side="right")
    for c in range(int(s[0]) if len(s) else room + 1, room + 1):
        n = fits[c]
        gain = value[c - s[:n]] + p[:n]
        i = int(gain.argmax())
        if gain[i] > value[c - 1] + 1e-12:
            value[c], pick[c] = gain[i], i
        else:
            value[c] = value[c - 1]
    out, c = [], room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out.append(int(use[pick[c]]))
            c -= int(s[pick[c]])
    return float(value[room]), out


def _place(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets, _ = held.value
        for batch in batches:
            names = batch.schema.names
            size, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, size << 48 | rank, side="right") - 1
            sequence = sequences[at] + rank - (keys[at] & ((1 << 48) - 1))
            stay = [c for c in names if c not in ("part", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in stay), pa.array(sequence), pa.array(offsets[at])], [*stay, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").table(pieces(docs, path, length, end, with_ids), "pieces")
    own = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = own.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = np.zeros(length + 1, dtype=np.int64)
    for size, n in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each length at most
        counts[size] = n
    plan = spark.sparkContext.broadcast(Plan(counts, length).places())  # bounded by the length of a sequence
    ranked = cut.join(first, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).select(*cut.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name not in ("part", "rank"))
    return ranked.mapInArrow(_place(plan), f"{schema}, sequence_id long, offset long")
