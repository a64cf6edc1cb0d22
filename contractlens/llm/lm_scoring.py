"""Language-model scores by deleted interpolation.

The probability of a word after another is a mixture of three estimates: the pair's share of the
first word's followers, the word's share of all tokens, and one over the number of distinct tokens
and one more.  The mixture's weights depend on a bucket of the first word's frequency (powers of
two) and are learned by expectation-maximisation: a tenth of the training documents is deleted from
the counts, and its pairs, by bucket and by the two maximum-likelihood estimates of the others, are
what the weights are fitted to.  Scores then use the counts of all training documents.

Documents are read once, in chunks of about CHUNK tokens, and written as numbers of words; the
deleted ones have chunks of their own, as the fit reads those alone.  Each chunk asks for its distinct words and pairs, 64 bits each (XXH64 of words, a mix of two for a
pair), sorted and cut by key into parts that grow in number with the corpus; a part adds up what the
chunks have counted and answers each chunk in the order that it asked.  So a word or pair that all
documents have is one entry for each chunk, no task holds more than a part or a chunk, and the driver gets only
sums and a table of (bucket, estimates) whose size has a fixed bound.

Defined cases: a null or empty text is its end token alone; a null doc_id is a training document;
repeated rows count and are scored each; without training documents every count is 0 and the
weights are those that the fit starts from; an empty table gives no rows; very long texts are
chunks of their own; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import Block, Scratch, blocks, mix, small_batches

#: Tokens of a chunk, and entries of a part.
CHUNK, PART = 1 << 20, 1 << 21
MODULUS, HELD = 7, 2
#: One in so many training documents is what the weights are learned from.
DELETED = 10
#: Buckets of a first word's frequency: 0, then powers of two.
BUCKETS = 42
#: Estimates are told apart by so many steps an octave, down to 2^-STEPS_DOWN.
STEPS, STEPS_DOWN = 4, 60
ROUNDS, LEAST = 50, 1e-6

_U = np.uint64
#: The word that ends a text; it is also what stands before the first word.  No hash of a word is fixed to it.
END = _U(0x5EED_E4D0_0F7E_4715)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNKS = "chunk long, deleted boolean, tokens long, train_tokens long, kept_tokens long, docs binary, words binary, ids binary"

CHUNK_COLUMNS = [c.split()[0] for c in CHUNKS.split(", ")]


def held_out() -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS == HELD, F.lit(False))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each byte of a number with its like."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(a) for a in arrays], dtype=np.int64).tobytes(), *planes]))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, dtype=np.int64, count=len(kinds)), map(np.dtype, kinds), strict=True):
        size = int(n) * kind.itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, int(n)).T).view(kind).reshape(-1) if n else np.zeros(0, dtype=kind))
        at += size
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as their differences, which are smaller."""
    return np.diff(keys, prepend=keys.dtype.type(0))


class Words:
    """Numbers for the words of a chunk, and each word's 64 bits; number 0 is the end."""

    def __init__(self):
        self.ids: list[int] = [int(END)]
        self.known: dict[bytes, int] = {}

    def numbers(self, b: Block) -> np.ndarray:
        """The numbers of a block's words."""
        data = b.buf[b.inside]
        edges = np.zeros(len(b.start) + 1, dtype=np.int64)
        np.cumsum(b.end - b.start, out=edges[1:])
        coded = pa.Array.from_buffers(pa.large_binary(), len(b.start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        own = np.empty(len(coded.dictionary), dtype=np.uint32)
        for k, w in enumerate(coded.dictionary.to_pylist()):
            n = self.known.get(w)
            if n is None:
                n = self.known[w] = len(self.ids)
                self.ids.append(xxhash.xxh64_intdigest(w))
            own[k] = n
        return own[coded.indices.to_numpy()] if len(own) else np.zeros(0, dtype=np.uint32)


class Chunk:
    """Documents as numbers of words.

    Kind 0 is held out, 1 counts, 2 is deleted from the counts that weights are learned by; 4 more
    means that the name is null.
    """

    def __init__(self, names: np.ndarray, kinds: np.ndarray, sizes: np.ndarray, words: np.ndarray, ids: np.ndarray):
        self.names, self.kinds, self.sizes, self.words, self.ids = names, kinds, sizes, words, ids

    @classmethod
    def read(cls, docs: bytes, words: bytes, ids: bytes) -> Chunk:
        return cls(*unpack(docs, "int64", "uint8", "int64"), *unpack(words, "uint32"), *unpack(ids, "uint64"))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words and pairs in the order of their 64 bits; for each token its word's and its pair's place, and what stands before it."""
        before = np.zeros(len(self.words), dtype=np.uint32)
        before[1:] = self.words[:-1]  # the end of the text before it, at the first word
        unigrams, place = np.unique(self.ids, return_inverse=True)
        pairs = mix(self.ids[before] * _U(0x9E3779B97F4A7C15) + (self.ids[self.words] ^ (self.ids[self.words] >> _U(29))) * _U(0xC2B2AE3D27D4EB4F) + _U(1))
        bigrams, paired = np.unique(pairs, return_inverse=True)
        return unigrams, bigrams, place[self.words], paired, place[before]

    def token_kinds(self) -> np.ndarray:
        return np.repeat(self.kinds & 3, self.sizes)


class _Open:
    """A chunk that is being filled."""

    def __init__(self):
        self.held: list[tuple] = []
        self.words, self.size = Words(), 0

    def add(self, part: pa.RecordBatch) -> Iterator[None]:
        """Takes the documents of a batch; stops after each block."""
        for at, b in blocks(part.column("text")):
            b.buf = _LOWER[b.buf]
            numbers, n = self.words.numbers(b), np.diff(b.words)
            own = np.insert(numbers, b.words[1:], 0)  # the end of each text
            rows = slice(at, at + len(n))
            self.held.append((part.column("name").to_numpy()[rows], part.column("kind").to_numpy()[rows].astype(np.uint8), n + 1, own))
            self.size += len(own)
            yield

    def whole(self, number: int, deleted: bool) -> pa.RecordBatch:
        names, kinds, sizes, numbers = (np.concatenate([h[i] for h in self.held]) for i in range(4))
        row = [[number], [deleted], [len(numbers)], [int(sizes[kinds & 3 > 0].sum())], [int(sizes[kinds & 3 == 1].sum())], [pack(names, kinds, sizes)], [pack(numbers)], [pack(np.array(self.words.ids, dtype=_U))]]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.binary()] * 3], strict=True)], CHUNK_COLUMNS)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """docs (name, kind, text) as chunks; deleted documents have chunks of their own."""
    number = TaskContext.get().partitionId() << 32
    open_ = {True: _Open(), False: _Open()}
    for batch in batches:
        gone = pa.array((batch.column("kind").to_numpy() & 3) == 2)
        for deleted, own in open_.items():
            for _ in own.add(batch.filter(gone if deleted else pc.invert(gone))):
                if own.size >= CHUNK:
                    yield own.whole(number, deleted)
                    number += 1
    for deleted, own in open_.items():
        if own.held:
            yield own.whole(number, deleted)
            number += 1


def _asked(parts: int):
    """What each chunk asks of each part: its words and pairs there, and what it counted of them itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk.read(row["docs"], row["words"], row["ids"])
                unigrams, bigrams, word, pair, _ = c.keys()
                kinds = c.token_kinds()
                out = []
                for keys, place in ((unigrams, word), (bigrams, pair)):
                    trained = np.bincount(place[kinds > 0], minlength=len(keys)).astype(np.uint32)
                    kept = np.bincount(place[kinds == 1], minlength=len(keys)).astype(np.uint32)
                    out.append((keys, trained, kept, np.searchsorted(keys, _edges(parts))))
                for p in range(parts):
                    cut = [[a[e[p] : e[p + 1]] for a in (k, t, u)] for k, t, u, e in out]
                    if len(cut[0][0]) or len(cut[1][0]):
                        yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "chunk": pa.array([row["chunk"]], pa.int64()), "asked": pa.array([pack(*(x for k, *counts in cut for x in (_steps(k), *counts)))], pa.binary())})

    return run


def _edges(parts: int) -> np.ndarray:
    """The first key of each part, and past the last."""
    return np.array([-(-(p << 64) // parts) for p in range(parts)] + [(1 << 64) - 1], dtype=_U)


def _answers(group: pa.Table) -> pa.Table:
    """The sums of a part for each chunk, in the order that it asked; in one row also how many words were trained on."""
    asked = [unpack(x, *("uint64", "uint32", "uint32") * 2) for x in group.column("asked").to_pylist()]
    for a in asked:
        a[0], a[3] = np.cumsum(a[0]), np.cumsum(a[3])
    sums: list[list] = [[] for _ in asked]
    distinct = 0
    for j in (0, 3):
        keys, place = np.unique(np.concatenate([a[j] for a in asked]), return_inverse=True)
        edges = np.cumsum([0, *(len(a[j]) for a in asked)])
        for of in (1, 2):
            total = np.bincount(place, weights=np.concatenate([a[j + of] for a in asked]), minlength=len(keys))
            distinct += int((total > 0).sum()) if (j, of) == (0, 1) else 0
            for i, s in enumerate(sums):
                s.append(total[place[edges[i] : edges[i + 1]]].astype(np.int64))
    n = len(asked)
    return pa.table({"chunk": group.column("chunk"), "part": group.column("part"), "distinct": pa.array([distinct] + [0] * (n - 1), pa.int64()), "sums": pa.array([pack(*s) for s in sums], pa.binary())})


def _together(answers: pa.Table) -> list[np.ndarray]:
    """A chunk's answers in the order of its keys: words in all and kept, pairs in all and kept."""
    rows = sorted({r["part"]: r["sums"] for r in answers.to_pylist()}.items())
    cut = [unpack(s, *("int64",) * 4) for _, s in rows]
    return [np.concatenate([c[i] for c in cut]) if cut else np.zeros(0, dtype=np.int64) for i in range(4)]


def bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def step(p: np.ndarray) -> np.ndarray:
    """An estimate's place on the scale of halved octaves; -1 for 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-np.log2(np.maximum(p, 1e-300)) * STEPS), STEPS_DOWN * STEPS), -1).astype(np.int64)


def _deleted(tokens: int):
    """For the deleted documents' tokens: how many have which bucket and estimates by the kept ones."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            c = Chunk.read(row["docs"], row["words"], row["ids"])
            at = np.flatnonzero(c.token_kinds() == 2)
            _, _, word, pair, before = c.keys()
            _, words, _, pairs = _together(answers)
            first = words[before[at]]
            cells = np.stack([bucket(first), step(pairs[pair[at]] / np.maximum(first, 1)), step(words[word[at]] / max(tokens, 1))], axis=1)
            if len(cells):
                got, n = np.unique(cells, axis=0, return_counts=True)
                out.append(pa.table({"bucket": got[:, 0], "two": got[:, 1], "one": got[:, 2], "n": n.astype(np.int64)}))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], pa.int64()) for k in ("bucket", "two", "one", "n")})

    return run


def learn(cells: np.ndarray, unseen: float) -> np.ndarray:
    """Weights (bucket; pair, word, neither) by expectation-maximisation over rows (bucket, two, one, n).

    A bucket starts from equal weights and from one token for each, so one without tokens keeps
    them; a first word that was never seen has no weight for pairs.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    if not len(cells):
        return weights
    scale = lambda s: np.where(s < 0, 0.0, 2.0 ** (-s / STEPS))
    estimates = np.stack([scale(cells[:, 1]), scale(cells[:, 2]), np.full(len(cells), unseen)], axis=1)
    for _ in range(ROUNDS):
        share = weights[cells[:, 0]] * estimates
        share *= (cells[:, 3] / share.sum(axis=1))[:, None]
        sums = np.ones((BUCKETS, 3))
        sums[0, 0] = 0
        np.add.at(sums, cells[:, 0], share)
        weights = sums / sums.sum(axis=1, keepdims=True)
    weights = np.maximum(weights, LEAST)
    weights[0, 0] = 0
    return weights / weights.sum(axis=1, keepdims=True)


def _scored(weights: np.ndarray, tokens: int, distinct: int):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            c = Chunk.read(row["docs"], row["words"], row["ids"])
            _, _, word, pair, before = c.keys()
            words, _, pairs, _ = _together(answers)
            own, first = words[word], words[before]
            mixed = weights[bucket(first)] * np.stack([pairs[pair] / np.maximum(first, 1), own / max(tokens, 1), np.full(len(own), 1 / (distinct + 1))], axis=1)
            edges = np.concatenate([[0], np.cumsum(c.sizes)])[:-1]
            per_doc = lambda x: np.add.reduceat(x, edges) if len(edges) else x
            null = (c.kinds & 4) > 0
            out.append(pa.table({"doc_id": pa.array(c.names, mask=null), "held_out": (c.kinds & 3) == 0, "n_tokens": c.sizes, "n_known": per_doc((own > 0).astype(np.int64)), "base_score": per_doc(np.log10((own + 1) / (tokens + distinct + 1))), "score": per_doc(np.log10(mixed.sum(axis=1)))}))
        return pa.concat_tables(out)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """doc_id (an integer), held_out, n_tokens, n_known, train_tokens, base_score and score, the log10 probability of the text and its end."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lm")
    name = F.col("doc_id").cast("long")
    kind = F.when(held_out(), 0).when(F.pmod(F.xxhash64(name), F.lit(DELETED)) == 0, 2).otherwise(1) + F.when(name.isNull(), 4).otherwise(0)
    plain = docs.select(F.coalesce(name, F.lit(0)).cast("long").alias("name"), kind.cast("int").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = scratch.table(plain.mapInArrow(_chunks, CHUNKS), "chunks")
    total, tokens, kept = (x or 0 for x in chunks.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("kept_tokens")).first())
    parts = max(1, math.ceil(total / PART))
    asked = chunks.mapInArrow(_asked(parts), "part int, chunk long, asked binary")
    answers = scratch.table(asked.groupBy("part").applyInArrow(_answers, "chunk long, part int, distinct long, sums binary"), "answers")
    distinct = answers.agg(F.sum("distinct")).first()[0] or 0
    told = answers.select("chunk", "part", "sums")
    states = chunks.select("chunk", "docs", "words", "ids")
    few = chunks.where("deleted").select("chunk", "docs", "words", "ids")
    asked_by = told.join(few.select("chunk"), "chunk", "left_semi")
    cells = few.groupBy("chunk").cogroup(asked_by.groupBy("chunk")).applyInArrow(_deleted(kept), "bucket long, two long, one long, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    rows = np.array([tuple(r) for r in cells.collect()], dtype=np.int64).reshape(-1, 4)  # BUCKETS * (STEPS * STEPS_DOWN + 2) ** 2 rows at most
    weights = learn(rows[np.lexsort(rows.T[::-1])], 1 / (distinct + 1))
    out = states.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scored(weights, tokens, distinct), SCORED)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
