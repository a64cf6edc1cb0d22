"""Quality classifier on supervised subword embeddings.

A document is the mean of the vectors of its words, of the n-grams of characters (code points) of
each word within boundary marks, and of its pairs of neighbouring words.  Features are hashed into a
fixed number of buckets; a pair's hash is the exclusive or of its words' hashes, so the order of
the two does not count and all repeated words share a bucket.  A softmax over the mean gives the classes; vectors and
output weights are learned together by numpy stochastic gradient descent.

The fit uses at most MAX_DOCUMENTS labelled documents, those with the least hash of their id; they
are picked from the labels alone and then read by a broadcast of the ids, so no text is shuffled.
Of several rows under a picked id the one with the least hash of its text counts.
As the output is linear in the mean, scoring needs one number for each bucket.

Defined cases: a null or empty text has the one feature that every document has, and gets its
score; a null doc_id stays null and is never labelled; repeated rows each get a row; several
labels of one id are averaged and null ones ignored; without labels of two classes, or documents,
every score is the share of label 1 (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import small_batches

BUCKETS = 1 << 15
DIMENSIONS = 16
GRAMS = (2, 3, 4)
MAX_DOCUMENTS = 2000
EPOCHS = 6
RATE = 0.5
SEED = 7
THRESHOLD = 0.7
#: Words in a worker's cache.
CACHE = 300_000
#: The bucket of the feature of every document.
ALWAYS = 0


def word_buckets(word: bytes) -> list[int]:
    """The buckets of a word and of its n-grams of characters within boundary marks."""
    marked = b"<" + word + b">"
    crc, span = zlib.crc32, BUCKETS - 1
    out = [crc(marked, 1) % span + 1]
    if word.isascii():
        for k in GRAMS:
            out += [crc(marked[i : i + k]) % span + 1 for i in range(len(marked) - k + 1)]
        return out
    edges = [i for i, b in enumerate(marked) if b & 0xC0 != 0x80] + [len(marked)]
    for k in GRAMS:
        out += [crc(marked[a:b]) % span + 1 for a, b in zip(edges, edges[k:], strict=False)]
    return out


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """The buckets of neighbouring words, from the words' hashes."""
    return (hashes[1:] ^ hashes[:-1]) % (BUCKETS - 1) + 1


def document_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text."""
    words = text.split()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for w, n in Counter(words).items():
        np.add.at(counts, word_buckets(w), n)
    counts += np.bincount(pair_buckets(np.array(list(map(zlib.crc32, words)), dtype=np.int64)), minlength=BUCKETS)
    counts[ALWAYS] += 1
    at = np.flatnonzero(counts)
    return at, counts[at]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in batch.column("text").to_pylist():
            a, c = document_counts((text or "").encode())
            at.append(a.astype("<u2").tobytes())
            n.append(c.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("h"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["doc_id", "label", "h", "buckets", "counts"])


def held_out() -> Column:
    """Rows that labels are never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_DOCUMENTS) -> np.ndarray:
    """The logit of each bucket; label 1 is likelier where a document's mean is above zero.

    docs: doc_id, text.  labels: doc_id, label (0 or 1).  At most limit documents are used.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and label is not null").where(~held_out()).groupBy("doc_id").agg(F.avg("label").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("picked_id"), (F.col("label") >= 0.5).cast("int").alias("label"))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id")).select("doc_id", "text", "label", F.xxhash64("text").alias("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = sample.mapInArrow(_counted, f"doc_id {kind}, label int, h long, buckets binary, counts binary")
    # one row for each picked id, so no more than limit come to the driver
    rows = counted.groupBy("doc_id").agg(F.min(F.struct("h", "buckets", "counts", "label")).alias("r")).select("doc_id", "r.label", "r.buckets", "r.counts").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[2], r[3]))
    return train([(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<i8").astype(np.float64)) for _, _, b, c in rows], np.array([r[1] for r in rows], dtype=np.int64))


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """Stochastic gradient descent over (buckets, counts); returns the logit of each bucket."""
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        return np.full(BUCKETS, np.log(share / (1 - share)), dtype=np.float32)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    output = np.zeros((2, DIMENSIONS))
    shares = [(at, (c / c.sum())[:, None]) for at, c in samples]
    step, steps = 0, epochs * len(samples)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            at, share = shares[i]
            now = rate * (1 - step / steps)
            own = vectors[at]
            mean = (own * share).sum(0)
            logits = output @ mean
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = error @ output
            output -= now * error[:, None] * mean[None, :] * DIMENSIONS
            vectors[at] = own - now * DIMENSIONS * share * back[None, :]
            step += 1
    return (vectors @ (output[1] - output[0])).astype(np.float32)


class Scorer(dict):
    """Words with the sum of their features' logits, their number, and the word's hash; a bounded cache."""

    def __init__(self, logits: np.ndarray):
        super().__init__()
        self.array = logits.astype(float)
        self.logits = self.array.tolist()

    def __missing__(self, word: bytes) -> tuple[float, int, int]:
        own = word_buckets(word)
        value = sum([self.logits[b] for b in own]), len(own), zlib.crc32(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value

    def score(self, text: bytes) -> float:
        """The probability of label 1."""
        got = list(map(self.__getitem__, text.split()))
        pairs = pair_buckets(np.array([g[2] for g in got], dtype=np.int64))
        total = sum([g[0] for g in got]) + float(self.array[pairs].sum()) + self.logits[ALWAYS]
        n = sum([g[1] for g in got]) + len(pairs) + 1
        return float(1 / (1 + np.exp(-np.clip(total / n, -500, 500))))


_scorers: dict[int, Scorer] = {}


def _scored(held, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held.id not in _scorers:
            _scorers.clear()
            _scorers[held.id] = Scorer(held.value)
        s = _scorers[held.id]
        for batch in batches:
            text = batch.column(batch.schema.names.index("text_")).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array([s.score((t or "").encode()) for t in text], pa.float64())], [*names, "score_"])

    return run


class _Held:
    """A broadcast and a name for it that workers share."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def _with_score(docs: DataFrame, logits: np.ndarray) -> DataFrame:
    """docs with its columns by place (c0_, c1_, ...) and ``score_``."""
    small_batches(docs.sparkSession)
    held = _Held(docs.sparkSession.sparkContext.broadcast(logits), zlib.crc32(logits.tobytes()))
    names = [f"c{i}_" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text_", F.col(names[docs.columns.index("text")]))
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return plain.mapInArrow(_scored(held, names), f"{schema}, score_ double")


def score(docs: DataFrame, logits: np.ndarray) -> DataFrame:
    """All rows and columns of docs, with ``quality_score`` (0 to 1); where docs has a column of that name, with ``quality_score_`` and so on."""
    name, there = "quality_score", {c.lower() for c in docs.columns}
    while name in there:
        name += "_"
    return _with_score(docs, logits).toDF(*docs.columns, name)


def keep_documents(docs: DataFrame, logits: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of the threshold at least, with all their columns, whatever these are called."""
    return _with_score(docs, logits).where(F.col("score_") >= threshold).drop("score_").toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, limit))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
