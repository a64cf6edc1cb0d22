"""Shared pieces: bounded batches, and vectorised scanning of Arrow text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from contractlens.functions.scratch import Scratch  # noqa: F401  for the operators

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
BLOCK_BYTES = 1 << 20
#: Rows and bytes in an Arrow batch: bound what a Python worker holds, however long the texts are.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: ASCII white space: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that the session sends to Python workers, where it has Spark's own bounds.

    Frames are returned before they run, so the bounds can't be taken back; a session's own stay.
    """
    for key, usual, value in (("maxRecordsPerBatch", 10_000, BATCH_ROWS), ("maxBytesPerBatch", 64 << 20, BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b") == str(usual):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        if n > 4 * BLOCK_BYTES:  # one long document: don't keep it
            return _accumulate(base, n)
        have = _powers[kind] = _accumulate(base, max(n, BLOCK_BYTES + 1))
    return have[:n]


def _accumulate(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Block:
    """Words of some documents, as arrays over one buffer.

    ``buf`` holds the UTF-8 bytes; document d is ``buf[docs[d]:docs[d + 1]]`` and its words are
    number ``words[d]`` to ``words[d + 1]``, word w being ``buf[start[w]:end[w]]``.
    """

    def __init__(self, buf: np.ndarray, docs: np.ndarray):
        self.buf, self.docs = buf, docs
        self.inside = ~SPACE[buf]
        n = len(buf)
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        if n:
            before[1:] = self.inside[:-1]
            after[:-1] = self.inside[1:]
            before[docs[docs < n]] = False
            after[docs[docs > 0] - 1] = False
        self.start = np.flatnonzero(self.inside & ~before)
        self.end = np.flatnonzero(self.inside & ~after) + 1
        self.words = np.searchsorted(self.start, docs)
        self._sums = None

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span: a polynomial over its bytes, mixed."""
        n = len(self.buf)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=_U)
            np.cumsum((self.buf.astype(_U) + _U(1)) * _power("up", _BASE, max(n, 1))[:n], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * _power("down", _BASE_INV, n + 1)[start] + (end - start).astype(_U))

    def word_hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def word_codes(self) -> np.ndarray:
        """A number for each word: equal for equal words of the block, and only for those."""
        return codes(self.buf[self.inside], self.end - self.start)

    def per_doc(self, flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Sums of flags between consecutive edges."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[edges])

    def joined(self, d: int) -> bytes:
        """The words of document d, joined by one space."""
        return b" ".join(self.buf[self.docs[d] : self.docs[d + 1]].tobytes().split())


def codes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each run of bytes of ``data``, which holds them on end: equal for equal runs, and only for those."""
    edges = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=edges[1:])
    runs = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return runs.dictionary_encode().indices.to_numpy().astype(np.int64)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive word hashes; shorter input gives none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    factors = _accumulate(_BASE, k + 1)[1:]
    out = np.zeros(n, dtype=_U)
    for j in range(k):
        out += hashes[j : j + n] * factors[j]
    return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as the empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array):
    """(first row, Block) for consecutive runs of rows of about BLOCK_BYTES."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *new.values()], [*keep, *new])
