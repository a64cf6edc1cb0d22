"""SentencePiece encoding that keeps offsets, and decoding.

A model file is read as plain protobuf fields.  Text is normalised by longest prefix through the
compiled character map (a double-array trie and a pool of replacements), each normalised byte
remembering the original byte it comes from; every piece is then projected to a span of original
bytes.  Without a map only spaces change, so the alignment is a sum of the pieces' original sizes.

Merges are made chunk by chunk: a chunk is a run of space marks and what follows up to the next
one.  That is exact where no piece holds a mark after another character, which is verified for the
model; otherwise a whole text is one chunk.  Workers cache short chunks, with a bound.

Defined cases: a null or empty text has no pieces, so its ids are the end id alone; a null doc_id
stays null; repeated rows each get a row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contractlens.llm.common import small_batches

MARK = "▁"
_MARK = MARK.encode()
#: Entries of a worker's cache of chunks, none longer than CACHED_CHARS.
CACHE = 400_000
CACHED_CHARS = 48
#: Up to so many symbols merges are searched in a list, beyond it with a heap.
SHORT = 96
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: an int, or bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


class CharMap:
    """The compiled character map: longest prefix -> replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes used, replacement) of the longest entry that data has at a place."""
        units, found = self.units, None
        node = self._children(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._children(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.pool[start : self.pool.index(b"\0", start)]

    @staticmethod
    def _children(unit: int) -> int:
        return unit >> 10 << (8 if unit & 512 else 0)


class Model:
    """Pieces and settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict[int, object] = {}
        normaliser: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if {USER_DEFINED, UNUSED} & set(self.types) or trainer.get(24):
            raise ValueError("user-defined or unused pieces, and space marks as suffixes, are not supported")
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.remove_extra = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        blob = normaliser.get(2, b"")
        self.chars = CharMap(blob) if blob else None
        self.id_of = {p: i for i, p in enumerate(self.pieces)}
        self.score_of = {p: s for p, s, t in zip(self.pieces, self.scores, self.types, strict=True) if t == NORMAL}
        self.unknown = self.types.index(UNKNOWN)
        self.end = self.id_of.get("</s>", -1)
        self.byte_ids = [self.id_of.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        #: The text of each id, None where it depends on its neighbours; an ASCII byte is a character whatever stands beside it.
        self.surface = [p.replace(MARK, " ") if t == NORMAL else "" if t == CONTROL else None for p, t in zip(self.pieces, self.types, strict=True)]
        for b in {*range(128)} - {32}:
            if self.types[self.byte_ids[b]] == BYTE:
                self.surface[self.byte_ids[b]] = chr(b)
        self.chunked = self.escape and not any(MARK in p.lstrip(MARK) for p in self.score_of)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    # -- normalising -------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the original byte offset."""
        data = text.encode()
        out, align = bytearray(), []
        space = MARK.encode() if self.escape else b" "
        at, n = 0, len(data)

        def prefix(at: int) -> tuple[int, bytes]:
            got = self.chars.longest(data, at) if self.chars else None
            if got:
                return got
            size = 1
            while at + size < n and data[at + size] & 0xC0 == 0x80:
                size += 1
            return size, data[at : at + size]

        if self.remove_extra:
            while at < n:
                used, to = prefix(at)
                if to.strip(b" "):
                    break
                at += used
        if at == n:
            return "", np.array([0] if not n else [n], dtype=np.int64)
        if self.dummy_prefix:
            out += space
            align += [at] * len(space)
        after_space = self.remove_extra
        while at < n:
            used, to = prefix(at)
            if after_space:
                to = to.lstrip(b" ")
            if to:
                whole = to.replace(b" ", space)
                out += whole
                align += [at] * len(whole)
                after_space = to.endswith(b" ")
            at += used
            if not self.remove_extra:
                after_space = False
        end = n
        if self.remove_extra:
            while out.endswith(space):
                end = align[len(out) - len(space)]
                del out[-len(space) :]
                del align[len(out) :]
        return out.decode(), np.array([*align, end], dtype=np.int64)

    # -- pieces ------------------------------------------------------------------------------

    def merge(self, chunk: str) -> list[str]:
        """Pieces of a normalised chunk: the best pair first, the leftmost of equals."""
        parts, score, none = list(chunk), self.score_of.get, float("-inf")
        if len(parts) > SHORT:
            return self._merge_long(parts)
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, score = len(parts), self.score_of.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else -1
            if j >= 0 and (s := score(parts[i] + parts[j])) is not None:
                heap.append((-s, i, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (i, left[i]):
                before = len(heap)
                offer(k)
                if len(heap) > before:
                    item = heap.pop()
                    heapq.heappush(heap, item)
        return [p for p in parts if p]

    def chunks(self, normalised: str) -> list[str]:
        if not normalised:
            return []
        return re.findall(f"^[^{MARK}]+|{MARK}+[^{MARK}]*", normalised) if self.chunked else [normalised]

    def ids(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids of a normalised chunk, and the normalised byte each of them ends at.

        The bytes of an unknown character are pieces of their own; the last of them has its whole
        span and the others are empty.
        """
        out, ends, at = [], [], 0
        for piece in self.merge(chunk):
            raw = piece.encode()
            before, at = at, at + len(raw)
            if piece in self.score_of:
                out.append(self.id_of[piece])
                ends.append(at)
            elif self.byte_fallback:
                out += [self.byte_ids[b] for b in raw]
                ends += [before] * (len(raw) - 1) + [at]
            elif out and out[-1] == self.unknown:  # a run of unknown characters is one piece
                ends[-1] = at
            else:
                out.append(self.unknown)
                ends.append(at)
        return out, ends

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of a text, and their spans of its UTF-8 bytes."""
        normalised, align = self.normalise(text)
        out, ends, at = [], [], 0
        for chunk in self.chunks(normalised):
            ids, own = self.ids(chunk)
            out += ids
            ends += [at + e for e in own]
            at += len(chunk.encode())
        stops = align[np.array(ends, dtype=np.int64)].tolist() if ends else []
        starts = align[np.array([0, *ends[:-1]], dtype=np.int64)].tolist() if ends else []
        return out, list(zip(starts, stops, strict=True))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, byte runs are UTF-8, one space of the dummy prefix goes."""
        if self.remove_extra:
            return self._decode_each(ids)
        try:
            whole = "".join(map(self.surface.__getitem__, ids))
        except TypeError:  # bytes of longer characters, or unknown pieces
            return self._decode_each(ids)
        return whole.removeprefix(" ") if self.dummy_prefix else whole

    def _decode_each(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        first = True

        def flush() -> None:
            while run:
                try:
                    out.append(run.decode())
                    run.clear()
                except UnicodeDecodeError as e:  # each byte that is no UTF-8 is one replacement character
                    out.append(run[: e.start].decode() + "�")
                    del run[: e.start + 1]

        for i in ids:
            kind, piece = self.types[i], self.pieces[i]
            if kind == BYTE:
                run.append(int(piece[3:5], 16))
                first = False
                continue
            flush()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_text)
            else:
                if first and (self.dummy_prefix or self.remove_extra) and piece.startswith(MARK):
                    piece = piece.lstrip(MARK) if self.remove_extra else piece[1:]
                out.append(piece.replace(MARK, " "))
            first = False
        flush()
        return "".join(out)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model.load(path)
    return _models[path]


class ChunkCache(dict):
    """A bounded cache of what is made of a chunk."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        value = self.make(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = value
        return value


def plain_chunks(m: Model, text: str) -> list[str] | None:
    """The chunks of a text whose normalising is a mark for each space and one before it; else None."""
    if m.chars or m.remove_extra or not (m.chunked and m.dummy_prefix) or MARK in text:
        return None
    if text and "  " not in text and text[0] != " " and text[-1] != " ":
        return [MARK + p for p in text.split(" ")]
    return m.chunks(MARK + text.replace(" ", MARK)) if text else []


def _chunk(m: Model):
    pair = struct.Struct("=ii").pack
    known = {p: (b"%d" % m.id_of[p], pair(m.id_of[p], len(p.encode()) - 2 * p.count(MARK))) for p in m.score_of}

    def make(chunk: str) -> tuple[bytes, bytes]:
        """Decimal ids; and pairs of an id and the original bytes of its piece, where each mark stands for a space."""
        try:
            decimal, pairs = zip(*[known[p] for p in m.merge(chunk)], strict=True)
        except KeyError:  # some character is unknown
            ids, ends = m.ids(chunk)
            raw = chunk.encode()
            decimal = [b"%d" % i for i in ids]
            pairs = [pair(i, b - a - 2 * raw.count(_MARK, a, b)) for i, a, b in zip(ids, [0, *ends], ends, strict=False)]
        return b" ".join(decimal), b"".join(pairs)

    return make


_chunk_caches: dict[str, ChunkCache] = {}


def encoder(path: str):
    """text -> (decimal ids, ids, starts, ends) with the end id; starts and ends are offsets of its UTF-8 bytes."""
    m = model(path)
    get = _chunk_caches.setdefault(path, ChunkCache(_chunk(m))).__getitem__
    end = b"%d" % m.end

    def encode(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        chunks, size = plain_chunks(m, text), len(text.encode())
        if chunks is None:
            own, where = m.encode(text)
            ids = np.array([*own, m.end], dtype=np.int32)
            starts, ends = np.array([*where, (size, size)], dtype=np.int32).T
            return b" ".join([b"%d" % i for i in ids.tolist()]), ids, starts, ends
        decimal, pairs = zip(*map(get, chunks), strict=True) if chunks else ((), ())
        both = np.frombuffer(b"".join(pairs), dtype=np.int32).reshape(-1, 2)
        ids = np.append(both[:, 0], np.int32(m.end))
        ends = np.empty(len(ids), dtype=np.int32)
        np.cumsum(both[:, 1], out=ends[:-1])
        ends[:-1] -= 1  # the first mark stands for no space
        ends[-1] = size
        starts = np.empty_like(ends)
        starts[0], starts[1:] = 0, ends[:-1]
        return b" ".join((*decimal, end)), ids, starts, ends

    return encode


def _lists(parts: list[np.ndarray]) -> pa.Array:
    edges = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def _encoded(path: str, more: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, encode = model(path), encoder(path)
        for batch in batches:
            got, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                joined, *rest = encode(text or "")
                got.append(rest)
                ids_sha.append(hashlib.sha256(joined).hexdigest())
                text_sha.append(hashlib.sha256(m.decode(rest[0].tolist()).encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array([len(g[0]) for g in got], pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            columns += [_lists([g[("ids", "starts", "ends").index(c)] for g in got]) for c in more]
            yield pa.RecordBatch.from_arrays(columns, names + more)

    return run


def encode_documents(docs: DataFrame, path: str, spans: bool = False, ids: bool | None = None, starts: bool | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with spans also ids, starts and ends (byte offsets).

    ids and starts can be declined; a piece starts where the one before it ends, the first at 0.
    """
    small_batches(docs.sparkSession)
    more = ["ids"] * (spans if ids is None else ids) + ["starts"] * (spans if starts is None else starts) + ["ends"] * spans
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(f"{c} array<int>" for c in more)])
    return docs.select("doc_id", "text").mapInArrow(_encoded(path, more), schema)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to the empty text."""
    small_batches(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), f"doc_id {kind}, text string")
