"""Removal of passages that recur, by recurring-phrase automata.

A window is 35 consecutive words.  A word goes if a window that covers it has the same words as a
window that starts anywhere else.

1. Anchors: of the 8-word hashes in a window the least is its anchor, so equal windows have equal
   anchors, and a text has about one anchor for every fourteen windows.  Only anchors are
   shuffled; those that occur once are out, and with them their windows.  Exact copies of a text
   are one text here, and all their words go if they have a window at all.
2. Confirming: a run of windows with one recurring anchor is a segment.  Equal segments are
   counted together before they are shuffled by anchor, so that all windows that could be equal
   meet in one shard, and a common passage is one row a task.
3. Automata: a shard counts the windows of its segments word by word, compiles those found twice
   or more into an Aho-Corasick automaton, and streams its segments through it.
4. An anchor that occurs over ANCHOR_PLACES times (a few common words in many surroundings) would
   make a shard without a bound.  Its windows are dealt out by their own identity instead: summed
   before they are shuffled, and those found twice or more joined back to their segments.
5. The spans found are joined back to every place of their segment and cut out of the texts.

Words are compared as they are, in the automaton; hashes of 64 bits only choose what is compared,
and texts, segments and the windows of frequent anchors have identities of 128 bits.

Defined cases: a null or empty text has no words and keeps none; a null doc_id stays null;
repeated rows are copies of one another, so their windows recur; different texts under one doc_id,
or without one, are different texts; an empty table gives an empty result; extra columns are ignored by :func:`repeated_words` and kept by :func:`strip_documents`.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import Block, Scratch, blocks, grams, small_batches

WINDOW = 35
GRAM = 8
#: Segments that one automaton is compiled for, about.
SHARD_SEGMENTS = 4000
#: Places of an anchor up to which its segments go to one shard; beyond, windows are dealt out.
ANCHOR_PLACES = 256
#: Segments whose counts a task holds before it passes them on.
HELD_SEGMENTS = 60_000
#: Distinct words that can each be a character of a string; beyond, windows are sequences of numbers.
LETTERS = 1_000_000
_U = np.uint64


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of so many consecutive values."""
    have, span = x, 1
    while 2 * span <= width:
        have, span = op(have[:-span], have[span:]), 2 * span
    rest = width - span
    return op(have[: len(have) - rest], have[rest:]) if rest else have


class Anchors:
    """The gram hashes of a block, and the anchor of every window that lies in one document."""

    def __init__(self, b: Block, window: int):
        owner = np.repeat(np.arange(len(b.docs) - 1), np.diff(b.words))
        self.window, span = window, window - GRAM + 1
        self.grams = grams(b.word_hashes(), GRAM)
        n = max(0, len(owner) - window + 1)
        self.whole = owner[:n] == owner[window - 1 :] if n else np.zeros(0, bool)
        self.owner = owner
        self.least = _slide(self.grams, span, np.minimum) if n else np.zeros(0, _U)
        self.span = span

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of every place whose hash is a window's anchor."""
        if not len(self.least):
            return np.zeros(0, np.int64), np.zeros(0, _U)
        of = np.where(self.whole, self.least, _U(0))
        edge = np.zeros(self.span - 1, _U)
        most = _slide(np.concatenate([edge, of, edge]), self.span, np.maximum)  # over the windows that hold a place
        at = np.flatnonzero((most == self.grams) & (most > 0))
        return self.owner[at], self.grams[at]


def _texts(window: int):
    names = ["doc_id", "h", "n_words", "all_sha256", "anchors", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, b in blocks(batch.column("text")):
                docs = len(b.docs) - 1
                joined = [b.joined(d) for d in range(docs)]
                doc, value = Anchors(b, window).chosen()
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                first = np.ones(len(doc), dtype=bool)
                first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
                times = np.diff(np.flatnonzero(np.append(first, True)))
                doc, value = doc[first], value[first]
                offsets = np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, docs),
                        pa.array([xxhash.xxh3_128_digest(j) for j in joined], pa.binary()),
                        pa.array(np.diff(b.words).astype(np.int64)),
                        pa.array([hashlib.sha256(j).hexdigest() for j in joined], pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int64))),
                    ],
                    names,
                )

    return run


_SEGMENT_SCHEMA = "h binary, starts array<int>, sids array<binary>, anchor long, sid binary, segment binary, windows array<binary>, n long"


def _segments(window: int):
    """Rows of three kinds: the places of a text's segments, and segments with their number in this task.

    Segments have their words, or the identities of their windows if their anchor is a frequent one.
    """
    names = [x.split()[0] for x in _SEGMENT_SCHEMA.split(", ")]
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64()]

    def rows(*columns) -> pa.RecordBatch:
        n = max(len(c) for c in columns)
        return pa.RecordBatch.from_arrays([pa.array(c if len(c) else [None] * n, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def flush():
            items = list(held.items())
            for i in range(0, len(items), 2000):
                part = items[i : i + 2000]
                yield rows([], [], [], [v[0] for _, v in part], [k for k, _ in part], [v[1] for _, v in part], [v[2] and [v[2][j : j + 16] for j in range(0, len(v[2]), 16)] for _, v in part], [v[3] for _, v in part])
            held.clear()

        for batch in batches:
            hs, wanted, frequent = batch.column("h").to_pylist(), batch.column("anchors"), batch.column("frequent")
            for at, b in blocks(batch.column("text")):
                a = Anchors(b, window)
                out_h, out_starts, out_sids = [], [], []
                for d in range(len(b.docs) - 1):
                    first, last = int(b.words[d]), int(b.words[d + 1]) - window
                    if last < first:
                        continue
                    joined = b.joined(d)
                    least = a.least[first : last + 1]
                    recurs = np.isin(least, wanted[at + d].values.to_numpy().view(_U))
                    run_start = np.flatnonzero(recurs & np.concatenate([[True], (least[1:] != least[:-1]) | ~recurs[:-1]]))
                    run_end = np.flatnonzero(recurs & np.concatenate([(least[1:] != least[:-1]) | ~recurs[1:], [True]]))
                    sizes = b.end[first : last + window] - b.start[first : last + window]
                    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
                    often = np.isin(least[run_start], frequent[at + d].values.to_numpy().view(_U)).tolist()
                    starts, sids = [], []
                    for s, e, split in zip(run_start.tolist(), run_end.tolist(), often, strict=True):
                        segment = joined[begin[s] : begin[e + window] - 1]
                        sid = xxhash.xxh3_128_digest(segment)
                        starts.append(s)
                        sids.append(sid)
                        if sid in held:
                            held[sid][3] += 1
                        elif split:
                            held[sid] = [None, None, b"".join([xxhash.xxh3_128_digest(joined[begin[i] : begin[i + window] - 1]) for i in range(s, e + 1)]), 1]
                        else:
                            held[sid] = [int(least[s : s + 1].view(np.int64)[0]), segment, None, 1]
                    if starts:
                        out_h.append(hs[at + d])
                        out_starts.append(starts)
                        out_sids.append(sids)
                if out_h:
                    yield rows(out_h, out_starts, out_sids, [], [], [], [], [])
                if len(held) > HELD_SEGMENTS:
                    yield from flush()
        yield from flush()

    return run


def locate(segments: list[tuple[bytes, bytes, int]], window: int) -> Iterator[tuple[bytes, list[int]]]:
    """(sid, flat word spans) of segments given as (sid, text, number): what recurring windows cover.

    Each word stands for one character, so a window is a string of so many characters.
    """
    import ahocorasick

    letters: dict[bytes, int] = {}
    texts: dict[bytes, list] = {}  # its words as letters, and how often it is there
    for sid, segment, n in segments:
        if sid in texts:
            texts[sid][1] += n
        else:
            texts[sid] = [[letters.setdefault(w, len(letters) + 1) for w in segment.split(b" ")], n]
    if len(letters) <= LETTERS:
        for t in texts.values():
            t[0] = "".join([chr(i if i < 0xD800 else i + 0x800) for i in t[0]])
        automaton = ahocorasick.Automaton()
    else:
        for t in texts.values():
            t[0] = tuple(t[0])
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    found: Counter = Counter()
    for text, n in texts.values():
        for i in range(len(text) - window + 1):
            found[text[i : i + window]] += n
    for phrase, n in found.items():
        if n > 1:
            automaton.add_word(phrase, 0)
    found.clear()
    if not len(automaton):
        return
    automaton.make_automaton()
    for sid, (text, _) in texts.items():
        spans: list[int] = []
        for last, _ in automaton.iter(text):
            start = last + 1 - window
            if spans and start <= spans[-1]:
                spans[-1] = last + 1
            else:
                spans += [start, last + 1]
        if spans:
            yield sid, spans


def _located(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int]] = []
        last = None

        def flush():
            out = list(locate(held, window))
            held.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.binary()), pa.array([x for _, x in out], pa.list_(pa.int32()))], ["sid", "spans"])

        for batch in batches:
            for anchor, sid, segment, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if anchor != last and len(held) >= SHARD_SEGMENTS:  # all segments of an anchor stay together
                    yield from flush()
                last = anchor
                held.append((sid, segment, n))
        if held:
            yield from flush()

    return run


def _cut(with_text: bool):
    names = ["h", "n_removed", "kept_sha256", "kept_text"][: 3 + with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                step = np.zeros(len(words) + 1, dtype=np.int64)
                for part in spans:
                    own = np.array(part["spans"], dtype=np.int64) + part["start"]
                    np.add.at(step, own[0::2], 1)
                    np.add.at(step, own[1::2], -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            columns = [batch.column("h"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns[: 3 + with_text], names)

    return run


def _changes(docs: DataFrame, window: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """(every row's doc_id, h, n_words, all_sha256; changed texts by h, with copies > 1 where all words go)."""
    if window < 2 * GRAM:
        raise ValueError(f"a window needs {2 * GRAM} words or more")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "substrings")
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text")
    rows = scratch.table(source.mapInArrow(_texts(window), f"doc_id {kind}, h binary, n_words long, all_sha256 string, anchors array<long>, times array<long>"), "rows")
    long = rows.where(F.col("n_words") >= window)
    texts = scratch.table(long.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.first("anchors").alias("anchors"), F.first("times").alias("times")), "texts")

    # written, as other right sides of joins below: Spark splits large partitions of plain shuffles only
    placed = texts.select("h", F.explode(F.arrays_zip("anchors", "times")).alias("a")).select("h", F.col("a.anchors").alias("anchor"), F.col("a.times").alias("times"))
    summed = placed.groupBy("anchor").agg(F.sum("times").alias("places")).where("places > 1")
    recurring = scratch.table(summed.select("anchor", (F.col("places") > ANCHOR_PLACES).alias("often")), "recurring")
    held = placed.select("h", "anchor").join(recurring, "anchor")
    listed = held.groupBy("h").agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("often"), F.col("anchor"))).alias("frequent"))
    wanted = listed.join(texts.select("h", "first_id"), "h")
    # a text is found again by its digest; the doc_id beside it keeps copies under other ids apart
    named = source.withColumn("text_", F.col("text")).mapInArrow(_hashed(["doc_id", "text"]), f"doc_id {kind}, text string, h_ binary")
    same = (F.col("h_") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    some = scratch.table(named.join(wanted.hint("shuffle_hash"), same).select("h", "text", "anchors", "frequent"), "some")

    found = scratch.table(some.mapInArrow(_segments(window), _SEGMENT_SCHEMA), "segments")
    shards = found.where("anchor is not null").select("anchor", "sid", "segment", "n").repartition("anchor").sortWithinPartitions("anchor")
    spans = scratch.table(shards.mapInArrow(_located(window), "sid binary, spans array<int>"), "spans")
    windows = found.where("windows is not null").select("sid", "n", F.posexplode("windows").alias("at", "window"))
    twice = scratch.table(windows.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"), "twice")
    covered = windows.select("sid", "at", "window").join(twice, "window").groupBy("sid").agg(F.collect_set("at").alias("at"))  # windows of one segment
    split = scratch.table(covered.select("sid", F.flatten(F.transform("at", lambda i: F.array(i, i + window))).alias("spans")), "split")
    spans = spans.unionByName(split)
    places = found.where("h is not null").select("h", F.explode(F.arrays_zip("starts", "sids")).alias("p")).select("h", F.col("p.starts").alias("start"), F.col("p.sids").alias("sid"))
    hit = places.distinct().join(spans, "sid").groupBy("h").agg(F.collect_list(F.struct("start", "spans")).alias("spans"))
    schema = "h binary, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    cut = some.select("h", "text").join(hit.hint("shuffle_hash"), "h").mapInArrow(_cut(with_text), schema).dropDuplicates(["h"])
    changed = scratch.table(texts.select("h", "copies").join(cut, "h", "left").where("copies > 1 or n_removed is not null"), "changed")
    for name in ("texts", "recurring", "some", "segments", "spans", "twice", "split"):
        scratch.drop(name)
    return rows.select("doc_id", "h", "n_words", "all_sha256"), changed


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    rows, changed = _changes(docs, window, False)
    whole = F.col("copies") > 1
    return rows.join(changed, "h", "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )


def _hashed(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index("text_")).to_pylist()
            h = [xxhash.xxh3_128_digest(b" ".join((t or "").encode().split())) for t in text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(h, pa.binary())], [*columns, "h_"])

    return run


def strip_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with recurring passages cut out of ``text``, and ``n_chars``, if there is one, made to fit.

    A text that loses words is its kept words joined by one space, maybe none; others stay as they are.
    """
    _, changed = _changes(docs, window, True)
    changed = changed.select(F.col("h").alias("h_"), F.when(F.col("copies") > 1, F.lit("")).otherwise(F.col("kept_text")).alias("kept_"))
    columns = [f"c{i}_" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    text = columns[docs.columns.index("text")]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema, strict=True))
    hashed = plain.withColumn("text_", F.col(text)).mapInArrow(_hashed(columns), f"{schema}, h_ binary")
    joined = hashed.join(changed.hint("shuffle_hash"), "h_", "left").withColumn(text, F.coalesce("kept_", text))
    if "n_chars" in docs.columns:
        size = columns[docs.columns.index("n_chars")]
        joined = joined.withColumn(size, F.when(F.col("kept_").isNull(), F.col(size)).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return joined.select(*columns).toDF(*docs.columns)
