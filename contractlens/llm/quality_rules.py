"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document.  The ledger stores the measurements and one
bitmask, bit i being set if rule i fails.  Policies are versioned sets of rules, applied to the
stored mask without reading a text again, and ablations are sums over masks.

Words and lines are compared by their bytes, as numbers that a dictionary gives them; a hash only
proposes windows that may be equal, and their words are compared then.

Defined cases: a null or empty text has no words and fails ``few_words``; a null doc_id stays
null; repeated rows each get a row; an empty table gives an empty ledger; extra columns are
ignored by :func:`ledger` and kept by :func:`keep_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import Block, blocks, codes, grams, mix, small_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_same_next")
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named condition over the measurements under which a document fails."""

    name: str
    fails: Column


def rules() -> list[Rule]:
    """The rules in the order of their bits; new ones go to the end, so that old masks stay valid."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < 20),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 30 * c("n_words")),
        Rule("symbols", 100 * c("n_symbols") > 50 * c("n_words")),
        Rule("repeated_lines", (c("n_dup_lines") >= 3) & (100 * c("n_dup_lines") > 30 * c("n_lines"))),
        Rule("capitals", (c("n_letters") >= 40) & (100 * c("n_capitals") > 60 * c("n_letters"))),
        Rule("word_length", (c("n_words") > 0) & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 25 * c("n_words")))),
        Rule("stutter", (c("n_words") >= 20) & (100 * c("n_same_next") > 30 * c("n_words"))),
    ]


BASE = ("few_words", "repeated_windows")
#: Policy versions: the names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "repeated_lines", "capitals", "word_length", "stutter"),
}
CURRENT = "v2"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True


def _repeats(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """For each key, whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def _twice(words: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the windows that start at ``at`` whose words make another window of the same document too."""
    key = grams(mix(words.astype(np.uint64) + np.uint64(1)), WINDOW)[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(1))
    at = at[_repeats(key)]
    if not len(at):
        return at
    columns = [owner[at], *(words[at + j] for j in range(WINDOW))]
    order = np.lexsort(columns)
    same = np.ones(len(at) - 1, dtype=bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    out = np.zeros(len(at), dtype=bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return at[out]


def measure(b: Block) -> dict[str, np.ndarray]:
    """The measurements of the documents of a block, as arrays."""
    docs = len(b.docs) - 1
    n_words = np.diff(b.words)
    owner = np.repeat(np.arange(docs), n_words)

    words = b.word_codes()
    covered = np.zeros(len(words), dtype=bool)
    if len(words) >= WINDOW:
        first = _twice(words, owner, np.flatnonzero(owner[: len(words) - WINDOW + 1] == owner[WINDOW - 1 :]))
        step = np.zeros(len(words) + 1, dtype=np.int64)
        step[first] += 1
        step[first + WINDOW] -= 1
        covered = np.cumsum(step[:-1]) > 0
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])

    breaks = np.flatnonzero(b.buf == 10)
    line_start = np.union1d(b.docs[:-1], breaks + 1)  # may hold the start of the next document's first line; that is one line
    line_start = line_start[line_start < len(b.buf)]
    line_end = np.append(line_start[1:], len(b.buf)) if len(line_start) else line_start
    line_doc = np.searchsorted(b.docs, line_start, side="right") - 1
    line_end = np.where((line_end > line_start) & (b.buf[line_end - 1] == 10), line_end - 1, line_end) if len(line_start) else line_end
    filled = np.searchsorted(b.start, line_end) > np.searchsorted(b.start, line_start) if len(line_start) else np.zeros(0, bool)
    line_start, line_end, line_doc = line_start[filled], line_end[filled], line_doc[filled]
    step = np.zeros(len(b.buf) + 1, dtype=np.int8)
    step[line_start] += 1
    step[line_end] -= 1  # a line ends before the next starts, but for the last of a document
    lines = codes(b.buf[np.cumsum(step[:-1]) > 0], line_end - line_start)
    twice = _later(lines * docs + line_doc)

    return {
        "n_words": n_words,
        "word_chars": b.per_doc(b.inside & ((b.buf & 0xC0) != 0x80), b.docs),
        "n_symbols": b.per_doc(_SYMBOL[b.buf], b.docs),
        "n_dup_lines": np.bincount(line_doc[twice], minlength=docs)[:docs],
        "n_repeat_words": b.per_doc(covered, b.words),
        "n_lines": np.bincount(line_doc, minlength=docs)[:docs],
        "n_letters": b.per_doc(_LETTER[b.buf], b.docs),
        "n_capitals": b.per_doc(_CAPITAL[b.buf], b.docs),
        "n_same_next": b.per_doc(same, b.words),
    }


def _measured(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, b in blocks(batch.column("text")):
                got, n = measure(b), len(b.docs) - 1
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array(got[k].astype(np.int64)) for k in MEASURES)], [*keep, *MEASURES])

    return run


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, the measurements (long) and ``failures``, the bitmask (long)."""
    small_batches(docs.sparkSession)
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), *(f"{m} long" for m in MEASURES)])
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    bits = [F.when(F.coalesce(r.fails, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules())]
    return source.mapInArrow(_measured(list(keep)), schema).withColumn("failures", sum(bits[1:], bits[0]).cast("long"))


def policy_mask(version: str = CURRENT) -> int:
    names = [r.name for r in rules()]
    return sum(1 << names.index(x) for x in POLICIES[version])


def passes(version: str = CURRENT) -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(version))) == 0


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy without it keeps."""
    mask = policy_mask(version)
    names = [(i, r.name) for i, r in enumerate(rules()) if mask >> i & 1]
    hit = F.col("failures").bitwiseAND(F.lit(mask))
    sums = book.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(hit.bitwiseAND(F.lit(1 << i)) != 0).alias(f"f{i}") for i, _ in names),
        *(F.count_if(hit == F.lit(1 << i)).alias(f"o{i}") for i, _ in names),
        *(F.count_if(hit.bitwiseAND(F.lit(mask & ~(1 << i))) == 0).alias(f"k{i}") for i, _ in names),
    )
    rows = F.array(*(F.struct(F.lit(i).alias("bit"), F.lit(n).alias("rule"), F.col(f"f{i}").alias("failed"), F.col(f"o{i}").alias("failed_alone"), F.col(f"k{i}").alias("kept_without"), F.col("n").alias("documents")) for i, n in names))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def keep_documents(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of docs that pass a policy, with all their columns."""
    columns = list(docs.columns)
    unclashed = [f"c{i}_" for i in range(len(columns))]
    plain = docs.toDF(*unclashed).withColumn("text", F.col(unclashed[columns.index("text")]))
    return ledger(plain, tuple(unclashed)).where(passes(version)).select(*unclashed).toDF(*columns)
