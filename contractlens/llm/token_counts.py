"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary's matches at each place; the forward programme
carries the best score and its number of pieces, and no path is kept.  Of equal scores the longer
last piece wins, as the tokenizer's own search goes from left to right and only a greater score
replaces one.  A character that is no piece scores ten below the least score; a run of such
characters counts as one piece, or as one for each byte where the model falls back to bytes.

Scores are summed from the start of each chunk (space marks and what follows them) in double
precision, which is exact; the library sums from the start of the text in single precision.

Defined cases: a null or empty text has no tokens and score 0; a null doc_id stays null; repeated
rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from contractlens.llm.common import small_batches
from contractlens.llm.sentencepiece_codec import MARK, ChunkCache, Model, model, plain_chunks

PENALTY = 10.0


class Viterbi:
    """The search over one model's pieces."""

    def __init__(self, m: Model):
        import ahocorasick

        self.model = m
        self.matches = ahocorasick.Automaton()
        for piece, score in m.score_of.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(m.score_of.values()) - PENALTY

    def count(self, chunk: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a normalised text."""
        n = len(chunk)
        ending: list[list] = [[] for _ in range(n)]
        for last, match in self.matches.iter(chunk):  # of one end the longest comes first
            ending[last].append(match)
        score, pieces, strange = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, number, single = float("-inf"), 0, False
            for size, own in ending[end - 1]:
                s = score[end - size] + own
                if s > best:
                    best, number = s, pieces[end - size] + 1
                single = single or size == 1
            if not single and (s := score[end - 1] + self.unknown) > best:
                best, number = s, pieces[end - 1] + (len(chunk[end - 1].encode()) if self.model.byte_fallback else not strange[end - 1])
                strange[end] = True
            score[end], pieces[end] = best, number
        return pieces[n], score[n]


_counters: dict[str, tuple[Model, ChunkCache]] = {}


def counter(path: str) -> tuple[Model, ChunkCache]:
    if path not in _counters:
        m = model(path)
        _counters[path] = m, ChunkCache(Viterbi(m).count)
    return _counters[path]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = counter(path)
        get = cache.__getitem__
        whole = not m.byte_fallback and MARK not in m.score_of  # else a run of unknown characters ends with its chunk
        for batch in batches:
            n, scores = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                chunks = plain_chunks(m, text) if not whole else [m.normalise(text)[0]]
                got = [get(c) for c in (m.chunks(m.normalise(text)[0]) if chunks is None else chunks)]
                n.append(sum([g[0] for g in got]))
                scores.append(float(sum([g[1] for g in got])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score) with the pieces and scores of a SentencePiece model as the vocabulary."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_counted(path), f"doc_id {kind}, n_tokens long, score double")
