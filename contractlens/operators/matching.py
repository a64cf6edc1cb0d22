"""Matching the clauses of two drafts, a batch of whole documents at a time: equal ones first, then by heading, then by body.

Sets (heading words, or tokens of a body) that are to reach a Jaccard similarity must share one of
their first tokens when the rarest of the document come first: of n tokens, the first
n - ceil(share * n) + 1.  Only those are indexed, and a pair that meets is dropped at once where
its sizes, or what is left of both sets behind the meeting token, rule the share out.  Equal sets of
one side are one class, so repeated lines make one pair and not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

HEADING_MIN, BODY_MIN = 0.70, 0.40
#: Rows and bytes of a batch of whole documents, and pairs that are looked at in one step.
BATCH_ROWS, BATCH_BYTES, STEP = 100_000, 32 << 20, 1 << 20


class Sets:
    """Sets of tokens, one for each row; a token is a number that tells its document too."""

    def __init__(self, lists: pa.Array, docs: np.ndarray):
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        codes = lists.flatten().dictionary_encode()
        rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        key = docs[rows] * max(len(codes.dictionary), 1) + codes.indices.to_numpy().astype(np.int64)
        _, token, count = np.unique(key, return_inverse=True, return_counts=True)
        order = np.lexsort((token, count[token], rows))  # the rarest of a document first
        self.tokens, self.rows = token[order], rows
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.places = np.arange(len(rows)) - self.starts[rows]
        self.width = int(token.max()) + 1 if len(token) else 1
        self.members = np.sort(self.rows * self.width + self.tokens)

    def of(self, row: int) -> bytes:
        return self.tokens[self.starts[row] : self.starts[row + 1]].tobytes()

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many tokens the rows a and b have in common, pair by pair."""
        out = np.zeros(len(a), dtype=np.int64)
        ends = np.cumsum(self.sizes[a])
        cuts = np.unique(np.searchsorted(ends, np.arange(STEP, ends[-1] + STEP, STEP), side="right")) if len(a) else []
        for lo, hi in zip([0, *cuts], [*cuts, len(a)], strict=True):
            n = self.sizes[a[lo:hi]]
            pair = np.repeat(np.arange(hi - lo), n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.starts[a[lo:hi]][pair]
            wanted = b[lo:hi][pair] * self.width + self.tokens[at]
            found = np.searchsorted(self.members, wanted)
            hit = self.members[np.minimum(found, len(self.members) - 1)] == wanted if len(self.members) else np.zeros(len(wanted), bool)
            out[lo:hi] = np.bincount(pair[hit], minlength=hi - lo)
        return out

    def jaccard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """0 where either is empty."""
        both = self.shared(a, b)
        union = self.sizes[a] + self.sizes[b] - both
        return np.where((self.sizes[a] == 0) | (self.sizes[b] == 0), 0.0, both / np.maximum(union, 1))

    def met(self, left: np.ndarray, right: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows, marked left and right, that may reach the share."""
        first = self.places < self.sizes[self.rows] - np.ceil(self.sizes[self.rows] * share - 1e-9) + 1
        a, b = (np.flatnonzero(first & side[self.rows]) for side in (left, right))
        b = b[np.argsort(self.tokens[b], kind="stable")]
        keys = self.tokens[b]
        lo, hi = np.searchsorted(keys, self.tokens[a], side="left"), np.searchsorted(keys, self.tokens[a], side="right")
        n, out = hi - lo, []
        ends = np.cumsum(n)
        cuts = np.unique(np.searchsorted(ends, np.arange(STEP, ends[-1] + STEP, STEP), side="right")) if len(a) else []
        for u, v in zip([0, *cuts], [*cuts, len(a)], strict=True):
            own = n[u:v]
            i = np.repeat(a[u:v], own)
            j = b[np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(lo[u:v], own)]
            x, y = self.sizes[self.rows[i]], self.sizes[self.rows[j]]
            left_over = 1 + np.minimum(x - self.places[i], y - self.places[j]) - 1
            good = (np.minimum(x, y) >= share * np.maximum(x, y) - 1e-9) & (left_over >= share / (1 + share) * (x + y) - 1e-9)
            out.append(np.unique(self.rows[i[good]] * len(self.sizes) + self.rows[j[good]]))
        pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)
        return pairs // max(len(self.sizes), 1), pairs % max(len(self.sizes), 1)


def _classes(sets: list[Sets], sides: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The first row with the same sets, side and document, for each row."""
    seen: dict[tuple, int] = {}
    return np.array([seen.setdefault((int(docs[r]), bool(sides[r]), *(s.of(r) for s in sets)), r) for r in range(len(docs))], dtype=np.int64)


def matched(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows (doc_id, side: true for the new draft, idx, key, tokens) of whole documents to pairs (doc_id, old_idx, new_idx, similarity), and which rows these take.

    First by heading, then by body; each old clause in order takes the best free new one, the first of equals.
    """
    ids = table.column("doc_id")
    docs = pc.rank(ids, tiebreaker="dense", null_placement="at_end").to_numpy().astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    new, idx = table.column("side").to_numpy(), table.column("idx").to_numpy()
    keys, bodies = Sets(table.column("key"), docs), Sets(table.column("tokens"), docs)
    first = _classes([keys, bodies], new, docs)
    lead = first == np.arange(len(first))
    members: dict[int, list[int]] = {}
    for r in np.lexsort((idx, first)).tolist():
        members.setdefault(int(first[r]), []).append(r)
    old = [r for r in np.lexsort((idx, docs)).tolist() if not new[r]]
    free = np.ones(len(first), dtype=bool)
    at = dict.fromkeys(members, 0)
    out: list[tuple[int, int, float]] = []
    for sets, share in ((keys, HEADING_MIN), (bodies, BODY_MIN)):
        a, b = sets.met(lead & ~new, lead & new, share)
        worth = sets.jaccard(a, b)
        good = worth >= share
        a, b, worth = a[good], b[good], worth[good]
        body = worth if sets is bodies else bodies.jaccard(a, b)
        ways: dict[int, list[tuple[float, int, float]]] = {}
        for i, j, w, s in zip(a.tolist(), b.tolist(), worth.tolist(), body.tolist(), strict=True):
            ways.setdefault(i, []).append((-w, j, s))
        for w in ways.values():
            w.sort()
        for r in old:
            if not free[r] or first[r] not in ways:
                continue
            best = None
            for w, j, s in ways[first[r]]:
                if best and w > best[0]:
                    break
                own = members[j]
                while at[j] < len(own) and not free[own[at[j]]]:
                    at[j] += 1
                if at[j] < len(own) and (best is None or idx[own[at[j]]] < idx[best[1]]):
                    best = (w, own[at[j]], s)
            if best:
                free[r] = free[best[1]] = False
                out.append((r, best[1], round(best[2], 3)))
    o, n = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
    return pa.table({"doc_id": ids.take(o), "old_idx": table.column("idx").take(o), "new_idx": table.column("idx").take(n), "similarity": pa.array([x[2] for x in out], pa.float64())}), ~free


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole documents, from batches in which a document's rows follow one another."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if held and (rows >= BATCH_ROWS or size >= BATCH_BYTES) and len(batch):
            last = held[-1].column("doc_id")[-1]
            ids = batch.column("doc_id")
            other = pc.fill_null(pc.not_equal(ids, last), True) if last.is_valid else pc.is_valid(ids)
            cut = pc.index(other, True).as_py()
            if cut >= 0:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, rows, size, batch = [], 0, 0, batch.slice(cut)
        if len(batch):
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def exact(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the old and of the new draft that have one digest: the k-th of it in a document meets the k-th on the other side."""
    code = lambda c: table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()  # noqa: E731  a null is a value
    rows = pd.DataFrame({"doc": code("doc_id"), "digest": code("digest"), "new": table.column("side").to_numpy(), "idx": table.column("idx").to_numpy()})
    rows["row"] = np.arange(len(rows))
    rows = rows.sort_values("idx")
    rows["k"] = rows.groupby(["doc", "digest", "new"]).cumcount()
    both = rows[~rows["new"]].merge(rows[rows["new"]], on=["doc", "digest", "k"])
    return both["row_x"].to_numpy(), both["row_y"].to_numpy()


def _words(joined: pa.ChunkedArray) -> pa.ChunkedArray:
    """Texts as lists of their words; none in the empty text."""
    return pc.if_else(pc.equal(joined, ""), pa.scalar([], pa.list_(joined.type)), pc.split_pattern(joined, " "))


def everything(table: pa.Table) -> pa.Table:
    """Rows (doc_id, side, idx, digest, key, tokens; words with a space between them) of whole documents to (doc_id, old_idx, new_idx, similarity), a row for each pair and for each clause without a partner."""
    ids, idx = table.column("doc_id"), table.column("idx")
    a, b = exact(table)
    open_ = np.ones(len(table), dtype=bool)
    open_[a] = open_[b] = False
    rest = table.filter(pa.array(open_)).combine_chunks()
    for name in ("key", "tokens"):
        rest = rest.set_column(rest.column_names.index(name), name, _words(rest.column(name)))
    near, taken = matched(rest)
    lone = rest.filter(pa.array(~taken))
    new = lone.column("side").to_numpy()
    nothing = pa.nulls(len(lone), pa.int32())
    same = pa.table({"doc_id": ids.take(pa.array(a)), "old_idx": idx.take(pa.array(a)), "new_idx": idx.take(pa.array(b)), "similarity": pa.array(np.ones(len(a)))})
    left = pa.table({"doc_id": lone.column("doc_id"), "old_idx": pc.if_else(pa.array(new), nothing, lone.column("idx")), "new_idx": pc.if_else(pa.array(new), lone.column("idx"), nothing), "similarity": pa.nulls(len(lone), pa.float64())})
    return pa.concat_tables([same, near, left])


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_documents(batches):
        yield from everything(table).combine_chunks().to_batches(max_chunksize=100_000)
