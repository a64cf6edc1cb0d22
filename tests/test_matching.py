"""Matching by prefixes against all pairs."""

import random

import pyarrow as pa
import pytest

from contractlens.operators import matching

SCHEMA = pa.schema([("doc_id", pa.int64()), ("side", pa.bool_()), ("idx", pa.int32()), ("key", pa.list_(pa.string())), ("tokens", pa.list_(pa.string()))])


def table(rows):
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


def plain(rows):
    out = []
    for d in {r[0] for r in rows}:
        side = lambda new: sorted((r for r in rows if r[0] == d and r[1] is new), key=lambda r: r[2])
        old, new, gone, taken = side(False), side(True), set(), set()
        for k, share in ((3, 0.7), (4, 0.4)):
            for o in old:
                ways = [(-jaccard(o[k], n[k]), n[2], jaccard(o[4], n[4])) for n in new if n[2] not in taken and jaccard(o[k], n[k]) >= share]
                if ways and o[2] not in gone:
                    _, n, body = min(ways)
                    gone.add(o[2])
                    taken.add(n)
                    out.append((d, o[2], n, round(body, 3)))
    return sorted(out)


def made(seed, docs=4):
    r = random.Random(seed)
    own = [f"w{i}" for i in range(r.choice([3, 6, 12, 30]))]
    return [(d, side, i, r.sample(own, r.choice([0, 0, 1, 2, 3])), r.sample(own, r.randint(0, min(len(own), 9)))) for d in range(docs) for side in (False, True) for i in range(r.randint(0, 12))]


@pytest.mark.parametrize("seed", range(60))
def test_pairs(seed, monkeypatch):
    monkeypatch.setattr(matching, "STEP", 7 if seed % 2 else 1 << 20)
    rows = made(seed)
    assert sorted(tuple(x.values()) for x in matching.matched(table(rows))[0].to_pylist()) == plain(rows)


def test_equal_lines_are_one_pair():
    rows = [(1, side, i, [], ["same", "words"]) for side in (False, True) for i in range(5000)]
    got = matching.matched(table(rows))[0].to_pylist()
    assert [(r["old_idx"], r["new_idx"]) for r in got] == [(i, i) for i in range(5000)]


@pytest.mark.parametrize("size", [1, 5, 10_000])
def test_documents_stay_whole(monkeypatch, size):
    monkeypatch.setattr(matching, "BATCH_ROWS", size)
    rows = made(7, 20)
    batches = table(rows).to_batches(max_chunksize=3)
    whole = list(matching.whole_documents(iter(batches)))
    assert pa.concat_tables(whole).equals(table(rows))
    assert len({d for t in whole for d in set(t.column("doc_id").to_pylist())}) == sum(len(set(t.column("doc_id").to_pylist())) for t in whole)


def test_equal_ones_first_and_those_without_a_partner():
    rows = [(1, False, 0, "x", ["aaa"]), (1, False, 1, "x", ["aaa"]), (1, False, 2, "y", ["bbb", "ccc"]), (1, False, 3, "z", []), (1, True, 4, "x", ["aaa"]), (1, True, 5, "w", ["bbb"]), (1, True, 6, "v", ["ddd"]), (2, True, 0, "x", ["aaa"]), (None, True, 0, "x", []), (None, False, 1, "x", [])]
    names = ["doc_id", "side", "idx", "digest", "key", "tokens"]
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.string(), pa.string()]
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3].encode() for r in rows], ["" for _ in rows], [" ".join(r[4]) for r in rows]]
    got = matching.everything(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)).to_pylist()
    assert {tuple(r.values()) for r in got} == {(1, 0, 4, 1.0), (1, 2, 5, 0.5), (1, 1, None, None), (1, 3, None, None), (1, None, 6, None), (2, None, 0, None), (None, 1, 0, 1.0)}
