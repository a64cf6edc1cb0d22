"""The greedy rule against a plain loop."""

import random

import pytest

from contractlens.functions.scratch import Scratch
from contractlens.operators import greedy


def plain(edges, nodes):
    near = {}
    for a, b in edges:
        near.setdefault(b, []).append(a)
    kept, out = set(), {}
    for n in sorted(nodes):
        match = min((a for a in near.get(n, []) if a in kept), default=None)
        out[n] = (match is None, match)
        if match is None:
            kept.add(n)
    return out


def decided(spark, edges, nodes, kind="long"):
    rows, rounds = greedy.decide(spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(3), spark.createDataFrame([(n,) for n in nodes], f"doc_id {kind}"))
    got = rows.collect()
    assert len(got) == len(nodes)
    return {r["doc_id"]: (r["kept"], r["match"]) for r in got}, rounds


@pytest.mark.parametrize("limit", [5_000_000, 40])
@pytest.mark.parametrize("seed", range(2))
def test_equals_the_loop(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(greedy, "LIMIT", limit)
    r = random.Random(seed)
    edges = {tuple(sorted(r.sample(range(80), 2))) for _ in range(90)} | {(k, k + 1) for k in range(100, 190)} | {(100, k) for k in range(150, 160)}
    assert decided(spark, sorted(edges), range(200))[0] == plain(edges, range(200))


def test_a_long_chain_of_texts_as_ids(spark):
    names = [f"{k:05d}" for k in range(10_000)]
    edges = list(zip(names, names[1:], strict=False))
    got, rounds = decided(spark, edges, names, "string")
    assert got == plain(edges, names) and rounds < 20


def test_components(spark, monkeypatch):
    monkeypatch.setattr(greedy, "LOCAL", 5)
    edges = [(k, k + 3) for k in range(60)] + [(100, 101), (101, 102), (100, 102)]
    found, _ = greedy.components(spark.createDataFrame(edges, "a long, b long").repartition(4), Scratch(spark, "test"))
    assert {r["node"]: r["component"] for r in found.collect()} == {k: k % 3 for k in range(3, 63)} | {101: 100, 102: 100}
