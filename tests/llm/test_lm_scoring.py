"""Scores against counts and a mixture written out plainly, and the fit of the weights."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from contractlens.llm import lm_scoring

END = object()


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), END]


def kind(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64(doc_id), {lm_scoring.DELETED}) = 0 as deleted").collect()
    deleted = {r[0]: r[1] for r in rows}
    return {i: 0 if i is not None and zlib.crc32(str(i).encode()) % 7 == 2 else 2 if deleted[i] else 1 for i in ids}


def bucket(c):
    return 0 if not c else min(c.bit_length(), lm_scoring.BUCKETS - 1)


def counted(own):
    return Counter(w for t in own for w in t), Counter((a, b) for t in own for a, b in zip([END, *t], t, strict=False))


def plain(spark, texts):
    kinds = kind(spark, {i for i, _ in texts})
    words = [(i, kinds[i], tokens(t)) for i, t in texts]
    kept, kept2 = counted([t for _, k, t in words if k == 1])
    one, two = counted([t for _, k, t in words if k])
    n, kept_n, v = sum(one.values()), max(sum(kept.values()), 1), len(one)
    cells = Counter()
    for _, k, t in words:
        for a, b in zip([END, *t], t, strict=False) if k == 2 else ():
            near = lambda p: min(round(-math.log2(p) * lm_scoring.STEPS), lm_scoring.STEPS * lm_scoring.STEPS_DOWN) if p else -1
            cells[bucket(kept[a]), near(kept2[a, b] / max(kept[a], 1)), near(kept[b] / kept_n)] += 1
    weights = lm_scoring.learn(np.array(sorted((*c, m) for c, m in cells.items()), dtype=np.int64).reshape(-1, 4), 1 / (v + 1))
    out = []
    for i, k, t in words:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        mixed = sum(math.log10(np.dot(weights[bucket(one[a])], [two[a, b] / max(one[a], 1), one[b] / max(n, 1), 1 / (v + 1)])) for a, b in zip([END, *t], t, strict=False))
        out.append((i, k == 0, len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(mixed, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk, part", [(1 << 20, 1 << 21), (50, 300)])
def test_scores(spark, docs, texts, monkeypatch, chunk, part):
    monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
    monkeypatch.setattr(lm_scoring, "PART", part)
    more = [(i, " ".join(f"w{(i * k + k * k) % 17}" for k in range(40))) for i in range(200, 260)]
    table = docs.select("doc_id", "text", "rank", "score").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = lm_scoring.score(table)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got.collect()), key=str)
    assert rows == plain(spark, [*texts, *more])


def test_no_training_documents_and_no_rows(spark, empty):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_scoring.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert tuple(row)[:6] == (held, True, 3, 0, 0, 0.0) and row["score"] == pytest.approx(3 * math.log10(0.5))
    assert lm_scoring.score(empty).count() == 0


def test_weights_find_the_mixture():
    rng = np.random.default_rng(0)
    true = np.array([0.6, 0.3, 0.1])
    estimates = [(two, one, p) for two, one in ((4, 40), (-1, 8), (20, 12), (-1, 60)) for p in [[0 if s < 0 else 2.0 ** (-s / lm_scoring.STEPS) for s in (two, one)]]]
    weights = np.array([np.dot(true, [*p, 0.001]) for *_, p in estimates])
    drawn = rng.multinomial(200_000, weights / weights.sum())
    cells = np.array([(5, two, one, n) for (two, one, _), n in zip(estimates, drawn, strict=True)], dtype=np.int64)
    got = lm_scoring.learn(cells, 0.001)
    likelihood = lambda w: sum(n * math.log(np.dot(w, [*p, 0.001])) for (_, _, p), n in zip(estimates, drawn, strict=True))
    for other in ([0.6, 0.3, 0.1], [0.34, 0.33, 0.33], [0.9, 0.05, 0.05], got[5] * [1.02, 0.98, 1] / (got[5] * [1.02, 0.98, 1]).sum()):
        assert likelihood(got[5]) >= likelihood(other) - 1
    assert np.allclose(got.sum(axis=1), 1) and got[0, 0] == 0 and np.allclose(got[7], 1 / 3)


def test_it_beats_the_base_on_held_out_text(spark):
    from tests.harness import DATA

    rows = lm_scoring.score(spark.read.parquet(f"{DATA}/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]
