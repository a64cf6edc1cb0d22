"""Each operator against a plain version, over texts with nulls, ties, repeats and odd characters."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contractlens.llm import chat, common, license_scan, packing, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup, token_counts, topk
from contractlens.llm.components import components
from tests.llm.conftest import PASSAGE
from tests.llm.conftest import words as noise

SPACE = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(SPACE, t or "")


def multiset(rows):
    return Counter(map(tuple, rows))


# -- quality rules ---------------------------------------------------------------------------------


def measured(t):
    w, t = words(t), t or ""
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    twice = Counter(grams)
    covered = {j for k, g in enumerate(grams) if twice[g] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, texts, empty):
    got = quality_rules.ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert multiset(got) == Counter((i, *measured(t)) for i, t in texts)
    assert quality_rules.ledger(empty).count() == 0


def test_quality_policies(spark, docs, texts):
    book = quality_rules.ledger(docs).cache()
    bad = sum(1 for _, t in texts if (m := measured(t))[0] < 20 or 100 * m[4] > 30 * m[0])
    assert book.where(~quality_rules.passes("v1")).count() == bad
    rows = {r["rule"]: r for r in quality_rules.ablation(book).collect()}
    masks = [r[0] for r in book.select("failures").collect()]
    mask = quality_rules.policy_mask()
    for name, r in rows.items():
        bit = 1 << r["bit"]
        assert (r["failed"], r["failed_alone"]) == (sum(bool(m & bit) for m in masks), sum(m & mask == bit for m in masks)), name
        assert r["kept_without"] == sum(not m & mask & ~bit for m in masks)
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(not m & mask for m in masks)


def test_long_documents_are_whole(spark):
    text = "alpha beta gamma " * 150_000  # over a block
    row = quality_rules.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_repeat_words"]) == (450_000, 450_000)


def thue_morse(n):
    """Two texts of n letters that every polynomial over their bytes with an odd base takes for one, from 1,024 letters on."""
    return tuple("".join("ab"[(bin(i).count("1") + k) & 1] for i in range(n)) for k in (0, 1))


def test_words_and_lines_are_compared_by_their_bytes(spark):
    one, other = thue_morse(1024)
    tail = [f"t{i}" for i in range(7)]
    texts = [f"{one}\n{other}", f"{one}\n{one}", " ".join([one, *tail, "x", other, *tail, *noise(20, 3).split()]), " ".join([one, *tail, "x", one, *tail, *noise(20, 3).split()]), f"{one} {other} {one} {one}"]
    got = quality_rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert multiset(r[:6] for r in got) == Counter((i, *measured(t)) for i, t in enumerate(texts))
    assert {r["doc_id"]: r["n_same_next"] for r in got}[4] == 1


# -- SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), seed=42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    groups = {}
    for a, i in enumerate(ids):
        groups.setdefault(find(a), []).append(i)
    return [min((x for x in groups[find(a)] if x is not None), default=None) for a in range(len(ids))]


def test_near_duplicates(docs, texts, empty):
    ids, prints = [i for i, _ in texts], [plain_fingerprint(t) for _, t in texts]
    want = Counter(zip(ids, prints, plain_components(ids, prints), strict=True))
    got = Counter((i, fp % 2**64, c) for i, fp, c in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits, at_once", [(6, 1 << 21), (6, 500), (9, 1 << 21)])
def test_ball_hashing_finds_every_link(monkeypatch, bits, at_once):
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", at_once)
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**63, 40).astype(np.uint64)
    for _ in range(3):
        x = np.concatenate([x, x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))])
    x = np.unique(x)
    ball = simhash.Ball(2, bits)
    assert len(ball.masks) == 1 + 64 + 64 * 63 // 2
    found = [simhash.links(x[np.isin(ball.code(x) ^ np.uint64(s), ball.reach)], s, ball) for s in range(1 << bits)]
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    assert len(a) and np.bitwise_count(a ^ b).max() <= 4
    index = {v: i for i, v in enumerate(x.tolist())}
    whole = plain_components(list(range(len(x))), x.tolist())
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        root[max(find(index[p]), find(index[q]))] = min(find(index[p]), find(index[q]))
    assert [find(i) for i in range(len(x))] == whole


def test_one_of_each(docs, texts):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    prints = [plain_fingerprint(t) for _, t in texts]
    want = {c for (i, _), c in zip(texts, plain_components([i for i, _ in texts], prints), strict=True) if i is not None and i == c}
    assert sorted(x for x in ids if x is not None) == sorted(want) and ids.count(None) == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (900, 700), (700, 900), (800, 900)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long"), common.Scratch(spark, "test")).collect()))
    assert got == {i: 0 for i in range(1, 201)} | {900: 700, 800: 700}


# -- substring dedup -------------------------------------------------------------------------------


def plain_kept(texts, window):
    where = Counter()
    for _, t in texts:
        w = words(t)
        where.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if where[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, w, [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


@pytest.mark.parametrize("window", [35, 16])
def test_repeated_words(docs, texts, window):
    want = Counter((i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, w, k in plain_kept(texts, window))
    assert multiset(substring_dedup.repeated_words(docs, window).collect()) == want


def test_stripped_documents(docs, texts, empty):
    got = substring_dedup.strip_documents(docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    want = Counter()
    for (i, t), (_, w, k) in zip(texts, plain_kept(texts, 35), strict=True):
        text = t if len(w) == len(k) else " ".join(k)
        want[i, text, len(t or "") if len(w) == len(k) else len(text)] += 1
    assert multiset(got.select("doc_id", "text", "n_chars").collect()) == want
    assert substring_dedup.strip_documents(empty).count() == 0


def test_null_and_repeated_ids(spark):
    """Different texts share a doc_id or have none, and hold recurring passages; null and short texts lie beside them."""
    passages = [noise(50, 1000 + k) for k in range(4)]
    texts = [(i, f"{noise(5 + 7 * k, 100 + 10 * k + (i or 0))} {passages[k]} {noise(60 - 9 * k, 200 + 10 * k + (i or 0))}") for i in (None, 1, 2, 3) for k in range(4)]
    texts += [(None, None), (1, None), (None, noise(10, 7)), (1, noise(10, 8)), (None, texts[0][1]), (1, texts[4][1]), (2, texts[4][1]), (0, noise(70, 9)), (0, noise(70, 10))]
    own = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts], "doc_id long, text string, n_chars long").repartition(3)
    plain = plain_kept(texts, 35)
    want = Counter((i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, w, k in plain)
    assert multiset(substring_dedup.repeated_words(own).collect()) == want
    want = Counter((i, t if len(w) == len(k) else " ".join(k)) for (i, t), (_, w, k) in zip(texts, plain, strict=True))
    assert multiset(substring_dedup.strip_documents(own).select("doc_id", "text").collect()) == want


# -- packing ---------------------------------------------------------------------------------------


def check_plan(counts, plan):
    keys, sequences, offsets, n = plan.places()
    size = np.repeat(np.arange(len(counts)), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    at = np.searchsorted(keys, size << 48 | rank, side="right") - 1
    seq, off = sequences[at] + rank - (keys[at] & ((1 << 48) - 1)), offsets[at]
    order = np.lexsort((off, seq))
    seq, off, size = seq[order], off[order], size[order]
    first = np.r_[True, seq[1:] != seq[:-1]]
    assert (off == np.where(first, 0, np.r_[0, (off + size)[:-1]])).all() and (off + size).max() <= len(counts) - 1
    assert len(np.unique(seq)) == n
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    counts = np.r_[0, rng.integers(0, [3, 30, 300, 3, 30, 300][seed], 1024)] * (rng.random(1025) < [1, 1, 1, 0.02, 0.05, 0.3][seed]).astype(int)
    n = check_plan(counts, packing.Plan(counts))
    least = -(-int((counts * np.arange(1025)).sum()) // 1024)
    large = int(counts[513:].sum())  # no two of these share a sequence
    assert n <= 1.04 * max(least, large) + 12


def test_packed_pieces(docs, texts, empty, tokenizers):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, with_ids=True).collect()
    want = Counter()
    for i, t in texts:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids) + 1, 1024)], strict=True)):
            raw = np.array(ids[a:b], "<u4").tobytes()
            want[i, k, a, b - a, zlib.crc32(raw), raw] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == want
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 1024
    assert packing.pack(empty, path).count() == 0


# -- SentencePiece and token counts ------------------------------------------------------------------


def test_encoding_and_decoding(docs, texts, empty, tokenizers):
    sp = pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    lib = sp.SentencePieceProcessor(model_file=path)
    want = Counter()
    for i, t in texts:
        ids = lib.encode(t or "", add_eos=True)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert multiset(sentencepiece_codec.encode_documents(docs, path).collect()) == want
    whole = sentencepiece_codec.encode_documents(docs, path, spans=True)
    assert multiset(whole.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
    back = Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in sentencepiece_codec.decode_documents(whole, path).collect())
    assert back == Counter((i, d) for i, _, _, d in want.elements())
    assert sentencepiece_codec.encode_documents(empty, path).count() == 0


@pytest.mark.parametrize("extra", [True, False])
def test_character_map_and_spans(texts, tokenizers, extra):
    sp = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto.FromString(open(tokenizers.path("piece_bpe_32k.model"), "rb").read())
    rules = pb.ModelProto.FromString(sp.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.CopyFrom(rules.normalizer_spec)
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = extra
    lib, own = sp.SentencePieceProcessor(model_proto=proto.SerializeToString()), sentencepiece_codec.Model(proto.SerializeToString())
    assert own.chars
    for t in [*(t for _, t in texts if t is not None), "ﬁne ½ ㈱ ①Ⅳ ™　x  ", " lead", "é é", "​ z"]:
        ids, spans = own.encode(t)
        pieces = lib.encode(t, out_type="proto").pieces
        assert ids == [p.id for p in pieces] and spans == [(p.begin, p.end) for p in pieces], t[:40]
        assert own.decode(ids) == lib.decode(ids)


def test_long_chunks_merge_as_short_ones(tokenizers, monkeypatch):
    m = sentencepiece_codec.model(tokenizers.path("piece_bpe_32k.model"))
    text = "▁" + "ababcdthe" * 30
    long = m.merge(text)
    monkeypatch.setattr(sentencepiece_codec, "SHORT", 10_000)
    assert long == m.merge(text)


def test_unigram_counts(docs, texts, empty, tokenizers):
    """The library's unigram search over the same pieces; its single-precision sums need scores of one magnitude."""
    sp = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    path = tokenizers.path("piece_bpe_32k.model")
    proto = pb.ModelProto.FromString(open(path, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)
    lib, own = sp.SentencePieceProcessor(model_proto=proto.SerializeToString()), sentencepiece_codec.Model(proto.SerializeToString())
    search = token_counts.Viterbi(own)
    for _, t in texts:
        for w in (t or "").split()[:400]:
            assert search.count("▁" + w.replace(" ", "▁"))[0] == len(lib.encode(w)), w
    rows = token_counts.count_tokens(docs, path).collect()
    whole = token_counts.Viterbi(sentencepiece_codec.model(path))
    want = Counter()
    for i, t in texts:
        m = whole.model
        n, s = whole.count(m.normalise(t)[0]) if t else (0, 0.0)
        want[i, n, s] += 1
    assert multiset(rows) == want
    assert token_counts.count_tokens(empty, path).count() == 0


def test_ties_take_the_longer_last_piece():
    m = sentencepiece_codec.Model.__new__(sentencepiece_codec.Model)
    m.score_of = {"a": -1.0, "b": -1.0, "ab": -2.0, "c": -1.0, "abc": -3.0}
    m.byte_fallback = False
    assert token_counts.Viterbi(m).count("abc") == (1, -3.0)
    assert token_counts.Viterbi(m).count("abz") == (2, -2.0 - 13.0)


# -- licence scan ----------------------------------------------------------------------------------


def test_licence_scan(docs, texts, empty):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    want, labels = Counter(), {}
    for i, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        hits = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        want[i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
        labels[i] = {x for _, x in hits}
    rows = license_scan.scan(docs).collect()
    assert Counter(tuple(r)[:6] for r in rows) == want
    for r in rows:
        assert labels.get(r["doc_id"], set()) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert license_scan.scan(empty).count() == 0


def test_templates_align(spark):
    texts = [t.text for t in license_scan.TEMPLATES]
    noise = " lorem ipsum dolor "
    rows = [(i, noise + t.upper() + noise) for i, t in enumerate(texts)] + [(100, "license granted to nobody"), (101, "free software of charge permission")]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(license_scan.TEMPLATES):
        assert t.label in got[i]["labels"].split(","), t
    assert got[100]["labels"] == "" and got[101]["labels"] == ""


def test_rarer_words_elsewhere_hide_no_notice(spark):
    """A long text with every notice, or with rare template words scattered, keeps the labels of commoner words."""
    rare = "mozilla filler eclipse filler affero filler unencumbered filler creative filler attribution filler lesser filler domain "
    rows = [(i, f"{rare * 3}{noise(400, i)} {t.text} {noise(300, 50 + i)}") for i, t in enumerate(license_scan.TEMPLATES)]
    rows += [(100, f" {noise(90, 99)} ".join(t.text for t in license_scan.TEMPLATES)), (101, rare * 20)]
    rows += [(200 + i, license_scan.TEMPLATES[i % 6].text) for i in range(60)]  # makes some words common
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(license_scan.TEMPLATES):
        assert t.label in got[i]["labels"].split(","), t
        assert abs(got[i]["score"] - 1) < 1e-9
    assert {t.label for t in license_scan.TEMPLATES} <= set(got[100]["labels"].split(",")) and got[101]["labels"] == ""


def plain_licences(texts):
    """Labels and score of each text by counting places word by word."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    index = license_scan.postings(license_scan.TEMPLATES)
    vocabulary = {w for w, _, _ in index}
    own = [cut(t) for t in texts]
    frequency = Counter(w for words in own for w in set(words) & vocabulary)
    idf = {w: math.log(1 + len(texts) / n) for w, n in frequency.items()}
    out = []
    for words in own:
        norm = " " + " ".join(words) + " "
        base = {label for p, label in license_scan.BASE if f" {p} " in norm}
        labels, best = set(base), 0.5 if base else 0.0
        for t, template in enumerate(license_scan.TEMPLATES):
            mine, text = [(w, pos) for w, x, pos in index if x == t], template.text.split()
            keys = [(at, k.split()) for k in template.keys for at in range(len(text)) if text[at : at + len(k.split())] == k.split()]
            weigh = lambda w: idf.get(w, math.log(1 + len(texts)))
            rare = sorted({w for w, _ in mine}, key=lambda w: (-weigh(w), w))[: license_scan.LOOKED_UP]
            mine = [(w, pos) for w, pos in mine if w in rare or any(at <= pos < at + len(k) for at, k in keys)]
            for begin in range(-len(text), len(words)):
                if all(begin + at >= 0 and words[begin + at : begin + at + len(k)] == k for at, k in keys):
                    agree = sum(weigh(w) for w, pos in mine if 0 <= begin + pos < len(words) and words[begin + pos] == w)
                    labels.add(template.label)
                    best = max(best, min(1.0, agree / sum(weigh(w) for w, _ in mine)))
        out.append((",".join(sorted(labels)), round(best, 9)))
    return out


def test_licence_labels_and_scores(spark, texts):
    """Every notice whole, shuffled, cut in two by other words, in capitals, and without its key phrases."""
    rng = random.Random(5)
    rows = [t for _, t in texts]
    for t in license_scan.TEMPLATES:
        words = t.text.split()
        middle = len(words) // 2
        rows += [f"{noise(30, 1)} {t.text} {noise(9, 2)}", " ".join(rng.sample(words, len(words))), " ".join([*words[:middle], *noise(3, 4).split(), *words[middle:]]), t.text.upper(), " ".join(w for w in words if all(w not in k.split() for k in t.keys)), f"{t.text} and {t.text}", " ".join(f"{k} x" for k in t.keys)]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == plain_licences(rows)


# -- classifier ------------------------------------------------------------------------------------


def test_classifier(spark, docs, empty):
    rng = np.random.default_rng(0)
    pick = lambda own: " ".join(rng.choice(own, 30))
    good, bad = [f"word{i}" for i in range(50)], [f"junk%%{i}" for i in range(50)]
    rows = [(i, pick(good if i % 2 else bad), i % 2) for i in range(400)]
    own = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, label int")
    got = quality_classifier.classify(own, labels).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == r["doc_id"] % 2 == int(r["score"] >= 0.7)
    # labels of held-out rows are never learned from
    flipped = spark.createDataFrame([(i, (1 - y) if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, label int")
    assert sorted(map(tuple, quality_classifier.classify(own, flipped).collect())) == sorted(map(tuple, got))
    logits = quality_classifier.fit(own, labels)
    scored = quality_classifier.score(docs, logits)
    assert scored.columns == [*docs.columns, "quality_score_"]
    assert all(0 <= r[0] <= 1 for r in scored.select("quality_score_").collect()) and scored.count() == docs.count()
    kept = quality_classifier.keep_documents(docs, logits)
    assert kept.columns == docs.columns
    assert multiset(kept.collect()) == multiset(scored.where("quality_score_ >= 0.7").drop("quality_score_").collect())
    assert quality_classifier.classify(empty, labels).count() == 0
    assert all(r["score"] == 0.5 for r in quality_classifier.classify(docs, labels.where("doc_id < 0")).collect())


def test_training_is_bounded(spark):
    own = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = own.selectExpr("doc_id", "cast(doc_id % 2 as int) as label")
    assert (quality_classifier.fit(own, labels, 10) == quality_classifier.fit(own, labels, 10)).all()


# -- top-k -----------------------------------------------------------------------------------------


def plain_top(rows, queries, k=5):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if not queries(q):
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [0.0] * 6), (310, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("q", F.lit(1)).repartition(4)
    vectors = topk.integer_vectors(df)
    assert set(map(tuple, topk.top_k(vectors, F.col("vec_id") % 10 == 0).collect())) == plain_top(rows, lambda q: q % 10 == 0)
    monkeypatch.setattr(topk, "GROUP_NUMBERS", 30)  # several groups of queries
    monkeypatch.setattr(topk, "FEW", 5)
    assert set(map(tuple, topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect())) == plain_top(rows, lambda q: q % 50 == 0)
    assert topk.top_k(vectors.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    assert topk.top_k(vectors.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(vectors.where("vec_id = 50"), F.col("vec_id") == 50).count() == 0


# -- chat ------------------------------------------------------------------------------------------


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\nI have flour."),
        (1, 1, "assistant", "> how do I  BAKE bread?\nWith yeast."),
        (1, 2, "user", ">> How do I bake bread?\n> With yeast.\n\nThanks!"),
        (1, 3, "assistant", "You are welcome."),
        (1, 4, "user", "> nobody said this\nreally"),
        (1, 5, "user", "> How do I bake bread?\n> I have flour.\nMe too."),
        (2, 0, "user", "> With yeast.\nother talk"), (2, 1, None, None), (None, 1, "user", "> x"), (2, None, "user", ""), (2, 2, "user", "> other talk"), (2, 2, "user", "> other talk"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(9)).withColumn("level", F.lit(9))
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["thread_turn"], r["depth"], r["body"]) for r in chat.format_conversations(df).collect()}
    assert got == {
        (1, 0): (None, 0, 0, "How do I bake bread?\nI have flour."), (1, 1): (0, 0, 1, "With yeast."), (1, 2): (1, 0, 2, "Thanks!"), (1, 3): (None, 3, 0, "You are welcome."),
        (1, 4): (None, 4, 0, "really"), (1, 5): (0, 0, 1, "Me too."), (2, 0): (None, 0, 0, "other talk"), (2, 1): (None, 1, 0, ""), (None, 1): (None, 1, 0, ""),
        (2, None): (None, None, 0, ""), (2, 2): (0, 0, 1, ""),
    }
    assert chat.format_conversations(df).count() == len(rows)
    assert chat.format_conversations(df.where("turn < 0")).count() == 0


def test_long_runs_of_blanks_are_encoded(spark, tokenizers):
    """The faster library gives up on such runs; the other's ids are the result."""
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" + " \n" * 300_000 + "b"):
        want = np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.encoder(path).ids(text) == want
    rows = packing.pack(spark.createDataFrame([(1, " " * 1_000_000)], "doc_id long, text string"), path).collect()
    assert sum(r["length"] for r in rows) == 1_000_001


def test_one_row_of_each_group(spark, docs, texts):
    """Exactly one row of each group stays, whatever the ids are, and always the same one."""
    ids, prints = [i for i, _ in texts], [plain_fingerprint(t) for _, t in texts]
    kept = simhash.one_row_of_each(docs)
    assert kept.columns == docs.columns
    got = multiset((r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect())
    groups = plain_components(list(range(len(texts))), prints)
    want = Counter()
    for g in set(groups):
        rows = [k for k in range(len(texts)) if groups[k] == g]
        first = min((ids[k] is None, ids[k] or 0, np.uint64(prints[k]).view(np.int64), k) for k in rows)[3]
        want[texts[first]] += 1
    assert got == want and got[31, texts[-2][1]] == got[31, texts[-1][1]] == 1
    # two texts under one id, one of them a near copy of a smaller id; a null id only beside named copies; equal rows
    base, other = noise(80, 500), noise(80, 501)
    rows = [(1, base), (9, base), (9, other), (None, other), (None, noise(80, 502)), (None, noise(80, 502)), (4, None), (3, "")]
    own = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("a"), F.lit(1))).repartition(3)
    for _ in range(2):
        got = multiset(simhash.one_row_of_each(own).select("doc_id", "text").collect())
        assert got == Counter([(1, base), (9, other), (None, noise(80, 502)), (3, "")])
    assert simhash.one_row_of_each(own.where("doc_id = -1")).count() == 0


def test_many_small_shards_give_the_same_components(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_VARIANTS", 1 << 8)
    monkeypatch.setattr(simhash, "HELD_LINKS", 1)
    ids, prints = [i for i, _ in texts], [plain_fingerprint(t) for _, t in texts]
    want = Counter(zip(ids, prints, plain_components(ids, prints), strict=True))
    assert Counter((i, fp % 2**64, c) for i, fp, c in simhash.near_duplicates(docs).collect()) == want


def test_top_k_of_large_and_repeated_vectors(spark):
    """Finite vectors of any size, one id in several rows, against whole numbers of any size."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=2) * 10.0 ** rng.integers(-1, 3)).tolist()) for i in range(60)]
    rows += [(100, [1e13, 1e13]), (101, [-1e13, 1e5]), (102, [3e15, 7.0]), (103, [1e200, -1e200]), (104, [1.7e308, 0.0]), (105, [0.0, 0.0]), (110, [1e13, -1.0])]
    rows += [(50, [4.0, 4.0]), (50, [4.0, 4.0]), (50, [-3.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = multiset(topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 10 == 0).collect())
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if all(np.isfinite(256 * x) for x in v)]
    assert len(ok) == len(rows) - 1
    want = Counter()
    fit = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    for q, a in ok:
        if q % 10 == 0:
            scores = sorted((-fit(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in ok if i != q)
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5]))
    assert got == want


def test_places_keep_the_order():
    x = np.array([-2.0**63, -1e17, -257.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 2.0**53, 2.0**63])
    assert (np.diff(topk.places(x)) > 0).all() and topk.places(np.array([0.0, 1.0, -1.0])).tolist() == [0, 1, -1]


def plain_descent(samples, labels, buckets, dims, epochs, rate, seed):
    """Softmax regression on a document's mean vector, one feature and one number at a time."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).tolist()
    output = [[0.0] * dims for _ in range(2)]
    step, steps = 0, epochs * len(samples)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)).tolist():
            at, counts = samples[i]
            total = float(sum(counts))
            mean = [sum(vectors[b][d] * n / total for b, n in zip(at, counts, strict=True)) for d in range(dims)]
            scores = [sum(w * m for w, m in zip(o, mean, strict=True)) for o in output]
            odds = [np.exp(s - max(scores)) for s in scores]
            error = [o / sum(odds) - (c == labels[i]) for c, o in enumerate(odds)]
            now = rate * (1 - step / steps)
            back = [sum(error[c] * output[c][d] for c in range(2)) for d in range(dims)]
            for c in range(2):
                for d in range(dims):
                    output[c][d] -= now * error[c] * mean[d] * dims
            for b, n in zip(at, counts, strict=True):
                for d in range(dims):
                    vectors[b][d] -= now * dims * n / total * back[d]
            step += 1
    return [sum(v * (b - a) for v, a, b in zip(x, output[0], output[1], strict=True)) for x in vectors]


def test_training_equals_plain_descent(monkeypatch):
    monkeypatch.setattr(quality_classifier, "BUCKETS", 97)
    rng = np.random.default_rng(4)
    samples = [(np.sort(rng.choice(97, 8, replace=False)), rng.integers(1, 90_000, 8).astype(float)) for _ in range(30)]
    labels = rng.integers(0, 2, 30)
    want = plain_descent([(a.tolist(), c.tolist()) for a, c in samples], labels.tolist(), 97, quality_classifier.DIMENSIONS, 3, 0.5, 7)
    assert np.allclose(quality_classifier.train(samples, labels, 3, 0.5, 7), want, atol=1e-5)


def plain_buckets(text):
    """The features of a text, by their plain definition."""
    crc, span = lambda t, start=0: zlib.crc32(t.encode(), start), quality_classifier.BUCKETS - 1
    own, out = re.findall(SPACE, text), [0]
    for w in own:
        marked = f"<{w}>"
        out += [crc(marked, 1) % span + 1, *(crc(marked[i : i + k]) % span + 1 for k in (2, 3, 4) for i in range(len(marked) - k + 1))]
    return Counter(out + [(crc(a) ^ crc(b)) % span + 1 for a, b in zip(own, own[1:], strict=False)])


def test_features_and_scores(texts):
    logits = np.random.default_rng(5).normal(size=quality_classifier.BUCKETS).astype(np.float32)
    scorer = quality_classifier.Scorer(logits)
    for _, t in texts:
        want = plain_buckets(t or "")
        at, n = quality_classifier.document_counts((t or "").encode())
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == want
        mean = sum(float(logits[b]) * k for b, k in want.items()) / want.total()
        assert abs(scorer.score((t or "").encode()) - 1 / (1 + np.exp(-mean))) < 1e-9


def test_training_bound_holds_for_repeated_ids_and_long_texts(spark, monkeypatch):
    learned = next(i for i in range(20, 40) if zlib.crc32(str(i).encode()) % 4 != 2)
    own = spark.createDataFrame([(i % 20, f"text {i}") for i in range(2000)] + [(learned, "long " * 70_000)], "doc_id long, text string")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as label")
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda samples, y: seen.append(samples) or np.zeros(quality_classifier.BUCKETS, dtype=np.float32))
    quality_classifier.fit(own, labels, 10)
    quality_classifier.fit(own.repartition(5), labels, 10)
    assert len(seen[0]) == len(seen[1]) <= 10
    assert all((a == b).all() and (m == n).all() for (a, m), (b, n) in zip(*seen, strict=True))
    seen.clear()
    quality_classifier.fit(own, labels)
    assert max(n.max() for _, n in seen[0]) >= 69_999


@pytest.mark.parametrize("places", [0, 3, 256])
def test_frequent_anchors_are_split(spark, monkeypatch, places):
    """A few common words, and a passage just short of a window, in many surroundings; a third of the rows hold them."""
    monkeypatch.setattr(substring_dedup, "ANCHOR_PLACES", places)
    notice, nearly, whole = noise(8, 700), noise(34, 701), noise(50, 702)
    texts = [(i, f"{noise(30, 1000 + i)} {notice} {noise(30, 2000 + i)}") for i in range(60)]
    texts += [(100 + i, f"{noise(10, 3000 + i)} {nearly} {noise(10, 4000 + i)}") for i in range(30)]
    texts += [(200 + i, f"{noise(5 + i, 5000 + i)} {whole} {noise(5, 6000 + i)}") for i in range(5)]
    texts += [(300, " ".join(f"{noise(20, 7000 + k)} {notice}" for k in range(40))), (301, f"{whole} " * 3), (302, notice + " " + whole)]
    own = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = Counter((i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, w, k in plain_kept(texts, 35))
    assert multiset(substring_dedup.repeated_words(own).collect()) == want


def test_more_words_than_letters(monkeypatch):
    rows = [(bytes([k]), f"{noise(20, 800 + k)} {PASSAGE} {noise(9, 900 + k)}".encode(), 1) for k in range(3)] + [(b"x", noise(40, 950).encode(), 2)]
    want = list(substring_dedup.locate(rows, 35))
    monkeypatch.setattr(substring_dedup, "LETTERS", 5)
    assert list(substring_dedup.locate(rows, 35)) == want and len(want) == 4


@pytest.mark.parametrize("fallback", [True, False])
def test_unknown_runs_count_as_the_library_counts_them(tokenizers, fallback):
    sp = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto.FromString(open(tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)
        if not fallback and p.type == 6:
            p.type = 1
    proto.trainer_spec.byte_fallback = fallback
    lib, own = sp.SentencePieceProcessor(model_proto=proto.SerializeToString()), sentencepiece_codec.Model(proto.SerializeToString())
    search = token_counts.Viterbi(own)
    for t in ["🙂", "🙂🙃🙂", "a🙂🙃 🙂b 🙃🙂", "🙂 🙂", "x🙂y🙃z", "⿕⿔ ⿓"]:
        assert sum(search.count(c)[0] for c in own.chunks(own.normalise(t)[0])) == len(lib.encode(t)), t


def test_spans_are_on_the_main_path(spark, docs, texts, tokenizers):
    """The query's own columns: spans of the library for every text, and no text lost between them."""
    sp = pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    lib = sp.SentencePieceProcessor(model_file=path)
    more = [*texts, (900, "  lead and tail  "), (901, "▁ mark ▁▁"), (902, "🙂 🙂🙂\n\n"), (903, "日本 語 é"), (904, " "), (905, "word " * 60_000)]
    own = spark.createDataFrame(more, "doc_id long, text string").repartition(3)
    got = multiset((r["doc_id"], r["n_tokens"], tuple(r["starts"]), tuple(r["ends"])) for r in sentencepiece_codec.encode_documents(own, path, spans=True, ids=False).collect())
    want = Counter()
    for i, t in more:
        pieces = lib.encode(t or "", return_type="proto").pieces
        size = len((t or "").encode())
        want[i, len(pieces) + 1, (*(p.begin for p in pieces), size), (*(p.end for p in pieces), size)] += 1
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_chat_equals_its_sql_on_nested_quotes(spark, tmp_path, seed):
    """Generated conversations: replies quote whole messages, single lines and quotes of quotes, some reworded or from nowhere."""
    import random

    import duckdb

    from contractlens.llm import queries
    from tests.harness import rows_of

    r = random.Random(seed)
    rows = []
    for conv in range(12):
        said: list[list[str]] = []
        for turn in range(r.randint(1, 14)):
            lines = []
            for _ in range(r.randint(0, 2) if said else 0):
                source = r.choice(said)
                part = source if r.random() < 0.6 else [r.choice(source)]
                mark = r.choice([">", "> ", " >", ">> ", "> > "])
                lines += [mark + (x.upper() if r.random() < 0.2 else x) for x in part]
            if r.random() < 0.1:
                lines.append("> nobody said this")
            own = [" ".join(noise(r.randint(1, 4), r.randint(0, 60)).split()) for _ in range(r.randint(1, 3))]
            lines += own + [""] * r.randint(0, 1)
            rows.append((conv, turn, r.choice(["user", "assistant", None]), "\n".join(lines)))
            said.append(lines)
    rows.append((20, 0, "user", "a long message " * 20_000))
    rows.append((20, 1, "user", "> " + "a long message " * 20_000 + "\nso it is"))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    df.toPandas().to_parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op6_chat_formatting(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    asked = c.execute(queries.ORACLE_SQL["op6_chat_formatting"])
    columns = [d[0] for d in asked.description]
    have = rows_of(got.columns, [tuple(x) for x in got.collect()])
    assert have == rows_of(columns, asked.fetchall())
    assert got.where("parent_turn is not null").count() > 20 and got.where("depth > 1").count() > 3
