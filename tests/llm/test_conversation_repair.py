"""Repairs against all strings of edits, tried out."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from contractlens.llm import conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, here string, pos int, state int"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        k = zlib.crc32(name.encode()) % 20
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Every choice for every row with up to two insertions before each and at the end; roles are tried freely."""
    best = {"": {(0, ""): []}}  # by the initials so far, in a short form that decides what may follow

    def insert(now):
        out = {k: dict(v) for k, v in now.items()}
        for _ in range(2):
            for had, ways in [(k, dict(v)) for k, v in out.items()]:
                for role in ("user", "assistant"):
                    add(out, had + role[0], {(c + 5, a + "I"): [*t, role + ":"] for (c, a), t in ways.items() if not a.endswith("II")})
        return out

    def add(out, key, ways):
        if not re.match(r"s?(ua)*u?\Z", key):
            return
        key = key if len(key) <= 3 else key[:1] * (key[0] == "s") + ("ua" if key[-1] == "a" else "uau")
        held = out.setdefault(key, {})
        held |= ways
        least = min(held)[0]
        out[key] = {k: v for k, v in held.items() if k[0] <= least + 12}

    for (_, _, role, text), fault in zip(rows, found, strict=True):
        new = {}
        for had, ways in insert(best).items():
            add(new, had, {(c + 2, a + "D"): t for (c, a), t in ways.items()})
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if role:
                add(new, had + role[0], {(c + more, a + "K"): [*t, f"{role}:{text}"] for (c, a), t in ways.items()})
            for other in ("user", "assistant"):
                add(new, had + other[0], {(c + 1 + more, a + "R"): [*t, f"{other}:{text}"] for (c, a), t in ways.items()})
        best = new
    ends = [(k, t) for had, ways in insert(best).items() if re.match(r"(s?(ua)+)?\Z", had) for k, t in ways.items()]
    (cost, audit), said = min(ends)
    return cost, audit, "\n".join(said)


def plain(rows):
    left = damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found = faults(own)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, said = cheapest(own, found)
        out.append((conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return Counter(out)


def made(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "agent", "tool", "", None, "Üser"])
            text = r.choice(["Yes.", "No", "Why?", "", " \n", None, "Long. text! é", "\u2028", f"t{turn}.", f"t{turn}?"])
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed, batch", [(0, 50_000), (1, 7), (2, 1)])
def test_repairs(spark, monkeypatch, seed, batch):
    monkeypatch.setattr(conversation_repair, "BATCH_ROWS", batch)
    rows = made(seed, 150, 9)
    table = spark.createDataFrame([(*x, "h", 1, 2) for x in rows], SCHEMA).repartition(3)
    assert Counter(map(tuple, conversation_repair.report(table).collect())) == plain(rows)


def test_long_and_whole_conversations(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(600)]
    rows += [(2, 0, "system", "x" * 300_000 + "."), (2, 1, "user", "y" * 300_000 + "."), (2, 2, "assistant", "z.")]
    table = spark.createDataFrame([(*x, "h", 1, 2) for x in rows], SCHEMA)
    got = {r["conv_id"]: r for r in conversation_repair.repair(conversation_repair.intact(table)).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (0, "K" * 600) and got[2]["audit"] == "KKK"
    assert got[1]["repaired"] == "\n".join(f"{r}:{t}" for _, _, r, t in rows[:600])
    assert conversation_repair.report(table.where("conv_id = 3")).count() == 0
