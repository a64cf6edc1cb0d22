"""Versions of changes against a plain fold over each client's rows."""

import datetime as dt
import math
import random
import zlib
from collections import Counter

import pytest

from contractlens.llm import versioned_merge

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double, v int, kept string, at int, i long"
EPOCH = dt.datetime(1970, 1, 1)


def low(x):
    return (x is not None, x if x is not None else 0)


def plain(rows, nulls_keep=False):
    rows = {r[:9] for r in rows if r[4] is not None}
    clients = {}
    for change, client, seq, op, at, *values, balance in rows:
        if change is not None and zlib.crc32(str(change).encode()) % 7 == 0:
            at -= dt.timedelta(hours=36)
        values.append(math.floor(100 * balance + 0.5) if balance is not None and math.isfinite(balance) else None)
        clients.setdefault(client, []).append((change, seq, op, at, tuple(values)))
    out = []
    for client, own in clients.items():
        firsts, kept = {}, {}
        for r in sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[3], low(r[2]), *map(low, r[4]))):
            firsts.setdefault(r[1], r)
        for r in sorted(firsts.values(), key=lambda r: low(r[1])):
            kept[r[3]] = r
        state, versions = None, []
        for at in sorted(kept):
            _, seq, op, _, values = kept[at]
            was = state
            if op == "D":
                state = (True, None, None, None, None)
            elif op == "I" or op == "U" and not nulls_keep:
                state = (False, *values)
            elif op == "U":
                state = (False, *(y if x is None else x for x, y in zip(values, state[1:] if state else (None,) * 4, strict=True)))
            if state != was:
                versions.append((at, seq, state))
        for k, (at, seq, state) in enumerate(versions):
            ends = versions[k + 1][0] if k + 1 < len(versions) else None
            n = len({r[0] for r in own if r[0] is not None and r[3] >= at and (ends is None or r[3] < ends)})
            seconds = lambda t: None if t is None else (t - EPOCH) // dt.timedelta(seconds=1)
            out.append((client, k + 1, seconds(at), seconds(ends), *state, seq, n))
    return Counter(out)


def made(seed, n, clients):
    r = random.Random(seed)
    some = lambda *x: r.choice([None, *x, *x])
    rows = []
    for _ in range(n):
        at = some(*(dt.datetime(2024, 3, 9, 22) + dt.timedelta(minutes=20 * k) for k in range(250)))
        rows.append((some(*range(60)), r.choice(clients), some(*range(40)), some("D", "I", *"UUUUU"), at, some("web"), some("a", "b"), some("x"), some(0.005, -1.015, 12.5, float("nan"), float("inf"), 1e300), 1, "k", 2, 3))
    return rows + rows[: n // 5]


@pytest.mark.parametrize("nulls_keep", [False, True])
@pytest.mark.parametrize("seed", range(2))
def test_versions(spark, seed, nulls_keep):
    rows = made(seed, 400, [None, 1, 1, 1, 1, 2, 3, 4, 5])
    table = spark.createDataFrame([tuple(min(x, 9e15) if j == 8 and x is not None and x < math.inf else x for j, x in enumerate(r)) for r in rows], SCHEMA).repartition(3)
    want = plain([tuple(min(x, 9e15) if j == 8 and x is not None and x < math.inf else x for j, x in enumerate(r)) for r in rows], nulls_keep)
    assert Counter(map(tuple, versioned_merge.merge(table, nulls_keep).collect())) == want


def test_one_client_of_many_equal_updates(spark):
    rows = [(k, 1, k, "I" if not k else "U", dt.datetime(2024, 1, 1) + dt.timedelta(days=3 * k), "web", None if k else "a", "x", 1.0, 0, "", 0, 0) for k in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, versioned_merge.merge(table, True).collect())) == plain(rows, True)
    assert versioned_merge.merge(table, True).count() == 1  # the first insert's segment is kept
    assert Counter(map(tuple, versioned_merge.merge(table).collect())) == plain(rows)


def test_no_rows_and_the_sessions_zone(spark):
    rows = made(9, 60, [1, 2])
    table = spark.createDataFrame(rows, SCHEMA)
    want = Counter(map(tuple, versioned_merge.merge(table).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert Counter(map(tuple, versioned_merge.merge(spark.createDataFrame(rows, SCHEMA)).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    empty = versioned_merge.merge(table.where("client_id = -1"))
    assert empty.count() == 0 and empty.columns[:4] == ["client_id", "version", "valid_from", "valid_to"]
