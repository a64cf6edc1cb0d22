"""Paced calls and the bounded cache against plain loops, over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from contractlens.streaming import state, stream


def plain(calls, limit, gap, span):
    """Minute by minute: a call waits until nothing forbids it."""
    out, went = [], []
    for us, n in calls:
        at = max([us, *(t + gap for t, _ in went[-1:])])
        while True:
            inside = [(t, m) for t, m in went if at - t < span]
            if not inside or sum(m for _, m in inside) + n <= limit:
                break
            at = inside[0][0] + span
        out.append((us, n, at, sum(m for _, m in inside)))
        went.append((at, n))
    return out


def batches(spark, folder, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
        yield k


def run(df, name, checkpoint):
    with state.rocksdb(df.sparkSession):
        q = df.writeStream.format("parquet").option("path", name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(200)


@pytest.mark.parametrize("seed", range(40))
def test_release(seed):
    r = random.Random(seed)
    calls, us = [], 0
    for _ in range(60):
        us += r.choice([0, 0, 1, 5, 30])
        calls.append((us, r.choice([1, 3, 9, 25])))
    limit, gap, span = r.choice([5, 10, 20]), r.choice([0, 2, 7]), r.choice([10, 25])
    got, last, window = [], None, []
    for u, n in calls:
        at, used, window = state.release(u, n, last, window, limit, gap, span)
        got.append((u, n, at, used))
        last = at
    assert got == plain(calls, limit, gap, span)


@pytest.mark.parametrize("hold", [False, True])
def test_paced_stream_over_restarts(spark, tmp_path, hold):
    r = random.Random(1)
    calls = {k: sorted((r.randrange(300) * 1_000_000, r.choice([10, 40, 90])) for _ in range(25)) for k in ("a", "b")}
    schema = "key string, us long, tokens long"
    parts = [[(k, us, n) for k, own in calls.items() for us, n in own if lo <= us < lo + 100_000_000] for lo in (0, 100_000_000, 200_000_000)]
    parts.append([("end", 10**12, 1)])  # moves the watermark past all
    for _ in batches(spark, tmp_path / "in", parts, schema):
        source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        if hold:
            source = source.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "0 seconds")
        run(state.paced(source, 100, 12, hold=hold), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {}
    for row in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(row["key"], []).append(tuple(row)[1:])
    for k, own in calls.items():
        assert sorted(got[k]) == sorted(plain(own, 100, 5_000_000, 60_000_000))


@pytest.mark.parametrize("renew", [False, True])
def test_bounded_cache(spark, tmp_path, renew):
    r = random.Random(2)
    day = 86_400_000_000
    calls = sorted((r.randrange(90) * day + r.randrange(day), f"k{r.randrange(40)}") for _ in range(400))
    schema, held = "key string, us long", {}
    parts = [[(k, us) for us, k in calls[i : i + 100]] for i in range(0, 400, 100)]
    want = []
    for n in batches(spark, tmp_path / "in", parts, schema):
        run(state.bounded_cache(spark.readStream.schema(schema).json(str(tmp_path / "in")), capacity=15, renew=renew), str(tmp_path / "out"), str(tmp_path / "state"))
        for k, us in parts[n]:
            hit = k in held and us - held[k] <= 30 * day
            want.append((k, us, hit))
            if renew or not hit:
                held[k] = us
            while len(held) > 15:
                del held[min(held, key=held.get)]
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(want)
        assert {row["key"]: row["us"] for row in state.cache_entries(spark, str(tmp_path / "state")).collect()} == held
        if renew:  # what the table of all calls says: the newest of the latest of each key
            entries = spark.createDataFrame([(k, us) for p in parts[: n + 1] for k, us in p], schema).withColumn("ts", F.timestamp_micros("us"))
            fresh = stream.fresh_entries(entries, F.timestamp_micros(F.lit(parts[n][-1][1])), days=10_000, capacity=15)
            assert {row["key"] for row in fresh.collect()} == set(held)


def test_calls_that_need_not_wait_are_not_stored_one_by_one():
    """A batch of calls costs the state two writes, however many calls it has."""
    import pandas as pd

    class Kept:
        value, writes = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value if self.value is not None else []

        def update(self, value):
            self.value, self.writes = value, self.writes + 1

        put = update

    class Handle:
        def __init__(self):
            self.made = {}

        def getValueState(self, name, *_):
            return self.made.setdefault(name, Kept())

        getMapState = getListState = getValueState

    handle, r = Handle(), random.Random(3)
    pacer = state.Pacer(500, 600, 7200, hold=False)
    pacer.init(handle)
    calls = [(r.randrange(10**6), r.randrange(20, 200)) for _ in range(600)]
    frames = [pd.DataFrame(calls[i : i + 200], columns=["us", "tokens"]) for i in (0, 200, 400)]
    got = [tuple(map(int, x)) for out in pacer.handleInputRows(("k",), iter(frames), None) for x in out[["us", "tokens", "released_us", "used"]].itertuples(index=False)]
    assert got == plain(sorted(calls), 500, 600, 7200)
    assert sum(k.writes for k in handle.made.values()) == 2
