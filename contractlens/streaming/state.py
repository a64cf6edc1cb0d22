"""Streams with state of their own: paced calls and a bounded cache.

Both keep their state in the checkpoint (`transformWithStateInPandas`), so a restarted stream goes
on where it was; they need the RocksDB state store, which :func:`rocksdb` sets for a query's start.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB; the session's own setting comes back."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, was)


def release(us: int, tokens: int, last: int | None, window: list[tuple[int, int]], limit: int, gap: int, span: int) -> tuple[int, int, list[tuple[int, int]]]:
    """When a call may go, the tokens that the window holds then, and the window after it.

    A call goes no earlier than it came, than a gap after the last one, and than the window has room
    for it: so many calls leave the window, oldest first, as it takes.  A call over the whole limit
    goes alone.
    """
    at = us if last is None else max(us, last + gap)
    held = [(t, n) for t, n in window if at - t < span]
    used = sum(n for _, n in held)
    while held and used + tokens > limit:
        t, n = held.pop(0)
        at, used = max(at, t + span), used - n
        while held and at - held[0][0] >= span:
            used -= held.pop(0)[1]
    return at, used, [*held, (at, tokens)]


class Pacer(StatefulProcessor):
    """Calls of a key, first come first served.

    Held calls wait in a map by their number; timers of event time let them go once the watermark
    has reached their turn.  Without holding, each call is passed on at once with the time that it
    may go at.
    """

    def __init__(self, limit: int, gap: int, span: int, hold: bool):
        self.limit, self.gap, self.span, self.hold = limit, gap, span, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "number long", "us long, tokens long")
        self.place = handle.getValueState("place", "first long, next long, last long")
        self.window = handle.getListState("window", "us long, tokens long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.hold:  # nothing waits, so calls need not go through the state one by one
            yield self._pass_on(key, rows)
            return
        first, end, last = self._place()
        for us, tokens in sorted(x for frame in rows for x in zip(frame["us"].tolist(), frame["tokens"].tolist(), strict=True)):  # one key's calls of one batch
            self.waiting.updateValue((end,), (us, tokens))
            end += 1
        self.place.update((first, end, last))
        yield self._go(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _pass_on(self, key, rows) -> pd.DataFrame:
        """A batch's calls in their order; the state is read and written once."""
        first, end, last = self._place()
        window = [tuple(x) for x in self.window.get()]
        frames = [frame[["us", "tokens"]] for frame in rows]
        calls = pd.concat(frames).sort_values(["us", "tokens"])
        at_, used_ = [], []
        for us, tokens in zip(calls["us"].tolist(), calls["tokens"].tolist(), strict=True):
            last, used, window = release(us, tokens, last, window, self.limit, self.gap, self.span)
            at_.append(last)
            used_.append(used)
        self.place.update((first, end, last))
        if window:
            self.window.put(window)
        return pd.DataFrame({"key": key[0], "us": calls["us"].to_numpy(), "tokens": calls["tokens"].to_numpy(), "released_us": at_, "used": used_})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._go(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _place(self) -> tuple:
        return tuple(self.place.get()) if self.place.exists() else (0, 0, None)

    def _go(self, key, now: int) -> pd.DataFrame:
        first, end, last = self._place()
        window = [tuple(x) for x in self.window.get()]
        out = []
        while first < end:
            us, tokens = self.waiting.getValue((first,))
            at, used, after = release(us, tokens, last, window, self.limit, self.gap, self.span)
            if at > now:
                self.handle.registerTimer(-(-at // 1000))
                break
            self.waiting.removeKey((first,))
            out.append((key[0], us, tokens, at, used))
            first, last, window = first + 1, at, after
        self.place.update((first, end, last))
        if window:
            self.window.put(window)
        return pd.DataFrame(out, columns=["key", "us", "tokens", "released_us", "used"])

    def close(self) -> None:
        pass


def paced(calls: DataFrame, limit: int, per_minute: float, seconds: int = 60, hold: bool = False) -> DataFrame:
    """A stream of calls (key, us, tokens) with ``released_us`` and the tokens ``used`` in the window then.

    Between two calls of a key lies a minute over per_minute, and the window of so many seconds
    holds no more tokens than the limit.  With hold the stream has a watermark, and a call comes out
    when its time has come.  Calls of one batch are taken in the order of their times.
    """
    kind = calls.schema["key"].dataType.simpleString()
    processor = Pacer(limit, round(60_000_000 / per_minute), seconds * 1_000_000, hold)
    return calls.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, us long, tokens long, released_us long, used long", "append", "eventTime" if hold else "none")


class Cache(StatefulProcessor):
    """The entries of a shard, at most a capacity, which is also what a batch holds in memory."""

    def __init__(self, ttl: int, capacity: int, renew: bool):
        self.ttl, self.capacity, self.renew = ttl, capacity, renew

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.entries.iterator()}
        was, out = dict(held), []
        for us, name in sorted(x for frame in rows for x in zip(frame["us"].tolist(), frame["key"].tolist(), strict=True)):
            hit = name in held and us - held[name] <= self.ttl
            if self.renew or not hit:
                held[name] = us
            if len(held) > self.capacity:  # the oldest goes, of equals the last by name
                oldest = min(held.values())
                del held[max(k for k, v in held.items() if v == oldest)]
            out.append((name, us, hit))
        for k in was.keys() - held.keys():
            self.entries.removeKey((k,))
        for k, v in held.items():
            if was.get(k) != v:
                self.entries.updateValue((k,), (v,))
        yield pd.DataFrame(out, columns=["key", "us", "hit"])

    def close(self) -> None:
        pass


def bounded_cache(calls: DataFrame, days: float = 30, capacity: int = 200, shards: int = 1, renew: bool = False) -> DataFrame:
    """A stream of calls (key, us): (key, us, hit) by a cache of a capacity that forgets its oldest entries.

    An entry is good for some days; its time is that of the reading, or with renew of the last call.
    One shard is the whole cache in the order of the calls; more deal keys and capacity out.
    """
    keyed = calls.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.col("key").cast("string").alias("key"), "us")
    processor = Cache(int(days * 86_400_000_000), -(-capacity // shards), renew)
    return keyed.groupBy("shard").transformWithStateInPandas(processor, "key string, us long, hit boolean", "append", "none")


def cache_entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, us): what a bounded cache holds, read from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "entries").load(checkpoint)
    return state.select(F.col("user_map_key.key").alias("key"), F.col("user_map_value.us").alias("us"))
