"""Streaming forms of what has state or time: budgets, once-only findings, caches, running results."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

WINDOW_S, TTL_DAYS, CAPACITY = 60, 30, 200


def micros(ts: str) -> Column:
    """A timestamp as microseconds since 1970, as its clock shows it."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def trailing_tokens(calls: DataFrame, by: str, ts: str, tokens: str, seconds: int = WINDOW_S) -> DataFrame:
    """calls with ``used``: the tokens of the same key in the trailing seconds, this call included.

    Calls are dealt by key and by stretches of so many seconds, and each stretch gets the one before
    it too, so a key of a third of all calls is spread over time.
    """
    span = seconds * 1_000_000
    own = calls.withColumn("us_", micros(ts)).withColumn("stretch_", F.floor(F.col("us_") / span))
    both = own.withColumn("on_", F.explode(F.array(F.lit(0), F.lit(1))))
    frame = Window.partitionBy(by, "stretch_").orderBy("us_").rangeBetween(-span, 0)
    used = both.withColumn("stretch_", F.col("stretch_") + F.col("on_")).withColumn("used", F.sum(tokens).over(frame))
    return used.where("on_ = 0").drop("us_", "stretch_", "on_")


def _budget(limit: int, seconds: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # no call for a while: nothing of the window is left
            state.remove()
            return
        held: list[tuple[int, int]] = [tuple(x) for x in state.get[0]] if state.exists else []
        out = []
        for at, n in sorted(x for frame in frames for x in zip(frame["us"].tolist(), frame["tokens"].tolist(), strict=True)):  # one key's calls of one batch
            held = [(t, m) for t, m in held if t > at - seconds * 1_000_000]
            used = sum(m for _, m in held)
            ok = used + n <= limit or not held
            if ok:
                held.append((at, n))
            out.append((key[0], at, n, used, ok))
        state.update(([list(x) for x in held],))
        state.setTimeoutDuration(2000 * seconds)
        yield pd.DataFrame(out, columns=["key", "us", "tokens", "used", "admitted"])

    return step


def token_budget(calls: DataFrame, limit: int, seconds: int = WINDOW_S) -> DataFrame:
    """A stream of calls (key, us, tokens) with what was used in the window, and whether one more fits.

    State is the calls of one key in the window; it goes when a key is idle for two windows.  Calls
    that arrive in one batch are taken in the order of their times.
    """
    kind = calls.schema["key"].dataType.simpleString()
    return calls.groupBy("key").applyInPandasWithState(_budget(limit, seconds), f"key {kind}, us long, tokens long, used long, admitted boolean", "held array<array<long>>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_findings(findings: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """A stream of document findings, each (doc_id, rule_id) once within the watermark's delay."""
    return findings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["doc_id", "rule_id"])


def fresh_entries(entries: DataFrame, now, key: str = "key", ts: str = "ts", days: int = TTL_DAYS, capacity: int = CAPACITY) -> DataFrame:
    """The latest entry of each key that is no older than the days, the newest of a capacity."""
    latest = entries.groupBy(key).agg(F.max(ts).alias(ts))
    alive = latest.where(F.col(ts) > now - F.expr(f"INTERVAL {days} DAYS"))
    return alive.orderBy(F.desc(ts), key).limit(capacity)


def _cache(ttl_us: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        out = []
        for at in sorted(x for frame in frames for x in frame["us"].tolist()):
            hit = stored is not None and at - stored <= ttl_us
            stored = stored if hit else at
            out.append((key[0], at, hit))
        state.update((stored,))
        state.setTimeoutDuration(max(1, ttl_us // 1000))
        yield pd.DataFrame(out, columns=["key", "us", "hit"])

    return step


def cached(calls: DataFrame, days: float = TTL_DAYS) -> DataFrame:
    """A stream of calls (text, us): (key, us, hit), a text being fresh for some days after it was read.

    The key is the text's SHA-256; a key that nobody asks for goes when its time is over.  How many
    entries are held at all is for :func:`fresh_entries`.
    """
    keyed = calls.select(F.sha2("text", 256).alias("key"), "us")
    return keyed.groupBy("key").applyInPandasWithState(_cache(int(days * 86_400_000_000)), "key string, us long, hit boolean", "stored long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_per_batch(docs: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Results of each micro-batch of documents appended as they come; a replayed batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        work(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def backoff_seconds(attempt: int, jitter: float) -> float:
    """Wait before another try: doubling up to 30 s, with up to a second of jitter."""
    return min(2**attempt, 30) + jitter


def with_retries(call: Callable, attempts: int = 4, wait: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> Callable:
    """call that is tried again after an error, with growing pauses; the last error is raised."""

    def tried(*args, **named):
        for k in range(attempts):
            try:
                return call(*args, **named)
            except Exception:
                if k == attempts - 1:
                    raise
                wait(backoff_seconds(k, jitter()))

    return tried
