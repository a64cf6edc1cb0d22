"""Merge of change records into versions, by pointer doubling.

The points in time of all clients are put in one order (client, time) and numbered from 0 without
gaps, so the row before another is the one numbered one less, if it has the same client.  Each row
holds a transformer of its client's state: a delete or insert is a reset, an update sets values,
and a time whose changes were all dropped leaves the state alone.  In round k every row that is
not yet a reset joins the row 2^k before it and composes the two transformers, until it has met a
reset or its client's first row.  Rounds are thus as many as the logarithm of the longest run
without a reset, however many rows a client has, and no client is gathered, ordered or folded in
one task: rows are dealt out by range, by number or by (client, seq), (client, time) and change.

Versions are numbered in the same way as rows: states that differ from the one before them are
numbered without gaps, and a client's first number is taken off.  Every point in time finds the
start of its version by doubling too, which is where its changes are counted.

By default a null in an update sets null, so an update is a reset too and only dropped times are
composed; with ``nulls_keep`` it leaves the value that is there since the last delete or insert.

Defined cases: null valid_at: the row is ignored; a null client_id is a client of its own; a null
seq is equal to other null ones and lower than all; a null change_id is the largest, does not move
the time and is not counted; of rows equal in client, seq and change_id the least of (time, op and
values) counts; another op than D, I and U leaves the state alone; a balance that is no finite
number is null, and one beyond long the nearest long; repeated rows count once; an empty table
gives no versions; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contractlens.llm.common import Scratch

ATTRIBUTES = ("source", "segment", "city", "balance_cents")
#: Seconds by which valid_at moves, and what the checksum of the change_id is divided by.
MOVED, MOVED_BY = 36 * 3600, 7
_LOW = (1 << 33) - 1


def micros(c: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970; a timestamp without a zone is UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def cents(balance: Column) -> Column:
    """floor(100 * balance + 0.5); null if that is no finite number."""
    x = F.lit(100) * balance.cast("double") + 0.5
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.floor(x)).cast("long")


def numbered(df: DataFrame, keys: list[str], scratch: Scratch, name: str, number: str = "i") -> DataFrame:
    """df in the order of its keys, which are unique, with numbers from 0 without gaps.

    Rows are numbered within the ranges that they are dealt out to; one count for each range comes
    to the driver.
    """
    ordered = scratch.table(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place_", F.monotonically_increasing_id()), name)
    part = F.shiftright("place_", 33)
    sizes, start, starts = sorted(map(tuple, ordered.groupBy(part.alias("part_")).count().collect())), 0, []
    for p, n in sizes:
        starts.append((p, start))
        start += n
    offsets = df.sparkSession.createDataFrame(starts, "part_ long, start_ long")
    return ordered.withColumn("part_", part).join(F.broadcast(offsets), "part_").withColumn(number, F.col("start_") + F.col("place_").bitwiseAND(_LOW)).drop("part_", "start_", "place_")


def doubled(rows: DataFrame, combine: Callable[[Column, Column], Column], scratch: Scratch, name: str) -> DataFrame:
    """rows (i, client_id, done, v) with v composed of all rows of the client back to the last one that was done, as (i, client_id, v).

    combine(before, own) is associative.  Only rows that are not done look back; one number a round
    comes to the driver.
    """
    open_, settled, k = rows.where("not done"), [rows.where("done")], 0
    while open_.limit(1).count():
        seen = open_
        for s in settled:
            seen = seen.unionByName(s)
        before = seen.select(F.col("i").alias("i2"), F.col("client_id").alias("client2"), F.col("done").alias("done2"), F.col("v").alias("v2"))
        found = open_.join(before.hint("merge"), (F.col("i") - (1 << k) == F.col("i2")) & F.col("client_id").eqNullSafe(F.col("client2")), "left")
        there = F.col("i2").isNotNull()
        new = scratch.table(found.select("i", "client_id", F.coalesce("done2", F.lit(True)).alias("done"), F.when(there, combine(F.col("v2"), F.col("v"))).otherwise(F.col("v")).alias("v")), f"{name}{k}")
        settled.append(new.where("done"))
        open_ = new.where("not done")
        k += 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("i", "client_id", "v")


def changes_of(table: DataFrame) -> DataFrame:
    """change_id, client_id, seq, op, at (microseconds, moved) and attributes of rows that have a time."""
    at = micros(F.col("valid_at"), table.schema["valid_at"].dataType)
    early = F.coalesce(F.crc32(F.col("change_id").cast("string").cast("binary")) % MOVED_BY == 0, F.lit(False))
    rows = table.where(F.col("valid_at").isNotNull())
    return rows.select("change_id", "client_id", "seq", "op", (at - F.when(early, F.lit(MOVED * 1_000_000)).otherwise(F.lit(0))).alias("at"), "source", "segment", "city", cents(F.col("balance")).alias("balance_cents"))


def points(changes: DataFrame) -> DataFrame:
    """client_id, at, kept: each time of a client with the change that counts there, null if all were dropped."""
    rest = ("at", "op", *ATTRIBUTES)
    first = F.min(F.struct(F.col("change_id").isNull().alias("none"), "change_id", *rest)).alias("f")
    left = changes.groupBy("client_id", "seq").agg(first)
    kept = left.select("client_id", F.col("f.at").alias("at"), F.struct("seq", "f.op", *(f"f.{a}" for a in ATTRIBUTES)).alias("kept"))
    times = changes.select("client_id", "at", F.lit(None).cast(kept.schema["kept"].dataType).alias("kept"))
    return kept.unionByName(times).groupBy("client_id", "at").agg(F.max("kept").alias("kept"))


def states(ordered: DataFrame, nulls_keep: bool, scratch: Scratch) -> DataFrame:
    """i, client_id, v (known, is_deleted, attributes): the state after each point in time."""
    op = F.coalesce(F.col("kept.op").isin("D", "I", "U"), F.lit(False))
    deleted = F.col("kept.op") == "D"
    own = F.struct(op.alias("known"), F.when(op, deleted).alias("is_deleted"), *(F.when(op & ~deleted, F.col(f"kept.{a}")).alias(a) for a in ATTRIBUTES))
    reset = op & (F.col("kept.op") != "U") if nulls_keep else op
    rows = scratch.table(ordered.select("i", "client_id", reset.alias("done"), own.alias("v")), "transformers")

    def combine(before: Column, own: Column) -> Column:
        if nulls_keep:
            both = F.struct(own["known"].alias("known"), own["is_deleted"].alias("is_deleted"), *(F.coalesce(own[a], before[a]).alias(a) for a in ATTRIBUTES))
            return F.when(own["known"], both).otherwise(before)
        return F.when(own["known"], own).otherwise(before)

    return scratch.table(doubled(rows, combine, scratch, "composed"), "states")


def merge(table: DataFrame, nulls_keep: bool = False) -> DataFrame:
    """Versions of each client: client_id, version, valid_from, valid_to, is_deleted, attributes, first_seq, n_changes.

    Times are epoch seconds, the end is exclusive and null where it is open.
    """
    scratch = Scratch(table.sparkSession, "versions")
    changes = changes_of(table)
    ordered = numbered(points(changes), ["client_id", "at"], scratch, "points")
    now = states(ordered, nulls_keep, scratch)

    before = now.select((F.col("i") + 1).alias("i"), F.col("client_id").alias("client2"), F.col("v").alias("v2"))
    new = F.col("v.known") & ~(F.col("client_id").eqNullSafe(F.col("client2")) & F.coalesce(F.col("v2.known"), F.lit(False)) & F.col("v").eqNullSafe(F.col("v2")))
    turns = scratch.table(now.join(before.hint("merge"), "i", "left").select("i", "client_id", "v", F.coalesce(new, F.lit(False)).alias("start")), "turns")

    # each point in time finds the start of its version
    pointers = turns.select("i", "client_id", (F.col("start") | ~F.col("v.known")).alias("done"), F.when(F.col("start"), F.col("i")).alias("v"))
    homes = doubled(pointers, lambda before, own: F.coalesce(own, before), scratch, "homes").where("v is not null").select("i", F.col("v").alias("home"))
    homes = scratch.table(ordered.select("i", "client_id", "at").join(homes.hint("merge"), "i").select("client_id", "at", "home"), "homes")
    # a change stands in one version at most, so a row of (client, time, change) is enough
    placed = changes.select(F.col("client_id").alias("client2"), F.col("at").alias("at2"), "change_id").join(homes.hint("merge"), F.col("client_id").eqNullSafe(F.col("client2")) & (F.col("at") == F.col("at2")))
    counts = placed.groupBy("home").agg(F.count_distinct("change_id").alias("n_changes"))

    first = ordered.select("i", "at", F.col("kept.seq").alias("first_seq"))
    starts = turns.where("start").join(first.hint("merge"), "i")
    starts = numbered(starts.select("i", "client_id", "v", "at", "first_seq"), ["i"], scratch, "starts", "r")
    least = scratch.table(starts.groupBy(F.col("client_id").alias("client2")).agg(F.min("r").alias("r0")), "least")  # written, so that the join has shuffles of its own, whose large partitions Spark splits
    following = starts.select((F.col("r") - 1).alias("r"), F.col("client_id").alias("client3"), F.col("at").alias("end"))
    seconds = lambda c: F.call_function("div", c - F.pmod(c, F.lit(1_000_000)), F.lit(1_000_000))
    ended = starts.join(following.hint("merge"), "r", "left").join(least.hint("merge"), F.col("client_id").eqNullSafe(F.col("client2")))
    return ended.join(counts.hint("merge"), F.col("i") == F.col("home"), "left").select(
        "client_id", (F.col("r") - F.col("r0") + 1).cast("int").alias("version"), seconds(F.col("at")).alias("valid_from"), F.when(F.col("client_id").eqNullSafe(F.col("client3")), seconds(F.col("end"))).alias("valid_to"),
        "v.is_deleted", *(f"v.{a}" for a in ATTRIBUTES), "first_seq", F.coalesce("n_changes", F.lit(0)).alias("n_changes"),
    )
