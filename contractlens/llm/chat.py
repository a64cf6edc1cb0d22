"""Chat formatting by linking quotations to the messages that they quote.

Lines that begin with ``>`` marks are quoted; the number of marks is their level.  Consecutive
lines of a level are a passage.  Normalised passages, and their first lines, are hashed and joined
to the messages of the same conversation whose own words they are: a line, or a whole message.
The first such message is the origin.  A message replies to the latest origin before it; following
replies up gives the thread, and the depth in it.  Threads in the order of their first messages,
each in the order of turns, put every reply after what it replies to.

Origins are aggregated to one row for each conversation and hash before they are joined, so a
common passage or a large conversation gives no pairs; threads are found by doubling, a join a
round, and no conversation is collected.

Defined cases: a null or empty text has an empty body and no quotes; a null conv_id or turn has no
links and is its own thread; repeated rows each get a row, and rows that share a turn share their
links; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contractlens.llm.common import Scratch

MARKS = r"^[ \t]*(>[ \t]*)+"
_BLANK = " \t\r\n"


def normalised(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"[ \t\r\n]+", " "), F.lit(_BLANK)))


def own_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: ~line.rlike(MARKS))


def body(text: Column) -> Column:
    """A message without its quoted lines and without white space at its ends."""
    return F.btrim(F.array_join(own_lines(text), "\n"), F.lit(_BLANK))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage (its lines joined by one space), first_line; for quoted lines only."""
    quoting = messages.where(F.col("text").rlike("(?m)" + MARKS)).withColumn("row", F.monotonically_increasing_id())
    lines = quoting.select("row", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("marks", F.regexp_extract("line", MARKS, 0)).withColumn("level", F.length(F.regexp_replace("marks", "[^>]", "")))
    order = Window.partitionBy("row").orderBy("at")  # the lines of one message
    runs = lines.withColumn("new", (F.coalesce(F.lag("level").over(order), F.lit(-1)) != F.col("level")).cast("int")).withColumn("run", F.sum("new").over(order)).where("level > 0")
    said = runs.withColumn("said", normalised(F.substring(F.col("line"), F.length("marks") + 1, F.length("line")))).where("said <> ''")
    grouped = said.groupBy("row", "conv_id", "turn", "run", "level").agg(F.sort_array(F.collect_list(F.struct("at", "said"))).alias("lines"))
    texts = F.transform("lines", lambda x: x["said"])
    return grouped.select("conv_id", "turn", "level", F.array_join(texts, " ").alias("passage"), texts[0].alias("first_line"))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, origin: quoted passages and the first earlier message whose words they are."""
    quoted = passages(messages)
    keys = quoted.select("conv_id", "turn", "level", F.explode(F.array_distinct(F.array(F.md5("passage"), F.md5("first_line")))).alias("key"))
    own = F.concat(F.array(normalised(F.array_join(own_lines(F.col("text")), " "))), F.transform(own_lines(F.col("text")), normalised))
    asked = quoted.select("conv_id").distinct()
    said = messages.join(asked, "conv_id", "left_semi").select("conv_id", "turn", F.explode(F.array_distinct(own)).alias("said")).where("said <> ''")
    origins = said.groupBy("conv_id", F.md5("said").alias("key")).agg(F.min("turn").alias("origin"))
    return keys.join(origins, ["conv_id", "key"]).where("origin < turn").groupBy("conv_id", "turn", "level").agg(F.max("origin").alias("origin"))


def threads(linked: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, parent_turn, thread_turn, depth of the messages that reply, by doubling."""
    parents = scratch.table(linked.groupBy("conv_id", "turn").agg(F.max("origin").alias("parent_turn")), "parents")
    now, k = scratch.table(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("hops")), "hops0"), 0
    while True:
        above = now.select(F.col("conv_id"), F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        k += 1
        new = scratch.table(now.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.col("up2").isNotNull().alias("moved")), f"hops{k}")
        scratch.drop(f"hops{k - 1}")
        now = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return parents.join(now, ["conv_id", "turn"]).select("conv_id", "turn", "parent_turn", F.col("up").alias("thread_turn"), F.col("hops").alias("depth"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, thread_turn, depth, n_levels, body, formatted.

    (thread_turn, turn) is the reply order within a conversation; formatted is the message between
    role and end marks, without quotes.
    """
    spark = messages.sparkSession
    scratch = Scratch(spark, "chat")
    plain = messages.select("conv_id", "turn", "role", "text")
    linked = scratch.table(links(plain), "links")
    levels = linked.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_levels"))
    found = threads(linked, scratch).join(levels, ["conv_id", "turn"])
    said = body(F.col("text"))
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n"))
    return (
        plain.withColumn("body", said)
        .join(found, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", "role", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_levels", F.lit(0)).alias("n_levels"), "body", formatted.alias("formatted"))
    )
