"""Repair of the structure of conversations at the least cost.

A conversation should read ``(system? (user assistant)+)?`` by the initials of its roles.  Rows are
dealt out by conversation and reach a task in order; there, a DuckDB recursive query runs over a
batch of whole conversations.  Each of its steps takes one row more of every conversation and
keeps, for each state of the grammar, the least cost and the audit that leads there, so the work
for a row is the same however long its conversation is.  A path is a string of edits, and two paths
to one state after the same rows that cost the same are never one the other's beginning (an edit
more costs more), so the least audit so far stays the least whatever follows.

Edits, by their initials: Keep, Rerole (to user or assistant), Delete, Insert (an empty user or
assistant message).  Insertions are tried before a row that is kept or given a role, and at the end:
before a row that is deleted they are never the least audit.  More than one in a row is only tried
at the end, after a lone system message; elsewhere it changes nothing but the cost.

Memory: a batch holds at most BATCH_ROWS rows or BATCH_BYTES of text, or one longer conversation.
A conversation is hashed as one text, in order, so it can't be spread over tasks; it is bounded as a
document is.

Defined cases: a null role or text is one space, also where the role is reported; a null turn comes
first and is in no gap; a null conv_id is a conversation of its own; rows of one turn go by role and
text; equal rows are duplicates; an empty role has no initial and fits nowhere; a conversation whose
rows are all dropped has zeros, an empty audit and the hash of nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlens.llm.common import small_batches

BATCH_ROWS, BATCH_BYTES = 50_000, 16 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: What each edit does: state before and after, the row's initial where it matters, cost, audit, and roles of new messages.
#: States: 0 nothing yet, 1 after the system message, 2 after user, 3 after assistant.
MOVES = [
    *((s, s, None, DELETE, "D") for s in range(4)),
    (0, 1, "s", KEEP, "K"),
    *((s, 2, "u", KEEP, "K") for s in (0, 1, 3)),
    (2, 3, "a", KEEP, "K"),
    *((s, 2, None, REROLE, "R") for s in (0, 1, 3)),
    (2, 3, None, REROLE, "R"),
    *((s, 3, "a", INSERT + KEEP, "IK") for s in (0, 1, 3)),
    (2, 2, "u", INSERT + KEEP, "IK"),
    *((s, 3, None, INSERT + REROLE, "IR") for s in (0, 1, 3)),
    (2, 2, None, INSERT + REROLE, "IR"),
]
ENDS = [(0, 0, ""), (1, 2 * INSERT, "II"), (2, INSERT, "I"), (3, 0, "")]


def _values(rows: list[tuple]) -> str:
    text = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(map(text, r))})" for r in rows)


#: The repair in DuckDB's SQL, over ``damaged`` (conv_id, turn, role, text, here: whether the row is there).
REPAIR = f"""
convs as materialized (select conv_id, row_number() over () as c from (select distinct conv_id from damaged)),
ordered as materialized (
  select c, turn, role, text, role[1] as initial, row_number() over (partition by c order by turn nulls first, role, text) as pos
  from damaged d join convs v on d.conv_id is not distinct from v.conv_id where here),
faulty as materialized (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when row_number() over (partition by c, role, text order by pos) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' end as fault,
    coalesce(lag(initial) over w || initial not in ('su', 'ua', 'au'), false) as illegal
  from ordered window w as (partition by c order by pos)),
moves as (select * from (values {_values(MOVES)}) as m(before, after, needs, cost, audit)),
steps as materialized (
  select c, pos, before, after, m.cost + case when fault = 'truncated' and audit <> 'D' then {TRUNCATED} else 0 end as cost, audit
  from faulty f join moves m on (needs is null or needs = initial) and (audit = 'D' or fault is null or fault = 'truncated')),
paths as (
  select c, 0::bigint as pos, 0 as state, 0::bigint as cost, '' as audit from convs
  union all
  select c, pos, state, (least).cost, (least).audit from (
    select p.c, s.pos, s.after as state, min({{'cost': p.cost + s.cost, 'audit': p.audit || s.audit}}) as least
    from paths p join steps s on s.c = p.c and s.pos = p.pos + 1 and s.before = p.state group by p.c, s.pos, s.after)),
sizes as (select c, count(*) as n from faulty group by c),
best as materialized (
  select c, (least).cost as cost, (least).audit as audit from (
    select p.c, min({{'cost': p.cost + e.cost, 'audit': p.audit || e.audit}}) as least
    from paths p left join sizes using (c) join (values {_values(ENDS)}) as e(state, cost, audit) on e.state = p.state where p.pos = coalesce(n, 0) group by p.c)),
edits as materialized (
  select c, k, edit, sum((edit <> 'I')::int) over (partition by c order by k rows unbounded preceding) as pos
  from (select c, unnest(string_split(audit, '')) as edit, unnest(range(1, length(audit) + 1)) as k from best where audit <> '')),
written as (
  select e.c, e.k, e.edit, f.role, case when e.edit = 'I' then '' else f.text end as text, count(*) over w as nth, first_value(case when e.edit = 'K' and f.initial = 's' then 1 else 0 end) over w as system
  from edits e left join faulty f on f.c = e.c and f.pos = e.pos and e.edit <> 'I' where e.edit <> 'D'
  window w as (partition by e.c order by e.k rows unbounded preceding)),
repaired as (
  select c, string_agg(case when edit = 'K' then role when (nth - system) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by k) as body from written group by c),
counts as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (illegal) as illegal from faulty group by c)
select v.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, b.cost::bigint as cost, b.audit, """
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
FROM = " from convs v join best b using (c) left join counts using (c) left join repaired r using (c)"


def damaged(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here: rows with the test's damage; a dropped row stays as a mark of its conversation."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    row = F.struct(F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), (kind != 0).alias("here"))
    return table.select("conv_id", "turn", F.explode(F.when(kind == 3, F.array(row, row)).otherwise(F.array(row))).alias("r")).select("conv_id", "turn", "r.*")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations, from batches in which a conversation's rows follow one another."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("conv_id")
        if held and (rows >= BATCH_ROWS or size >= BATCH_BYTES):
            last = held[-1].column("conv_id")[-1]
            other = pc.fill_null(pc.not_equal(ids, last), last.is_valid) if last.is_valid else pc.is_valid(ids)
            first = pc.index(other, True).as_py()
            if first >= 0:
                yield pa.Table.from_batches([*held, batch.slice(0, first)])
                held, rows, size, batch = [], 0, 0, batch.slice(first)
        held.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as c:
        for table in _whole(batches):
            c.register("damaged", table)
            yield from c.sql("with recursive " + REPAIR + "coalesce(r.body, '') as repaired" + FROM).to_arrow_table().cast(_ARROW).to_batches(max_chunksize=1000)
            c.unregister("damaged")


_ARROW = pa.schema([*((n, pa.int64()) for n in "conv_id gaps blank duplicate truncated illegal cost".split()), ("audit", pa.string()), ("repaired", pa.string())])


def repair(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, here) to one row for each conversation: counts of faults, cost, audit and the repaired text."""
    small_batches(rows.sparkSession)
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "here")
    return own.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_repaired, RESULT)


def intact(table: DataFrame) -> DataFrame:
    """A table of conversations as it is, for :func:`repair`."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return table.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), F.lit(True).alias("here"))


def report(table: DataFrame, prepare=damaged) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    return repair(prepare(table)).withColumn("repaired", F.sha2("repaired", 256)).withColumnRenamed("repaired", "repaired_sha256")
