"""The registered queries of the engine's own operators, each beside its DuckDB SQL.

The tables hold invented prose and orders, so the operators run with lexicons, rules and patterns
that occur in them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contractlens.functions import text as tx
from contractlens.functions.scratch import Scratch
from contractlens.functions.stats import wilson
from contractlens.operators import curate, docfacts, evalstats, facts, furniture, gates, guard, index, router, rules, segment, statutes, triage, versions
from contractlens.plans import audit
from contractlens.sources import readers
from contractlens.streaming import state, stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Tables of long texts: work on a row is heavy.
TEXTS = ("documents", "pages")
#: A session's setting: into how many parts tables of texts are dealt after reading.
TEXT_PARTS = "spark.contractlens.textPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies; how it is cut is for the reader's split size.

    A file of one row group can't be split by the reader; a session that reads such files on many
    cores may set TEXT_PARTS, and tables of texts are then dealt out.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get(TEXT_PARTS, None)
    return df.repartition(int(parts)) if parts and name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """Short rows of heavy work, dealt out over the cores: the given file may be one row group, and so one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = r"""
lines as (
  select doc_id, i as line_no, l as line, trim(regexp_replace(l, '\s+', ' ', 'g')) as norm
  from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as i from documents)),
keyed as (
  select *, regexp_matches(norm, '(?i)(@|www\.|http|\+\d{2}[\s-]|\bCIN\b|\bGST\b|\bpage\s+\d|\bpvt\.?\s*ltd\b|\bprivate\s+limited\b|\bcorporate\s+office\b|\bregd\.?\s*office\b)') as contact from lines),
keys as (
  select *, case when contact or regexp_matches(norm, '(?i)(confidential|\bpage\b|all\s+rights\s+reserved|©|copyright\s+\d{4}|for\s+software\s+testing|not\s+a\s+real\s+contract)')
      then regexp_replace(norm, '\d+', '#', 'g') else norm end as key,
    length(norm) >= 6 and ((length(norm) <= 120 and len(list_filter(string_split(norm, ' '), lambda w: w <> '')) <= 16) or contact) as counted from keyed),
repeated as (select *, sum(counted::int) over (partition by doc_id, key) as repeats from keys)"""


@query("with" + _LINES + "\nselect doc_id, count(*) as n_lines, sum((repeats < 2)::int)::bigint as n_kept, sha1(coalesce(string_agg(line, chr(10) order by line_no) filter (where repeats < 2), '')) as clean_sha1 from repeated group by doc_id")
def strip_repeating_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", furniture.strip_repeating_lines(F.col("text")).alias("clean"))
    kept = F.when(F.col("clean") == "", F.size(F.filter(F.split("text", "\n"), lambda x: x == ""))).otherwise(F.size(F.split("clean", "\n")))
    return docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), kept.cast("long").alias("n_kept"), F.sha1(F.col("clean").cast("binary")).alias("clean_sha1"))


@query("with" + _LINES + "\nselect doc_id, key, count(*) as n, max(repeats)::bigint as repeats from repeated where counted group by doc_id, key having max(repeats) >= 2")
def digit_masked_line_keys(spark, sf_dir):
    own = furniture.repeated_lines(lines_of(table(spark, sf_dir, "documents")))
    return own.where(furniture.counted(tx.squeeze(F.col("line"))) & (F.col("repeats") >= 2)).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max("repeats").alias("repeats"))


@query("""
with blocks as (select doc_id, i as k, l as block from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as i from documents)),
opened as (select *, case when row_number() over (partition by doc_id order by k) = 1 or length(block) >= 55 then 1 else 0 end as o from blocks),
numbered as (select *, sum(o) over (partition by doc_id order by k) as island from opened)
select doc_id, island::bigint as island, length(string_agg(block, chr(10) order by k))::bigint as n_chars from numbered group by doc_id, island""")
def tidy_islands(spark, sf_dir):
    blocks = lines_of(table(spark, sf_dir, "documents")).withColumnsRenamed({"line_no": "block_no", "line": "block"})
    return segment.tidy_islands(blocks).select("doc_id", F.col("island").cast("long").alias("island"), F.col("n_chars").cast("long").alias("n_chars"))


_PIECES = r"""
pieces as (
  select doc_id, 'line' as split, 1 as rank, unnest(string_split(text, chr(10))) as block from documents
  union all select doc_id, 'sentence', 2, unnest(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.;])\s+', '\1' || chr(1), 'g'), chr(1))) from documents
  union all select doc_id, 'whole', 3, text from documents)"""


@query("with" + _PIECES + """,
sums as (
  select p.doc_id, split, rank, count(*) as n, sum(length(block)) as kept, sum((length(block) between 80 and 3000)::int) as good, sum((length(block) > 4500)::int) as huge, any_value(length(d.text)) as total
  from pieces p join documents d using (doc_id) group by p.doc_id, split, rank),
scored as (select *, case when total = 0 or kept / total < 0.45 then -1.0 else round((good - 2 * huge + 0.15 * n) * (kept / total)::double, 4) end as score from sums)
select doc_id, split, n as n_blocks, score::double as score, row_number() over (partition by doc_id order by score desc, rank) = 1 as best from scored""")
def split_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kinds = F.array(
        F.struct(F.lit("line").alias("split"), F.lit(1).alias("rank"), F.split("text", "\n").alias("blocks")),
        F.struct(F.lit("sentence").alias("split"), F.lit(2).alias("rank"), tx.sentences(F.col("text"), "").alias("blocks")),
        F.struct(F.lit("whole").alias("split"), F.lit(3).alias("rank"), F.array("text").alias("blocks")),
    )
    blocks = docs.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.split", "k.rank", F.explode("k.blocks").alias("block"))
    return segment.split_scores(blocks, docs.select("doc_id", F.length("text").alias("total")))


@query("select doc_id, doc_id || '::000::' || substr(sha1(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')), 1, 8) as clause_id from documents")
def clause_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clause_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("clause_id"))


@query()
def hard_cut_3000(spark, sf_dir):
    """Pieces of whole texts packed from sentences, over Arrow batches."""

    def cut(batches):
        for b in batches:
            sizes = [[len(p) for p in segment.hard_cut(t or "")] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sizes], pa.int32()), pa.array([max(s) for s in sizes], pa.int32())], ["doc_id", "n_pieces", "longest"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(cut, "doc_id long, n_pieces int, longest int")


@query()
def segmented_clauses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("employment").alias("doc_type"), "text")
    return segment.segment(docs).select("clause_id", "doc_id", "order", "heading", "char_start", "char_end", "split_by")


@query()
def repaired_lines(spark, sf_dir):
    fixed = readers.repaired_lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(fixed, "\n")).alias("n_lines"), F.sha1(fixed.cast("binary")).alias("text_sha1"))


@query(r"""
with s as (select doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.;])\s+', '\1' || chr(1), 'g'), chr(1)) as s from documents),
w as (select doc_id, unnest(range(0, greatest(len(s), 1), 2)) as start, len(s) as n, s from s),
c as (select doc_id, start, start + 4 >= n as last, array_to_string(s[start + 1:start + 4], ' ') as chunk from w),
k as (select *, coalesce(max(last::int) over (partition by doc_id order by start rows between unbounded preceding and 1 preceding), 0) as over from c where length(chunk) >= 80)
select doc_id as corpus_id, start::int as start, sha1(chunk) as chunk_sha1 from k where over = 0""".replace(" as over ", " as ended ").replace("where over = 0", "where ended = 0"))
def sentence_windows(spark, sf_dir):
    acts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("corpus_id"), "text")
    return statutes.chunks(acts, "").select("corpus_id", "start", F.sha1(F.col("chunk").cast("binary")).alias("chunk_sha1"))


@query("""
with p as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
post as (select doc_id, len(t) as size, unnest(t) as term from p), tf as (select doc_id, size, term, count(*) as tf from post group by all),
df as (select term, count(*) as df from tf group by term), tot as (select count(*) as n, avg(len(t)) as mean from p),
asked as (select item_id as query_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark) group by all),
scored as (
  select query_id, doc_id, list_reduce(list_prepend(0.0::double, list(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * size / mean))) order by term)), lambda a, b: a + b) as raw
  from tf join asked using (term) join df using (term) cross join tot group by query_id, doc_id)
select query_id, doc_id, round(raw, 3) as score, rank from (select *, row_number() over (partition by query_id order by raw desc, doc_id)::int as rank from scored) where rank <= 5""")
def bm25_topk(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return statutes.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), asked, "doc_id", "text", k=5)


@query()
def stored_index_topk(spark, sf_dir):
    """The same search over stored postings: the documents are indexed with every seventh text cut short, and those are put right by a second generation."""
    scratch = Scratch(spark, "index")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("owner"), "text")
    index.write(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.left("text", F.lit(40))).otherwise(F.col("text"))), scratch.root)
    index.update(spark, docs.where("doc_id % 7 = 0"), scratch.root)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.Terms(spark, scratch.root).search(asked, 5).withColumnRenamed("key", "doc_id")


SQL["stored_index_topk"] = SQL["bm25_topk"]


@query(r"""
with acts as (
  select doc_id::varchar as corpus_id, string_agg(case when i % 3 = 1 then ((i // 3) % 9 + 1) || case when i % 2 = 0 then 'A. ' else '. ' end || l else l end, chr(10) order by i) as text
  from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as i from documents) group by doc_id),
lines as (select corpus_id, i as pos, l, regexp_extract(l, '(?i)^\s*(?:\d+\[\s*)?(?:section\s+)?(\d+[A-Z]{0,2})\s*[.:–—-]', 1) as section
  from (select corpus_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as i from acts)),
parts as (select *, sum((section <> '')::int) over (partition by corpus_id order by pos) as part from lines),
spans as (select corpus_id, max(section) as section, min(pos) as pos, trim(regexp_replace(string_agg(l, chr(10) order by pos), '\s+', ' ', 'g')) as span from parts where part > 0 group by corpus_id, part)
select corpus_id, upper(section) as section, span, pos::int as pos from (select *, row_number() over (partition by corpus_id, section order by length(span) desc, pos) as k from spans where length(span) >= 40) where k = 1""")
def section_spans(spark, sf_dir):
    """Documents as acts: every third line opens a section, nine numbers take turns, and of the sections of one number the longest counts."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("l"), i.alias("i")))
    numbered = F.transform(lines, lambda x: F.when(x["i"] % 3 == 1, F.concat((F.floor(x["i"] / 3) % 9 + 1).cast("string"), F.when(x["i"] % 2 == 0, F.lit("A. ")).otherwise(F.lit(". ")), x["l"])).otherwise(x["l"]))
    return statutes.sections(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("corpus_id"), F.array_join(numbered, "\n").alias("text")))


@query(r"""
with c as (
  select doc_id, case doc_id % 5 when 0 then 'norm' when 1 then 'policy' else 'statutory' end as basis, (1 + doc_id % 2)::varchar as section,
    case doc_id % 7 when 0 then null when 1 then ' ' when 2 then (1 + doc_id % 2) || '. ' || left(text, 60) else (1 + doc_id % 3) || '. ' || text end as span,
    case when doc_id % 11 = 0 then 'sunrise and sunset' else array_to_string(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')[2:5], ' ') end as anchor from documents),
n as (select *, trim(regexp_replace(coalesce(span, ''), '\s+', ' ', 'g')) as tight, trim(regexp_replace(lower(coalesce(span, '')), '[^a-z0-9]+', ' ', 'g')) as hay,
  list_filter(string_split(trim(regexp_replace(lower(anchor), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2) as words from c)
select doc_id, case when basis = 'norm' then null when span is null or tight = '' then 'no span'
  when not list_contains(string_split(regexp_replace(upper(left(tight, 120)), '[^A-Z0-9]+', ' ', 'g'), ' '), upper(section)) then 'wrong section'
  when length(tight) < 120 then 'heading only' when len(words) = 0 or len(list_filter(words, lambda w: not contains(hay, w))) > 0 then 'no anchor' end as reason from n""")
def verify_cascade(spark, sf_dir):
    """A citation of each document: other sections, short and empty spans, and anchors that stand there or don't."""
    k, text = F.col("doc_id"), F.col("text")
    basis = F.when(k % 5 == 0, F.lit("norm")).when(k % 5 == 1, F.lit("policy")).otherwise(F.lit("statutory"))
    span = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.lit(" ")).when(k % 7 == 2, F.concat((k % 2 + 1).cast("string"), F.lit(". "), F.left(text, F.lit(60)))).otherwise(F.concat((k % 3 + 1).cast("string"), F.lit(". "), text))
    anchor = F.when(k % 11 == 0, F.lit("sunrise and sunset")).otherwise(F.array_join(F.slice(F.split(F.regexp_replace(text, r"\s+", " "), " "), F.lit(2), F.lit(4)), " "))
    return table(spark, sf_dir, "documents").select("doc_id", statutes.reject_reason(basis, (k % 2 + 1).cast("string"), span, F.array(anchor)).alias("reason"))


#: Common words of each language, as lexicons.
LANGUAGES = {
    "en": {"strong": ["the", "and", "of", "that"], "core": ["to", "in", "is", "was", "with"]},
    "fr": {"strong": ["le", "des", "et", "une"], "core": ["de", "la", "dans", "que", "pour"]},
    "de": {"strong": ["der", "die", "und", "den"], "core": ["das", "von", "zu", "mit", "im"]},
    "es": {"strong": ["el", "los", "que", "con"], "core": ["de", "la", "en", "por", "se"]},
}
_HAY = r"""hay as (select doc_id, lang, trim(regexp_replace(regexp_replace(translate(lower(text), '’‘', ''''''), '[^\pL\pN\pM_\s''-]', ' ', 'g'), '\s+', ' ', 'g')) as hay from documents),
scores as (select doc_id, lang, case when hay = '' then 0 else len(string_split(hay, ' ')) end as words, """ + ", ".join(
    "round_even((" + " + ".join(f"{guard.WEIGHTS[k]} * regexp_matches(hay, '(^|[^\\pL\\pN\\pM_]){t}($|[^\\pL\\pN\\pM_])')::int" for k, ts in lex.items() for t in ts) + f") / {sum(guard.WEIGHTS[k] * len(ts) for k, ts in lex.items())}, 4) as {lang}"
    for lang, lex in LANGUAGES.items()
) + """ from hay),
top as (select *, greatest(en, fr, de, es) as best, case greatest(en, fr, de, es) when en then 'en' when fr then 'fr' when de then 'de' else 'es' end as slug from scores)"""


def _languages(spark, sf_dir) -> DataFrame:
    docs = tx.computed(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "hay", guard.normalised(F.col("text")))
    scored = tx.computed(docs, "scores", guard.scores(F.col("hay"), LANGUAGES))
    return tx.computed(scored, "top", guard.best_type(F.col("scores"), list(LANGUAGES)))


@query("with " + _HAY + """
select doc_id, case when words < 20 then 'too_short' when best < 0.12 then 'unrecognised' when slug <> 'en' and best >= en * 1.8 then 'mismatch' when en < 0.12 then 'unrecognised' else 'ok' end as status,
  case when words >= 20 and best >= 0.12 and slug <> 'en' and (best >= en * 1.8 or en < 0.12) then slug end as suggested, words::int as words from top""")
def lexicon_guard(spark, sf_dir):
    docs = _languages(spark, sf_dir)
    return tx.computed(docs, "v", guard.check(F.lit("en"), F.col("scores"), F.col("hay"), LANGUAGES, 20)).select("doc_id", "v.status", "v.suggested", "v.words")


@query("with " + _HAY + "\nselect lang as truth, slug as guess, count(*) as n from top where lang <> slug group by all")
def guard_confusion(spark, sf_dir):
    return evalstats.confusions(_languages(spark, sf_dir).select(F.col("lang").alias("truth"), F.col("top.slug").alias("guess")))


@query("with " + _HAY + """,
s as (select lang, count(*) as n, sum((lang = slug)::int) as hits from top group by lang)
select lang, n, hits::bigint as hits, round(greatest(0.0, least(1.0, (hits / n + 3.8416 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n))), 4) as low,
  round(greatest(0.0, least(1.0, (hits / n + 3.8416 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n))), 4) as high from s""")
def wilson_by_lang(spark, sf_dir):
    own = _languages(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == F.col("top.slug")).alias("hits"))
    return own.select("lang", "n", "hits", F.round(wilson(F.col("hits"), F.col("n")), 4).alias("low"), F.round(wilson(F.col("hits"), F.col("n"), True), 4).alias("high"))


#: Rules over order lines: every operator, escalation and the norm cap.
LINE_RULES = [
    {"id": "L-1", "category": "returns", "basis": "statutory", "severity": "medium", "when": {"l_returnflag": "R", "l_quantity": {"gt": 40}}, "source": {"act": "a"}, "escalate_to_high_when": {"l_discount": {"gte": 0.08}}, "message": "large return"},
    {"id": "L-2", "category": "price", "basis": "norm", "metric": "price", "severity": "high", "when": {"all": [{"l_extendedprice": {"gt": 60000}}, {"any": [{"l_tax": {"lt": 0.02}}, {"l_linestatus": "O"}]}]}, "message": "dear line"},
    {"id": "L-3", "category": "price", "basis": "norm", "metric": "discount", "severity": "low", "when": {"l_discount": {"lte": 0.01}}, "message": "no discount"},
    {"id": "L-4", "category": "lines", "basis": "policy", "severity": "none", "when": {"l_linenumber": {"gte": 7}}, "source": {"act": "b"}, "scope": "document", "message": "many lines"},
]
_FINDINGS = """findings as (
  select l_orderkey, l_linenumber, 'L-1' as rule_id, 0 as ord, case when l_discount >= 0.08 then 'high' else 'medium' end as severity from lineitem where l_returnflag = 'R' and l_quantity > 40
  union all select l_orderkey, l_linenumber, 'L-2', 1, 'medium' from lineitem where l_extendedprice > 60000 and (l_tax < 0.02 or l_linestatus = 'O')
  union all select l_orderkey, l_linenumber, 'L-3', 2, 'low' from lineitem where l_discount <= 0.01
  union all select l_orderkey, l_linenumber, 'L-4', 3, 'none' from lineitem where l_linenumber >= 7)"""


def _line_findings(spark, sf_dir) -> DataFrame:
    rows = rules.evaluate(table(spark, sf_dir, "lineitem"), LINE_RULES)
    return rows.select("l_orderkey", "l_linenumber", F.explode("findings").alias("f")).select("l_orderkey", "l_linenumber", "f.rule_id", "f.rule_order", "f.severity", "f.scope", "f.message")


@query("with " + _FINDINGS + "\nselect l_orderkey, l_linenumber, rule_id, severity from findings")
def rule_eval_lineitem(spark, sf_dir):
    return _line_findings(spark, sf_dir).select("l_orderkey", "l_linenumber", "rule_id", "severity")


@query("""
with r as (select l_orderkey, l_linenumber, list_sort(list_filter([
  case when l_returnflag = 'R' and l_quantity > 40 then {'w': case when l_discount >= 0.08 then -3 else -2 end, 'o': 0, 's': case when l_discount >= 0.08 then 'L-1:high' else 'L-1:medium' end} end,
  case when l_extendedprice > 60000 and (l_tax < 0.02 or l_linestatus = 'O') then {'w': -2, 'o': 1, 's': 'L-2:medium'} end,
  case when l_discount <= 0.01 then {'w': -1, 'o': 2, 's': 'L-3:low'} end, case when l_linenumber >= 7 then {'w': 0, 'o': 3, 's': 'L-4:none'} end], lambda x: x is not null)) as f from lineitem)
select l_orderkey, l_linenumber, array_to_string(list_transform(f, lambda x: x.s), ',') as findings from r where len(f) > 0""")
def rule_order(spark, sf_dir):
    rows = rules.evaluate(table(spark, sf_dir, "lineitem"), LINE_RULES).where(F.size("findings") > 0)
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.transform("findings", lambda f: F.concat(f["rule_id"], F.lit(":"), f["severity"])), ",").alias("findings"))


ORDER_RULES = [
    {"id": "O-1", "category": "c", "basis": "statutory", "severity": "high", "when": {"any": [{"o_orderpriority": "1-URGENT"}, {"o_totalprice": {"gte": 400000}}]}, "source": {"act": "a"}, "message": "urgent"},
    {"id": "O-2", "category": "c", "basis": "policy", "severity": "low", "when": {"o_orderstatus": "O", "o_totalprice": {"lt": 20000}}, "source": {"act": "a"}, "message": "small"},
]


@query("""select rule_id, severity, count(*) as n from (select 'O-1' as rule_id, 'high' as severity from orders where o_orderpriority = '1-URGENT' or o_totalprice >= 400000
  union all select 'O-2', 'low' from orders where o_orderstatus = 'O' and o_totalprice < 20000) group by all""")
def rule_eval_orders(spark, sf_dir):
    rows = rules.evaluate(table(spark, sf_dir, "orders"), ORDER_RULES)
    return rows.select(F.explode("findings").alias("f")).groupBy("f.rule_id", "f.severity").agg(F.count(F.lit(1)).alias("n"))


@query("select c.c_custkey, (o.o_orderkey is null) as silent, coalesce(o.n > 12, false) as busy from customer c left join (select o_custkey, min(o_orderkey) as o_orderkey, count(*) as n from orders group by o_custkey) o on c.c_custkey = o.o_custkey")
def rule_absent(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", rules.compile_tree({"first_order": {"absent": True}}, F.col).alias("silent"), rules.compile_tree({"n": {"gt": 12}}, F.col).alias("busy"))


_PERCENTILES = """ranked as (select o_orderpriority as field, o_totalprice as value, row_number() over (partition by o_orderpriority order by o_totalprice) as k, count(*) over (partition by o_orderpriority) as n from orders where o_totalprice is not null),
norms as (select field, max(n) as n, median(value) as median, max(case when k = least(floor(n * 0.75), n - 1) + 1 then value end) as p75, max(case when k = least(floor(n * 0.9), n - 1) + 1 then value end) as p90, min(value) as min, max(value) as max from ranked where n >= 8 group by field)"""


def _price_norms(spark, sf_dir) -> DataFrame:
    return curate.norms_numeric(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("field"), F.col("o_totalprice").alias("value")))


@query("with " + _PERCENTILES + "\nselect field, n, round(median, 4) as median, p75, p90, min, max from norms")
def norms_numeric(spark, sf_dir):
    return _price_norms(spark, sf_dir).withColumn("median", F.round("median", 4))


@query("with " + _PERCENTILES + "\nselect o_orderkey, o_totalprice > p90 as dear from orders join norms on o_orderpriority = field")
def rule_percentile(spark, sf_dir):
    norms = curate.norms_map(_price_norms(spark, sf_dir).select("field", "p75", "p90").toPandas())  # a row for each priority
    own = {p: rules.compile_tree({"o_totalprice": {"gt_percentile": 90}}, F.col, p, norms) for p in sorted(norms)}
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(list(own)))
    return orders.select("o_orderkey", F.coalesce(*(F.when(F.col("o_orderpriority") == p, c) for p, c in own.items())).alias("dear"))


@query("select 'quality' as field, count(*) as n, round_even(avg(quality), 3) as true_rate from labels where quality is not null union all select 'toxic', count(*), round_even(avg(toxic), 3) from labels where toxic is not null")
def norms_boolean(spark, sf_dir):
    both = table(spark, sf_dir, "labels").select(F.explode(F.create_map(F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic"))).alias("field", "v"))
    return curate.norms_boolean(both.select("field", (F.col("v") == 1).alias("value")))


@query("""select l_orderkey, case when l_discount >= 0.08 then 'high' else 'medium' end as cap_or_high, case when l_discount >= 0.08 and l_tax > 0.04 then 'high' else 'medium' end as both_needed from lineitem where l_returnflag = 'R'""")
def rule_escalation_cap(spark, sf_dir):
    rule = {"id": "E", "basis": "norm", "severity": "high", "when": {}, "escalate_to_high_when": {"l_discount": {"gte": 0.08}}}
    both = rule | {"escalate_to_high_when": {"all": [{"l_discount": {"gte": 0.08}}, {"l_tax": {"gt": 0.04}}]}}
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", rules.severity(rule, F.col).alias("cap_or_high"), rules.severity(both, F.col).alias("both_needed"))


@query("with " + _FINDINGS + "\nselect coalesce(rule_id, 'all') as rule_id, coalesce(severity, 'all') as severity, count(*) as n from findings group by rollup(rule_id, severity)")
def findings_rollup(spark, sf_dir):
    out = _line_findings(spark, sf_dir).rollup("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("rule_id", F.lit("all")).alias("rule_id"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")


@query("with " + _FINDINGS + "\nselect l_orderkey, rule_id, min(l_linenumber) as first_line from findings where rule_id = 'L-4' group by all union all select l_orderkey, rule_id, l_linenumber from findings where rule_id <> 'L-4'")
def doc_scope_dedup(spark, sf_dir):
    first = Window.partitionBy("l_orderkey", "rule_id").orderBy("l_linenumber")
    rows = _line_findings(spark, sf_dir).withColumn("k", F.row_number().over(first)).where("scope <> 'document' or k = 1")
    return rows.select("l_orderkey", "rule_id", F.col("l_linenumber").alias("first_line"))


@query("with " + _FINDINGS + """
select l_orderkey as doc_id, count(*) as findings, sum((severity = 'high')::int)::bigint as high, sum(case severity when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end)::bigint as score, string_agg(distinct rule_id, ',' order by rule_id) as rules
from findings group by l_orderkey order by score desc, findings desc, doc_id limit 50""")
def scan_rank_topk(spark, sf_dir):
    scored = evalstats.document_scores(_line_findings(spark, sf_dir).withColumnRenamed("l_orderkey", "doc_id"))
    return scored.orderBy(F.desc("score"), F.desc("findings"), "doc_id").limit(50)


@query("with " + _FINDINGS + """,
e as (select l_orderkey as doc_id, rule_id, severity, l_linenumber as ord, 'line ' || l_linenumber as heading, l_shipmode as evidence from (select f.*, case l_linenumber % 2 when 0 then 'Even  line' else 'odd line' end as l_shipmode from findings f)),
n as (select *, lower(regexp_replace(evidence, '\\s+', ' ', 'g')) as key, row_number() over (partition by doc_id, rule_id, lower(regexp_replace(evidence, '\\s+', ' ', 'g')) order by ord) as k from e)
select doc_id, rule_id, arg_min(severity, case severity when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end) as severity,
  string_agg(evidence, ' / ' order by ord) filter (where k = 1) as evidence, string_agg(heading, ' / ' order by ord) as places from n group by doc_id, rule_id""")
def issue_grouping(spark, sf_dir):
    said = F.when(F.col("l_linenumber") % 2 == 0, F.lit("Even  line")).otherwise(F.lit("odd line"))
    rows = _line_findings(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), "rule_id", "severity", F.col("l_linenumber").alias("ord"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("heading"), said.alias("evidence"))
    return evalstats.issues(rows)


@query("with " + _FINDINGS + "\nselect rule_id, count(*) as n from findings group by rule_id union all select * from (values ('L-9', 0)) where not exists (select 1 from findings where rule_id = 'L-9')")
def rule_census(spark, sf_dir):
    known = spark.createDataFrame([(r["id"],) for r in LINE_RULES] + [("L-9",)], "rule_id string")
    fired = _line_findings(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    never = known.join(fired, "rule_id", "left_anti").select("rule_id", F.lit(0).cast("long").alias("n"))
    return fired.unionByName(never)


@query("select doc_id, (regexp_matches(text, '(?i)deposit|advance|caution\\s+money|security')) as deposit_months, regexp_matches(text, '(?i)insur|policy|cover|premium') as insurance, regexp_matches(text, '(?i)assign|transfer|securitis|securitiz|novat|sell\\s+the\\s+loan') and regexp_matches(text, '(?i)\\bright|\\bloan\\b|agreement|receivable|transferee|assignee|securitis|securitiz|participation') as assignment, regexp_matches(text, '(?i)licen[cs]e') as license from documents")
def topic_gate(spark, sf_dir):
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", gates.passes("deposit_months", x).alias("deposit_months"), gates.passes("insurance_mandatory_named_insurer", x).alias("insurance"), gates.passes("assignment_without_notice", x).alias("assignment"), tx.matches(x, "licen[cs]e").alias("license"))


@query(r"select doc_id, trim(regexp_replace(regexp_extract(text, '(?is)\S*?(?:licen[cs]e)\S*'), '\s+', ' ', 'g')) as evidence from documents where regexp_matches(text, '(?i)licen[cs]e')")
def evidence_span(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.evidence(F.col("text"), "licen[cs]e").alias("evidence")).where("evidence is not null")


_DAYS = [d.capitalize() for d in facts.DAYS]
_NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
_K = "o_orderkey % 7 as i, (o_orderkey // 7) % 7 as j, 6 + o_orderkey % 6 as h1, 30 * (o_orderkey % 2) as m1, 1 + (o_orderkey // 5) % 8 as h2, 30 * ((o_orderkey // 3) % 2) as m2, o_orderkey % 4 as way"


def _item(words: list[str], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), place.cast("int") + 1)


@query(f"""with k as (select o_orderkey, {_K} from orders),
t as (select o_orderkey, ((j - i) % 7 + 7) % 7 + 1 as days, case way when 0 then ((h2 + 12) * 60 + m2 - h1 * 60 - m1) / 60 when 1 then (case when h2 < h1 then h2 + 12 else h2 end * 60 + m2 - h1 * 60 - m1) / 60 when 2 then (h1 * 60 + m2 - m1) / 60 end as hours from k),
g as (select o_orderkey, days, case when hours > 0 and hours <= 16 then days * hours end as gross from t)
select o_orderkey, gross::double as gross, case when gross / days > 5 then gross - days else gross end::double as net from g""")
def weekly_hours(spark, sf_dir):
    """Working times written out for each order: with and without am and pm, from midnight, and with none."""
    k, pad = F.col("o_orderkey"), lambda n: F.lpad(n.cast("string"), 2, "0")
    at = lambda n, m: (F.call_function("div", k, F.lit(n)) % m)
    days = F.concat(_item(_DAYS, k % 7), F.lit(" to "), _item(_DAYS, at(7, 7)), F.lit(", "))
    h1, m1, h2, m2 = (k % 6 + 6).cast("string"), pad(k % 2 * 30), (at(5, 8) + 1).cast("string"), pad(at(3, 2) * 30)
    said = [F.concat(h1, F.lit(":"), m1, F.lit(" AM - "), h2, F.lit(":"), m2, F.lit(" PM")), F.concat(h1, F.lit("."), m1, F.lit(" to "), h2, F.lit("."), m2), F.concat(F.lit("12:"), m1, F.lit(" am to "), h1, F.lit(":"), m2), F.lit("by arrangement")]
    text = F.concat(F.lit("The office is open "), days, F.get(F.array(*said), (k % 4).cast("int")))
    return table(spark, sf_dir, "orders").select(k, facts.weekly(text).alias("w")).select("o_orderkey", F.col("w.gross").alias("gross"), F.col("w.net").alias("net"))


@query("""with k as (select o_orderkey, o_orderkey % 7 as way, 1 + o_orderkey % 60 as n, 1 + o_orderkey % 12 as w from orders)
select o_orderkey, case way when 0 then n when 1 then 12 * w when 2 then n end::double as term, case way when 3 then w when 4 then w end::double as deposit from k""")
def term_and_deposit_months(spark, sf_dir):
    """A term or a deposit written out for each order: in digits, in words, as an adjective, as two sums of money, twice with different numbers, and not at all."""
    k = F.col("o_orderkey")
    n, word, sum_ = (k % 60 + 1).cast("string"), _item(_NUMBER_WORDS, k % 12), (k % 20 + 1) * 1000
    said = [
        F.concat(F.lit("It runs for a period of "), n, F.lit(" months from the first day.")), F.concat(F.lit("It has a term of "), word, F.lit(" years.")), F.concat(F.lit("This is a "), n, F.lit("-month lease of the house.")),
        F.concat(F.lit("There is a deposit equal to "), word, F.lit(" months' rent.")), F.concat(F.lit("There is a security deposit of Rs. "), F.format_number(sum_ * (k % 12 + 1), 0), F.lit(" and a monthly rent of Rs. "), F.format_number(sum_, 0), F.lit(".")),
        F.concat(F.lit("A deposit of "), word, F.lit(" months rent is due.\nOr else a deposit of eighteen months rent.")), F.lit("Nothing is said."),
    ]
    text = F.get(F.array(*said), (k % 7).cast("int"))
    return table(spark, sf_dir, "orders").select(k, docfacts.term_months(text).alias("term"), docfacts.deposit_months(text).alias("deposit"))


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_RISKY, _INERT = ["the the", "ing", "tion", "license", "!!", "de la"], [" | ", "%%%", "table", "und"]


@query(f"""with c as (select doc_id, lower(text) as low, length(text) as n, len(list_filter({_list(_RISKY)}, lambda w: contains(lower(text), w))) as n_risk, len(list_filter({_list(_INERT)}, lambda w: contains(lower(text), w))) as n_inert,
  len(list_filter({_list(triage.SAFETY[:6])}, lambda w: contains(lower(text), w))) > 0 as safe from documents)
select doc_id, n_risk::int as n_risk, n_inert::int as n_inert, case when safe then 'safety' when n_inert >= 2 and n_risk <= 1 then 'boilerplate' when n_risk >= 1 then 'risk' when n_inert > 0 then 'inert' when n < 150 then 'short' else 'unclear' end as reason from c""")
def triage_markers(spark, sf_dir):
    got = tx.computed(table(spark, sf_dir, "documents").select("doc_id", "text"), "t", triage.decide(F.col("text"), triage.SAFETY[:6], _INERT, _RISKY))
    return got.select("doc_id", "t.n_risk", "t.n_inert", "t.reason")


@query(f"""select doc_id, case when i >= 2 and s = 0 then 0 when s >= 1 or w >= 5 then 1 else 0 end as label from (select doc_id, len(list_filter({_list(_RISKY[3:])}, lambda x: contains(lower(text), x))) as s,
  len(list_filter({_list(_RISKY + _INERT)}, lambda x: contains(lower(text), x))) as w, len(list_filter({_list(_INERT)}, lambda x: contains(lower(text), x))) as i from documents)""")
def router_weak_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", router.weak_label(F.col("text"), _RISKY[3:], _RISKY + _INERT, _INERT).alias("label"))


@query(r"""
with w as (select item_id, regexp_extract_all(lower(text), '\w{2,}') as w from benchmark),
t as (select item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from w),
c as (select item_id, term, count(*) as tf from t group by all), df as (select term, count(*) as df from c group by term having count(*) >= 2), n as (select count(*) as n from benchmark),
r as (select item_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as raw from c join df using (term) cross join n)
select item_id, term, round(raw / sqrt(sum(raw * raw) over (partition by item_id)), 6) as weight from r""")
def router_tfidf(spark, sf_dir):
    return router.tfidf(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("weight", F.round("weight", 6))


@query()
def router_lr(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label")), "doc_id")
    fitted, swept = router.train(docs.select("doc_id", "text", "label"), "doc_id")
    return swept


_SCORED = "scored as (select l.quality as label, (d.doc_id * 37 % 101) / 101.0 as p from labels l join documents d using (doc_id))"


@query("with " + _SCORED + ", t as (select unnest(range(20, 85, 5)) / 100.0 as threshold), s as (select threshold, count(*) as n, sum(label) as pos, sum((p >= threshold)::int) as kept, sum(((p >= threshold) and label = 1)::int) as hits from t cross join scored group by threshold)\nselect threshold::double as threshold, kept::bigint as kept, round(coalesce(hits / nullif(kept, 0), 0), 4) as precision, round(coalesce(hits / nullif(pos, 0), 0), 4) as recall, round(coalesce(2 * hits / nullif(kept + pos, 0), 0), 4) as f1, round(kept / n, 4) as keep_rate from s")
def threshold_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return evalstats.sweep(rows.select(F.col("quality").alias("label"), (F.col("doc_id") * 37 % 101 / 101.0).alias("p")))


_DIGESTS = r"digests as (select distinct doc_id, sha1(lower(trim(regexp_replace(l, '\s+', ' ', 'g')))) as digest from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) where length(l) >= 20)"


def _digests(spark, sf_dir) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents")).where(F.length("line") >= 20).select("doc_id", F.col("line_no").alias("piece_no"), tx.text_digest(F.col("line")).alias("digest"))


@query("with " + _DIGESTS + """,
sets as (select doc_id, string_agg(digest, ',' order by digest) as s from digests group by doc_id), lead as (select s, min(doc_id) as doc_id from sets group by s),
own as (select d.* from digests d join lead using (doc_id)), sizes as (select doc_id, count(*) as n from own group by doc_id),
e as (select x.doc_id as a, y.doc_id as b, count(*) as shared from own x join own y on x.digest = y.digest and x.doc_id < y.doc_id group by all)
select a, b, shared, round(shared / least(p.n, q.n), 4) as overlap from e join sizes p on p.doc_id = a join sizes q on q.doc_id = b where shared / least(p.n, q.n) >= 0.85""")
def near_dup_edges(spark, sf_dir):
    return curate.containment(_digests(spark, sf_dir).select("doc_id", "digest"), curate.NEAR).withColumn("overlap", F.round("overlap", 4))


@query()
def near_dup_greedy(spark, sf_dir):
    """Documents kept by the greedy rule; copies of a digest set follow their leader."""
    scratch = Scratch(spark, "greedy")
    pieces = scratch.table(_digests(spark, sf_dir).select("doc_id", "digest").distinct(), "pieces")  # read twice, as the sets are
    edges = curate.containment(pieces, curate.NEAR).select("a", "b")
    sets = scratch.table(curate.same_sets(pieces), "sets")
    leaders = curate.kept_documents(edges, sets.where("doc_id = leader"))
    state = leaders.select(F.col("doc_id").alias("leader"), "kept", "match")
    return sets.join(state, "leader").select("doc_id", (F.col("kept") & (F.col("doc_id") == F.col("leader"))).alias("kept"), F.when(F.col("doc_id") != F.col("leader"), F.col("leader")).otherwise(F.col("match")).alias("match"))


@query("with " + _DIGESTS + ", s as (select doc_id, string_agg(digest, ',' order by digest) as s from digests group by doc_id)\nselect doc_id, min(doc_id) over (partition by s) as leader from s")
def identical_documents(spark, sf_dir):
    return curate.same_sets(_digests(spark, sf_dir).select("doc_id", "digest"))


@query(r"""with d as (select doc_id, i as piece_no, sha1(lower(trim(regexp_replace(l, '\s+', ' ', 'g')))) as digest from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as i from documents) where length(l) >= 20)
select doc_id, piece_no::int as piece_no, row_number() over (partition by digest order by doc_id, piece_no) = 1 as first from d""")
def duplicate_clauses(spark, sf_dir):
    return curate.first_of_digest(_digests(spark, sf_dir)).select("doc_id", "piece_no", "first")


@query("select doc_id, source, round::int as round from (select *, row_number() over (partition by lang order by md5(doc_id::varchar)) as round from documents) order by round, lang limit 40")
def round_robin_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return curate.round_robin(docs, 40, "lang", F.md5(F.col("doc_id").cast("string").cast("binary"))).select("doc_id", "source", "round")


@query("select doc_id, case when row_number() over (partition by lang order by md5(doc_id::varchar)) <= greatest(1, floor(count(*) over (partition by lang) * 0.35)) then 'test' else 'dev' end as split from documents")
def blind_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return curate.blind_split(docs, "lang", F.md5(F.col("doc_id").cast("string").cast("binary"))).select("doc_id", "split")


@query("""with r as (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n from documents),
k as (select unnest(range(10)) as k) select distinct doc_id, lang from r left join k on floor(k * n / 10) = i where n <= 10 or k is not null""")
def even_spread(spark, sf_dir):
    return curate.even_spread(table(spark, sf_dir, "documents").select("doc_id", "lang"), 10, "lang", "doc_id")


@query("select count(*) as documents, min(n) as least, max(n) as most from (select o_custkey, count(*) as n from orders group by o_custkey)")
def queue_spread(spark, sf_dir):
    return curate.queue_spread(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")))


@query("select doc_id from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def label_orphans(spark, sf_dir):
    return readers.pending(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id").select("doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def pending_labels(spark, sf_dir):
    return readers.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("select 'quality' as field, quality as value, count(*) as n, round(count(*) / sum(count(*)) over (), 4) as share from labels group by quality")
def label_balance(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(F.lit("quality").alias("field"), "value", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))  # total is one row


_DRAFTS = r"""pieces as (select doc_id, i::int as idx, l as text from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as i from documents)),
old as (select *, sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as hash from pieces where idx % 5 <> 4),
new as (select doc_id, idx, text, sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as hash from (select doc_id, idx, case when idx % 3 = 2 then text || ' changed' else text end as text from pieces where idx % 7 <> 6)),
o as (select *, row_number() over (partition by doc_id, hash order by idx) as k from old), n as (select *, row_number() over (partition by doc_id, hash order by idx) as k from new)"""


def _drafts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pieces = lines_of(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").alias("idx"), F.lit(None).cast("string").alias("heading"), F.col("line").alias("text"))
    changed = F.when(F.col("idx") % 3 == 2, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return pieces.where("idx % 5 <> 4"), pieces.where("idx % 7 <> 6").withColumn("text", changed)


@query("with " + _DRAFTS + "\nselect o.doc_id, o.idx as old_idx, n.idx as new_idx from o join n using (doc_id, hash, k)")
def draft_diff_exact(spark, sf_dir):
    old, new = _drafts(spark, sf_dir)
    return versions.exact_pairs(versions.prepared(old), versions.prepared(new))


@query("with " + _DRAFTS + """,
pairs as (select coalesce(o.doc_id, n.doc_id) as doc_id, o.idx as old_idx, n.idx as new_idx, o.text as old_text, n.text as new_text from o full join n on o.doc_id = n.doc_id and o.hash = n.hash and o.k = n.k),
f as (select *, coalesce(length(old_text) > 100, false) as b, coalesce(length(new_text) > 108, false) as a from pairs)
select doc_id, sum((not b and a)::int)::bigint as new, 0::bigint as reworded, sum((b and a)::int)::bigint as persisted, sum((b and not a and new_idx is not null)::int)::bigint as vanished, sum((b and not a and new_idx is null)::int)::bigint as resolved from f where a or b group by doc_id""")
def draft_diff_status(spark, sf_dir):
    scratch = Scratch(spark, "drafts")
    digests = lambda df, name: scratch.table(df.select("doc_id", "idx", tx.text_digest(F.col("text")).alias("hash"), F.length("text").alias("n_chars")), name)
    old, new = map(digests, _drafts(spark, sf_dir), ("old", "new"))  # each is read several times below
    exact = versions.exact_pairs(old, new)
    lone = lambda df, name: df.select("doc_id", F.col("idx").alias(name)).join(exact, ["doc_id", name], "left_anti")
    pairs = exact.withColumn("similarity", F.lit(1.0)).unionByName(lone(old, "old_idx"), allowMissingColumns=True).unionByName(lone(new, "new_idx"), allowMissingColumns=True)
    found = lambda df, n: df.where(F.col("n_chars") > n).select("doc_id", "idx", F.lit("R").alias("rule_id"), F.lit("low").alias("severity"))
    return versions.summary(versions.diff(pairs, old, new, found(old, 100), found(new, 108)))


def _headed(df: DataFrame, side: str) -> DataFrame:
    """A draft's lines, every fourth with a heading: a number, which the drafts count differently, and the line's first words; every eighth has a word more in the new draft."""
    plain = F.regexp_replace("text", " changed$", "") if side == "new" else F.col("text")
    more = F.when(F.col("idx") % 8 == 4, F.lit(" again")).otherwise(F.lit("")) if side == "new" else F.lit("")
    heading = F.concat((F.col("idx") + (3 if side == "new" else 1)).cast("string"), F.lit(". "), F.array_join(F.slice(F.split(plain, " "), F.lit(1), F.lit(3)), " "), more)
    return df.withColumn("heading", F.when(F.col("idx") % 4 == 0, heading))


@query("with recursive " + _DRAFTS + r""",
exact as (select o.doc_id, o.idx as old_idx, n.idx as new_idx from o join n using (doc_id, hash, k)),
left_over as (
  select false as side, doc_id, idx, text, case when idx % 4 = 0 then (idx + 1) || '. ' || array_to_string(string_split(text, ' ')[1:3], ' ') end as heading from old anti join (select doc_id, old_idx as idx from exact) using (doc_id, idx)
  union all select true, doc_id, idx, text, case when idx % 4 = 0 then (idx + 3) || '. ' || array_to_string(string_split(regexp_replace(text, ' changed$', ''), ' ')[1:3], ' ') || case when idx % 8 = 4 then ' again' else '' end end from new anti join (select doc_id, new_idx as idx from exact) using (doc_id, idx)),
words as (select *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) as t, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(heading, '')), '^[\s\d.()ivxlc]*[\s.):]', ' '), '[^a-z]+', ' ', 'g')), ' '), lambda x: length(x) >= 2) as w from left_over),
keyed as materialized (select side, doc_id, idx, t, list_distinct(case when len(list_filter(w, lambda x: length(x) > 2)) > 0 then list_filter(w, lambda x: length(x) > 2) else w end) as h from words),
pairs as (
  select a.doc_id, a.idx as old_idx, b.idx as new_idx, case when len(a.h) = 0 or len(b.h) = 0 then 0 else len(list_intersect(a.h, b.h)) / len(list_distinct(list_concat(a.h, b.h))) end as heading,
    case when len(a.t) = 0 or len(b.t) = 0 then 0 else len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) end as body
  from keyed a join keyed b on a.doc_id = b.doc_id and not a.side and b.side),
ways as (
  select doc_id, 0 as pass, old_idx, new_idx, heading as worth, body from pairs where heading >= 0.7
  union all select doc_id, 1, old_idx, new_idx, body, body from pairs where body >= 0.4),
steps as materialized (
  select *, row_number() over (partition by doc_id order by pass, old_idx) as step
  from (select doc_id, pass, old_idx, list({'new_idx': new_idx, 'body': body} order by worth desc, new_idx) as ways from ways group by all)),
taken as (
  select doc_id, 0::bigint as step, []::int[] as olds, []::int[] as news, null::int as old_idx, null::struct(new_idx int, body double) as pick from (select distinct doc_id from steps)
  union all
  select doc_id, step, case when pick is null then olds else list_append(olds, old_idx) end, case when pick is null then news else list_append(news, pick.new_idx) end, old_idx, pick
  from (
    select s.doc_id, s.step, g.olds, g.news, s.old_idx, case when not list_contains(g.olds, s.old_idx) then list_filter(s.ways, lambda x: not list_contains(g.news, x.new_idx))[1] end as pick
    from taken g join steps s on s.doc_id = g.doc_id and s.step = g.step + 1)),
met as (select doc_id, old_idx, new_idx, 1.0::double as similarity from exact union all select doc_id, old_idx, pick.new_idx, round_even(pick.body, 3) from taken where pick is not null)
select * from met
union all select doc_id, idx, null, null from old anti join (select doc_id, old_idx as idx from met) using (doc_id, idx)
union all select doc_id, null, idx, null from new anti join (select doc_id, new_idx as idx from met) using (doc_id, idx)""")
def draft_diff_fuzzy(spark, sf_dir):
    old, new = _drafts(spark, sf_dir)
    return versions.match_clauses(_headed(old, "old"), _headed(new, "new"))


@query("""with t as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) as t from conversations)
select a.conv_id, a.turn as turn_a, b.turn as turn_b, round(case when len(a.t) = 0 or len(b.t) = 0 then 0 else len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) end, 4) as jaccard from t a join t b on a.conv_id = b.conv_id and a.turn + 1 = b.turn""")
def jaccard_candidates(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.token_set(F.col("text")).alias("t"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("turn_b"), F.col("t").alias("t_b"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", F.col("turn").alias("turn_a"), "turn_b", F.round(tx.jaccard(F.col("t"), F.col("t_b")), 4).alias("jaccard"))


@query("select event_id, try_cast(props::json->>'k' as double) as k, coalesce(try_cast(props::json->>'k' as double) > 50, false) as large, (props::json->>'missing') is null as silent from events")
def params_variant(spark, sf_dir):
    v = F.try_parse_json("props")
    got = table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "double").alias("k"), F.try_variant_get(v, "$.missing", "boolean").alias("missing"))
    return got.select("event_id", "k", rules.compile_tree({"k": {"gt": 50}}, F.col).alias("large"), rules.compile_tree({"missing": {"absent": True}}, F.col).alias("silent"))


@query("select event_id, count(*) over (partition by event_type order by epoch_us(ts) range between 60000000 preceding and current row) as used from events")
def token_window_60s(spark, sf_dir):
    calls = table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    return stream.trailing_tokens(calls, "event_type", "ts", "one").select("event_id", "used")


_CALLS = "select event_type as key, epoch_us(ts) as us, 20 + event_id % 180 as tokens, row_number() over (partition by event_type order by epoch_us(ts), 20 + event_id % 180, event_id) as k from events"


@query("""with recursive calls as materialized (""" + _CALLS + """),
paced as (
  select key, 0::bigint as k, null::bigint as us, null::bigint as tokens, null::bigint as released_us, 0::bigint as used, []::struct(t bigint, n bigint)[] as w from (select distinct key from calls)
  union all
  select key, k, us, tokens, went, used, list_append(list_filter(w, lambda x: went - x.t < 7200000000), {'t': went, 'n': tokens}) from (
    select *, coalesce(list_sum(list_transform(list_filter(w, lambda x: went - x.t < 7200000000), lambda x: x.n)), 0)::bigint as used from (
      select key, k, us, tokens, w, list_filter(list_prepend(soonest, list_transform(list_filter(w, lambda x: soonest - x.t < 7200000000), lambda x: x.t + 7200000000)),
        lambda a: coalesce(list_sum(list_transform(list_filter(w, lambda x: a - x.t < 7200000000), lambda x: x.n)), 0) in (0) or coalesce(list_sum(list_transform(list_filter(w, lambda x: a - x.t < 7200000000), lambda x: x.n)), 0) + tokens <= 500)[1] as went
      from (select c.key, c.k, c.us, c.tokens, p.w, greatest(c.us, coalesce(p.released_us + 600000000, c.us)) as soonest from paced p join calls c on c.key = p.key and c.k = p.k + 1))))
select key, us, tokens, released_us, used from paced where k > 0""")
def paced_calls(spark, sf_dir):
    """The events replayed as a stream of calls: a gap of ten minutes, and 500 tokens in two hours."""
    scratch = Scratch(spark, "paced")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), stream.micros("ts").alias("us"), (F.col("event_id") % 180 + 20).cast("long").alias("tokens"))
    held = scratch.table(events, "calls")  # a stream reads a folder of files
    calls = spark.readStream.schema(held.schema).parquet(f"{scratch.root}/calls")
    with state.rocksdb(spark):
        query = state.paced(calls, 500, 0.1, 7200).writeStream.format("parquet").option("path", f"{scratch.root}/out").option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{scratch.root}/out")


@query("select user_id, epoch_us(last) as last_us from (select user_id, max(ts) as last from events group by user_id) where last > (select max(ts) from events) - interval 30 days order by last desc, user_id limit 200")
def cache_ttl_lru(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return stream.fresh_entries(events, now, "user_id").select("user_id", stream.micros("ts").alias("last_us"))


_TAGS = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<nav\b[^>]*>.*?</nav\s*>', ' ', 'g'), '(?is)<header\b[^>]*>.*?</header\s*>', ' ', 'g'), '(?is)<footer\b[^>]*>.*?</footer\s*>', ' ', 'g')"""
_PAGE = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(" + _TAGS + r", '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"


@query("select page_id, sha1(" + _PAGE + ") as text_sha1, length(" + _PAGE + ")::int as n_chars from pages")
def html_to_text(spark, sf_dir):
    text = readers.html_text(F.col("html"), blocks=False)
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(text.cast("binary")).alias("text_sha1"), F.length(text).alias("n_chars"))


@query()
def html_blocks(spark, sf_dir):
    text = readers.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.split(text, "\n")).alias("n_lines"), F.sha1(text.cast("binary")).alias("text_sha1"))


_PAGE_WORDS = ("the", "and", "ing", "tion")


@query("select page_id, (case when regexp_matches(html, '(?i)<(?:button|input|a)\\b[^>]*>?[^<]*\\b(?:accept|agree)\\b') then 1 else 0 end + case when len(string_split(" + _PAGE + ", ' ')) > 2000 and len(list_filter(" + _list(_PAGE_WORDS) + ", lambda w: contains(lower(" + _PAGE + "), w))) >= 3 then 1 else 0 end + case when regexp_matches(lower(url), '/(?:terms|tos|legal|agreement|policy|policies|conditions)') then 1 else 0 end) >= 2 as contract_like from pages")
def contract_like_page(spark, sf_dir):
    pages = tx.computed(table(spark, sf_dir, "pages"), "text", readers.html_text(F.col("html"), blocks=False))
    return pages.select("page_id", readers.contract_like(F.col("url"), F.col("html"), F.col("text"), _PAGE_WORDS).alias("contract_like"))


#: Rules over a block's pattern facts, for the flagship.
BLOCK_RULES = [
    {"id": "D-1", "category": "license", "basis": "statutory", "severity": "medium", "when": {"license": True}, "source": {"act": "a"}, "escalate_to_high_when": {"n_chars": {"gt": 200}}, "message": "a licence is named"},
    {"id": "D-2", "category": "style", "basis": "norm", "metric": "shouting", "severity": "high", "when": {"shouting": True}, "message": "capitals and exclamation marks"},
    {"id": "D-3", "category": "style", "basis": "policy", "severity": "low", "when": {"all": [{"table": True}, {"n_chars": {"gte": 100}}]}, "source": {"act": "b"}, "message": "a table in prose"},
]


@query("with" + _LINES + """,
clean as (select doc_id, line_no, line from repeated where repeats < 2),
opened as (select *, case when row_number() over (partition by doc_id order by line_no) = 1 or length(line) >= 55 then 1 else 0 end as o from clean),
numbered as (select *, sum(o) over (partition by doc_id order by line_no) as island from opened),
blocks as (select doc_id, island, string_agg(line, chr(10) order by line_no) as text from numbered group by doc_id, island),
f as (select doc_id, island, length(text) as n, regexp_matches(text, '(?i)licen[cs]e') as lic, contains(text, '!!') as shout, contains(text, ' | ') as tab from blocks where length(text) between 55 and 4500),
found as (select doc_id, island, 'D-1' as rule_id, case when n > 200 then 'high' else 'medium' end as severity from f where lic union all select doc_id, island, 'D-2', 'medium' from f where shout union all select doc_id, island, 'D-3', 'low' from f where tab and n >= 100)
select doc_id, count(distinct island) as flagged, sum((severity = 'high')::int)::bigint as high, sum(case severity when 'high' then 3 when 'medium' then 2 else 1 end)::bigint as score, string_agg(distinct rule_id, ',' order by rule_id) as rules from found group by doc_id""")
def audit_documents(spark, sf_dir):
    """Documents to clean lines, to blocks, to facts, to findings, to a score for each document."""
    clean = table(spark, sf_dir, "documents").select("doc_id", furniture.strip_repeating_lines(F.col("text")).alias("text"))
    blocks = lines_of(clean).withColumnsRenamed({"line_no": "block_no", "line": "block"})
    own = segment.tidy_islands(blocks).where(F.col("n_chars").between(segment.MIN_CHARS, segment.MAX_CHARS))
    x = F.col("text")
    read = own.select("doc_id", "island", "n_chars", tx.matches(x, "licen[cs]e").alias("license"), F.contains(x, F.lit("!!")).alias("shouting"), F.contains(x, F.lit(" | ")).alias("table"))
    found = rules.evaluate(read, BLOCK_RULES).select("doc_id", "island", F.explode("findings").alias("f")).select("doc_id", "island", "f.rule_id", "f.severity")
    return found.groupBy("doc_id").agg(F.countDistinct("island").alias("flagged"), F.count_if(F.col("severity") == "high").alias("high"), F.sum(evalstats.severity_score(F.col("severity"))).alias("score"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))


@query()
def audit_full(spark, sf_dir):
    """The whole audit, of every document as an employment, rental or loan paper by its language, however many clauses it has."""
    kind = F.when(F.col("lang") == "fr", F.lit("rental")).when(F.col("lang") == "de", F.lit("loan")).otherwise(F.lit("employment"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), kind.alias("doc_type"), "text")
    return audit.audit(docs, most=None)[1]


@query()
def evaluate_clause(spark, sf_dir):
    """Rules by supplied parameters, of JSON in the events table and of three fixed ones.

    An event names no kind of paper, so its parameters are judged as each of the three.
    """
    fixed = [("employment", '{"bond_present": true, "penalty_amount_stated": true}'), ("rental", '{"deposit_months": 3, "premises_type": "residential"}'), ("loan", '{"guarantee_uncapped": true, "prepayment_penalty": true}')]
    kinds = F.explode(F.array(*(F.lit(k) for k, _ in fixed))).alias("doc_type")
    events = audit.supplied(spread(table(spark, sf_dir, "events").select(F.col("props").alias("params"))))
    params = audit.supplied(spark.createDataFrame(fixed, "doc_type string, params string")).unionByName(events.select(kinds, "params"))
    found = audit.clause_findings(params)
    return found.select("doc_type", F.explode("findings").alias("f")).select("doc_type", "f.rule_id", "f.severity", "f.category")


from contractlens.plans import checks, shipped  # noqa: E402, F401  register their own queries here
