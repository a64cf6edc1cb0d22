"""The registered queries of the subpackage, over whole tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlens.llm import chat, conversation_repair, license_scan, lm_scoring, packing, quality_classifier, quality_rules, sentencepiece_codec, simhash, substring_dedup, token_counts, topk, versioned_merge


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality_classifier.classify(documents(spark, sf_dir), labels)


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"), spans=True, ids=False, starts=False)  # a piece starts where the one before it ends


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.withColumn("formatted_sha256", F.sha2("formatted", 256)).drop("formatted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(documents(spark, sf_dir))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(documents(spark, sf_dir))
    base = F.col("failures").bitwiseAND(F.lit(quality_rules.policy_mask("v1"))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality_rules.passes().alias("kept"), "failures")


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, alone and with the others, over all documents."""
    return quality_rules.ablation(quality_rules.ledger(documents(spark, sf_dir)))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op12_versioned_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned_merge.merge(spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_sentencepiece_codec": op5_sentencepiece_codec,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_quality_rules": op9_quality_rules,
    "quality_rule_ablation": quality_rule_ablation,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_versioned_merge": op12_versioned_merge,
    "op13_conversation_repair": op13_conversation_repair,
}

_WORDS = r"words as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)"

ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": "with "
    + _WORDS
    + """,
windows as (select r, i, array_to_string(w[i:i + 34], ' ') as k from (select r, w, unnest(range(1, len(w) - 33)) as i from words where len(w) >= 35)),
twice as (select k from windows group by k having count(*) > 1),
gone as (select distinct r, p from (select r, unnest(range(i, i + 35)) as p from windows join twice using (k))),
placed as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words),
cut as (select x.r, count(g.p) as n_removed, string_agg(word, ' ' order by x.p) filter (where g.p is null) as kept from placed x left join gone g on x.r = g.r and x.p = g.p group by x.r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from words left join cut using (r)""",
    "op9_quality_rules": "with "
    + _WORDS
    + r""",
windows as (select r, i, array_to_string(w[i:i + 7], ' ') as k from (select r, w, unnest(range(1, len(w) - 6)) as i from words where len(w) >= 8)),
twice as (select r, k from windows group by r, k having count(*) > 1),
covered as (select r, count(*) as n_repeat_words from (select distinct r, p from (select r, unnest(range(i, i + 8)) as p from windows join twice using (r, k))) group by r),
lines as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) as l from words),
m as (
  select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n_letters,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) as n_same_next
  from words join lines using (r) left join covered using (r)),
f as (
  select *, (n_words < 20)::int + 2 * (100 * n_repeat_words > 30 * n_words)::int + 4 * (100 * n_symbols > 50 * n_words)::int + 8 * (n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines)::int
    + 16 * (n_letters >= 40 and 100 * n_capitals > 60 * n_letters)::int + 32 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words))::int + 64 * (n_words >= 20 and 100 * n_same_next > 30 * n_words)::int as failures from m)
select doc_id, n_words::bigint as n_words, word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  failures & 3 <> 0 as base_failed, failures = 0 as kept, failures::bigint as failures from f""",
    "op6_chat_formatting": r"""
with recursive messages as materialized (select row_number() over () as r, * from conversations),
lines as (
  select r, conv_id, turn, i as pos, l as line, length(regexp_replace(regexp_extract(l, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) as level,
    lower(trim(regexp_replace(regexp_replace(l, '^[ \t]*(>[ \t]*)+', ''), '[ \t\r\n]+', ' ', 'g'))) as said
  from (select r, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) as l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from messages)),
runs as (select *, sum(new) over (partition by r order by pos) as run from (
  select *, case when coalesce(lag(level) over (partition by r order by pos), -1) <> level then 1 else 0 end as new from lines)),
passages as (
  select conv_id, turn, level, string_agg(said, ' ' order by pos) as passage, arg_min(said, pos) as first_line
  from runs where level > 0 and said <> '' group by r, conv_id, turn, run, level),
keys as (select conv_id, turn, level, passage as said from passages union select conv_id, turn, level, first_line from passages),
own as (
  select conv_id, turn, said from lines where level = 0 and said <> ''
  union select conv_id, turn, lower(trim(regexp_replace(string_agg(line, ' ' order by pos), '[ \t\r\n]+', ' ', 'g'))) from lines where level = 0 group by r, conv_id, turn),
origins as (select conv_id, said, min(turn) as origin from own where said <> '' group by all),
links as (select k.conv_id, k.turn, k.level, max(o.origin) as origin from keys k join origins o on k.conv_id = o.conv_id and k.said = o.said where o.origin < k.turn group by all),
parents as (select conv_id, turn, max(origin) as parent_turn, count(*) as n_levels from links group by all),
up as (
  select conv_id, turn, parent_turn as pos, 1::bigint as depth from parents
  union all select u.conv_id, u.turn, p.parent_turn, u.depth + 1 from up u join parents p on u.conv_id = p.conv_id and u.pos = p.turn),
tops as (select conv_id, turn, min(pos) as thread_turn, max(depth) as depth from up group by all),
bodies as (select r, trim(coalesce(string_agg(line, chr(10) order by pos) filter (where level = 0), ''), ' ' || chr(9) || chr(13) || chr(10)) as body from lines group by r)
select m.conv_id, m.turn, m.role, p.parent_turn, coalesce(t.thread_turn, m.turn) as thread_turn, coalesce(t.depth, 0) as depth, coalesce(p.n_levels, 0) as n_levels, b.body,
  sha256('<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || b.body || chr(10) || '<|end|>' || chr(10)) as formatted_sha256
from messages m join bodies b using (r) left join parents p on m.conv_id = p.conv_id and m.turn = p.turn left join tops t on m.conv_id = t.conv_id and m.turn = t.turn""",
    "op8_exact_top_k": """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5""",
}

ORACLE_SQL["quality_rule_ablation"] = f"""
with book as ({ORACLE_SQL["op9_quality_rules"]}),
names as (select * from (values (0, 'few_words'), (1, 'repeated_windows'), (2, 'symbols'), (3, 'repeated_lines'), (4, 'capitals'), (5, 'word_length'), (6, 'stutter')) as x(bit, rule))
select bit, rule, count(*) filter (failures >> bit & 1 = 1) as failed, count(*) filter (failures = (1 << bit)) as failed_alone,
  count(*) filter (failures & (127 - (1 << bit)) = 0) as kept_without, count(*) as documents
from book cross join names group by bit, rule"""

#: CRC-32 by its table (polynomial 0xEDB88320), for texts of ASCII characters.
_CRC = "crc_table as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)::bigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) as x(i)))"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE_SQL["op12_versioned_merge"] = f"""
with {_CRC},
moved as materialized (
  select distinct change_id, client_id, seq, op, source, segment, city, cast(floor(100 * balance + 0.5) as bigint) as balance_cents,
    valid_at - case when {_crc("change_id::varchar")} % 7 = 0 then interval 36 hour else interval 0 hour end as moved_at
  from client_changes, crc_table where valid_at is not null),
firsts as (select * from moved qualify row_number() over (partition by client_id, seq order by change_id, moved_at, op, source, segment, city, balance_cents) = 1),
kept as (select * from firsts qualify row_number() over (partition by client_id, moved_at order by seq desc) = 1),
states as (
  select client_id, moved_at, seq, {{'d': op = 'D', 's': case when op <> 'D' then source end, 'g': case when op <> 'D' then segment end, 'c': case when op <> 'D' then city end, 'b': case when op <> 'D' then balance_cents end}} as v from kept),
turns as (select *, row_number() over w = 1 or v is distinct from lag(v) over w as new from states window w as (partition by client_id order by moved_at)),
versions as (select *, row_number() over w as version, lead(moved_at) over w as ends from turns where new window w as (partition by client_id order by moved_at)),
counts as (
  select v.client_id, v.version, count(distinct m.change_id) as n_changes
  from versions v join moved m on m.client_id is not distinct from v.client_id and m.moved_at >= v.moved_at and (v.ends is null or m.moved_at < v.ends) group by all)
select v.client_id, v.version::int as version, epoch(v.moved_at)::bigint as valid_from, epoch(v.ends)::bigint as valid_to, v.v.d as is_deleted, v.v.s as source, v.v.g as segment, v.v.c as city, v.v.b as balance_cents,
  v.seq as first_seq, n_changes
from versions v join counts c on c.client_id is not distinct from v.client_id and c.version = v.version"""

ORACLE_SQL["op13_conversation_repair"] = f"""
with recursive {_CRC},
rolled as materialized (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations, crc_table),
hurt as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, k <> 0 as here, k from rolled),
damaged as (select * exclude (k) from hurt union all select * exclude (k) from hurt where k = 3),
{conversation_repair.REPAIR}sha256(coalesce(r.body, '')) as repaired_sha256{conversation_repair.FROM}"""
