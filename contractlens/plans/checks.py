"""Queries on evaluation, labels, pages, suggestions and drafts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from contractlens.operators import curate, evalstats, extract, segment, statutes, versions
from contractlens.plans import audit
from contractlens.plans.queries import _DIGESTS, _DRAFTS, _PAGE, _TAGS, SQL, _drafts, query, table
from contractlens.sources import readers

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("""
with c as (select toxic, quality, count(*) as n, sum((quality = 1 - toxic)::int) as hits from labels group by all),
s as (select toxic, sum(n) as n, sum(hits) as hits, max(n) as most from c group by toxic)
select toxic, n::bigint as n, hits::bigint as hits, round(hits / n, 4) as accuracy, round(greatest(0.0, least(1.0, (hits / n + 3.8416 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n))), 4) as low,
  round(greatest(0.0, least(1.0, (hits / n + 3.8416 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n))), 4) as high, round(most / n, 4) as majority from s""")
def label_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("toxic", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("guess"))
    return evalstats.accuracy(rows, ["toxic"])


@query("with t as (select toxic, count(*) as n, round(avg((quality = 1 - toxic)::int), 4) as accuracy from labels group by toxic) select sum(round_even(accuracy * n, 0))::double as hits, sum(n)::bigint as n, round(sum(round_even(accuracy * n, 0)) / sum(n), 4) as accuracy from t")
def pooled_accuracy(spark, sf_dir):
    return evalstats.pooled(label_accuracy(spark, sf_dir)).select(F.col("hits").cast("double").alias("hits"), "n", "accuracy")


@query("select k as quality, count(l.doc_id) as n from (values ('0'), ('1'), ('2')) v(k) left join labels l on l.quality::varchar = k group by k")
def label_distribution(spark, sf_dir):
    return evalstats.distribution(table(spark, sf_dir, "labels"), "quality", ["0", "1", "2"])


@query("""
with r as (select doc_id, case doc_id % 4 when 0 then 'deposit' when 1 then 'notice' when 2 then 'odd' end as category, toxic = 1 as risky, case doc_id % 5 when 0 then 'none' when 1 then 'low' when 2 then 'high' when 3 then 'odd' end as severity, case when doc_id % 3 = 0 then ' ' when doc_id % 3 = 1 then 'why' end as rationale from labels)
select doc_id, array_to_string(list_filter([case when not coalesce(category in ('deposit', 'notice'), false) then 'category' end, case when not coalesce(severity in ('none', 'low', 'medium', 'high'), false) then 'severity' end,
  case when risky and severity = 'none' then 'risky without severity' end, case when not risky and severity in ('low', 'medium', 'high') then 'severity without risk' end, case when risky and trim(coalesce(rationale, '')) = '' then 'no rationale' end], lambda x: x is not null), ',') as problems from r""")
def label_problems(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(i % 4 == 0, F.lit("deposit")).when(i % 4 == 1, F.lit("notice")).when(i % 4 == 2, F.lit("odd")).alias("category"), (F.col("toxic") == 1).alias("risky"),
        F.when(i % 5 == 0, F.lit("none")).when(i % 5 == 1, F.lit("low")).when(i % 5 == 2, F.lit("high")).when(i % 5 == 3, F.lit("odd")).alias("severity"), F.when(i % 3 == 0, F.lit(" ")).when(i % 3 == 1, F.lit("why")).alias("rationale"),
    )
    return rows.select("doc_id", F.array_join(evalstats.label_problems(F.array(F.lit("deposit"), F.lit("notice"))), ",").alias("problems"))


@query("""
with r as (select doc_id, case doc_id % 5 when 0 then 'deposit' when 1 then 'high' when 2 then 'odd' when 3 then 'notice' end as c, case doc_id % 7 when 0 then 'low' when 1 then 'deposit' when 2 then 'odd' when 3 then 'medium' end as s from documents)
select doc_id, case when s in ('deposit', 'notice') and c in ('none', 'low', 'medium', 'high') then s when c in ('deposit', 'notice') then c else 'boilerplate' end as category,
  case when s in ('deposit', 'notice') and c in ('none', 'low', 'medium', 'high') then c when s in ('none', 'low', 'medium', 'high') then s else 'none' end as severity from r""")
def coerced_suggestions(spark, sf_dir):
    i = F.col("doc_id")
    category = F.when(i % 5 == 0, F.lit("deposit")).when(i % 5 == 1, F.lit("high")).when(i % 5 == 2, F.lit("odd")).when(i % 5 == 3, F.lit("notice"))
    severity = F.when(i % 7 == 0, F.lit("low")).when(i % 7 == 1, F.lit("deposit")).when(i % 7 == 2, F.lit("odd")).when(i % 7 == 3, F.lit("medium"))
    got = evalstats.coerce_suggestion(category, severity, F.lit(None), ["deposit", "notice"])
    return table(spark, sf_dir, "documents").select("doc_id", got.alias("s")).select("doc_id", "s.category", "s.severity")


@query("""
with r as (select doc_id, text, case doc_id % 4 when 0 then left(text, 60) when 1 then lower(left(text, 30)) when 2 then 'no such quote' end as quote, case doc_id % 3 when 0 then 'deposit' else 'odd' end as category, 0.9 as sure from documents),
f as (select *, coalesce(quote, '') <> '' and contains(lower(text), lower(left(coalesce(quote, ''), 40))) as found from r)
select doc_id, found as quote_verified, case when category = 'deposit' then category else 'boilerplate' end as category, (case when category = 'deposit' then case when found then 0.9 else 0.5 end else 0.4 end)::double as confidence from f""")
def quote_checks(spark, sf_dir):
    i = F.col("doc_id")
    quote = F.when(i % 4 == 0, F.left("text", F.lit(60))).when(i % 4 == 1, F.lower(F.left("text", F.lit(30)))).when(i % 4 == 2, F.lit("no such quote"))
    got = extract.quote_check(F.col("text"), quote, F.when(i % 3 == 0, F.lit("deposit")).otherwise(F.lit("odd")), F.lit(0.9), ["deposit"])
    return table(spark, sf_dir, "documents").select("doc_id", got.alias("q")).select("doc_id", "q.*")


@query("""
with r as (select l_orderkey as doc_id, l_linenumber % 3 as extracted, (l_quantity > 45)::int as fired, (l_quantity > 40 and l_quantity <= 45)::int as withheld, l_linenumber = 4 or l_returnflag = 'R' and l_orderkey % 4 = 0 as failed from lineitem),
s as (select doc_id, count(*) as clauses, sum(extracted) as extracted, sum(fired) as fired, sum(withheld) as withheld, sum(failed::int) as failures from r group by doc_id)
select doc_id, clauses, extracted::bigint as extracted, fired::bigint as fired, withheld::bigint as withheld, failures::bigint as failures,
  case when failures >= clauses then 'extractor dead' when failures > 0 then 'extractor flaky' when extracted = 0 then 'nothing extracted' when fired = 0 and withheld = 0 then 'nothing fired' when fired = 0 then 'all withheld' else 'ok' end as diagnosis from s""")
def diagnosed_documents(spark, sf_dir):
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("extracted"), (q > 45).cast("int").alias("fired"), ((q > 40) & (q <= 45)).cast("int").alias("withheld"), ((F.col("l_linenumber") == 4) | ((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 4 == 0))).alias("failed"))
    return evalstats.counters(rows)


_CITED = r"""c as (
  select doc_id, case doc_id % 3 when 0 then 'norm' when 1 then 'statutory' else 'policy' end as basis, case when doc_id % 5 = 0 then null else (doc_id % 7)::varchar end as section,
    case when doc_id % 11 = 0 then null else (doc_id % 7 + (doc_id % 13 = 0)::int)::varchar || '. ' || left(text, (80 + 10 * (doc_id % 30))::int) end as span, split_part(lang, '-', 1) as doc_type from documents),
n as (select *, trim(regexp_replace(coalesce(span, ''), '\s+', ' ', 'g')) as tight, contains(trim(regexp_replace(lower(coalesce(span, '')), '[^a-z0-9]+', ' ', 'g')), 'tion') as anchored from c),
v as (select *, case when basis = 'norm' then null when span is null or tight = '' then 'no span'
  when section is not null and not list_contains(string_split(regexp_replace(upper(left(tight, 120)), '[^A-Z0-9]+', ' ', 'g'), ' '), section) then 'wrong section'
  when length(tight) < 120 then 'heading only' when not anchored then 'no anchor' end as reason from n)"""


def _cited(spark, sf_dir):
    i = F.col("doc_id")
    section = F.when(i % 5 != 0, (i % 7).cast("string"))
    span = F.when(i % 11 != 0, F.concat((i % 7 + (i % 13 == 0).cast("int")).cast("string"), F.lit(". "), F.left("text", (80 + 10 * (i % 30)).cast("int"))))
    basis = F.when(i % 3 == 0, F.lit("norm")).when(i % 3 == 1, F.lit("statutory")).otherwise(F.lit("policy"))
    own = table(spark, sf_dir, "documents").select("doc_id", basis.alias("basis"), F.struct(section.alias("section"), F.lit("act").alias("corpus_id")).alias("source"), span.alias("citation_span"), F.array(F.lit("tion")).alias("anchors"), F.col("lang").alias("doc_type"), i.cast("string").alias("rule_id"))
    return statutes.verify(own)


@query("with " + _CITED + "\nselect doc_id, basis, reason, reason is null as verified from v")
def verified_citations(spark, sf_dir):
    return _cited(spark, sf_dir).select("doc_id", "basis", "reason", "verified")


@query("with " + _CITED + "\nselect doc_type, count(*) as checked, count(*) filter (reason is null) as grounded, round(count(*) filter (reason is null) / count(*), 4) as rate from v where basis <> 'norm' group by doc_type")
def grounded_share(spark, sf_dir):
    return evalstats.groundedness(_cited(spark, sf_dir))


@query("with " + _CITED + "\nselect doc_type, doc_id::varchar as rule_id, reason as cause from v where basis <> 'norm' and reason is not null")
def corpus_causes(spark, sf_dir):
    return statutes.corpus_check(_cited(spark, sf_dir))


@query("select page_id, sha1(left(" + _PAGE + ", 60000)) as text_sha1, length(left(" + _PAGE + ", 60000))::int as n_chars from pages")
def captured_pages(spark, sf_dir):
    text = readers.captured(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(text.cast("binary")).alias("text_sha1"), F.length(text).alias("n_chars"))


@query("select doc_id from documents where length(text) between 300 and 5000 and contains(lower(left(text, 6000)), 'the')::int + contains(lower(left(text, 6000)), 'and')::int + contains(lower(left(text, 6000)), 'ing')::int + contains(lower(left(text, 6000)), 'tion')::int >= 3")
def agreement_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(readers.is_agreement(F.col("text"), ("the", "and", "ing", "tion"), 300, 5000)).select("doc_id")


@query(r"with a as (select doc_id, (doc_id % 3 + 10) || '. one' || chr(10) || '  15. two' || chr(10) || (doc_id % 2 + 16) || '. three' || chr(10) || text as t from documents) select doc_id, length(t) >= 500 and regexp_matches(t, '(?m)^\s*11\.\s') and regexp_matches(t, '(?m)^\s*15\.\s') and regexp_matches(t, '(?m)^\s*17\.\s') as is_act from a")
def the_act(spark, sf_dir):
    i = F.col("doc_id")
    text = F.concat((i % 3 + 10).cast("string"), F.lit(". one\n  15. two\n"), (i % 2 + 16).cast("string"), F.lit(". three\n"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", readers.is_the_act(text, least=500).alias("is_act"))


@query("select doc_id from documents where not regexp_matches(doc_id::varchar, '^[0-9]*[02468]$') or contains(lower(text), 'license') or length(text) > 3000")
def private_rows(spark, sf_dir):
    return readers.private_rows(table(spark, sf_dir, "documents"), "^[0-9]*[02468]$", ("license",), 3000).select("doc_id")


@query("select o_orderkey, case when o_orderkey % 2 = 0 then 'new' else 'old' end as side from orders union all select -o_orderkey, 'new' from orders where o_orderkey % 10 = 0")
def merged_results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    new = orders.where("o_orderkey % 2 = 0").unionByName(orders.where("o_orderkey % 10 = 0").select((-F.col("o_orderkey")).alias("o_orderkey")))
    return readers.merged_results(orders.withColumn("side", F.lit("old")), new.withColumn("side", F.lit("new")), "o_orderkey")


@query("""with r as (select o_custkey as field, o_totalprice as value, row_number() over (partition by o_custkey order by o_totalprice) as k, count(*) over (partition by o_custkey) as n from orders)
select field, max(n)::int as n, max(case when k = least(floor(n * 0.75), n - 1) + 1 then value end) as p75, max(case when k = least(floor(n * 0.9), n - 1) + 1 then value end) as p90 from r where n >= 8 group by field""")
def norms_of_small_groups(spark, sf_dir):
    return curate.norms_from_arrays(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("field"), F.col("o_totalprice").alias("value")))


@query(r"""
with b as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, """ + _BLANK + r""")), lambda x: x <> '')[1:2] as o from documents)
select doc_id, length(trim(text, """ + _BLANK + r""")) > 400 or regexp_matches(text, '(?i)""" + segment.OBLIGATION.pattern.replace("'", "''") + r"""') or len(list_filter(o, lambda x: regexp_matches(x, '(?i)""" + segment.LETTER.pattern.replace("'", "''") + r"""'))) = 0 as binds from b""")
def binding_blocks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", segment.binding(F.col("text")).alias("binds"))


@query("select lang as doc_type, sum((length(text) % 3 <> 0)::int)::bigint as kept, sum((length(text) % 3 = 0)::int)::bigint as skipped, round(avg((length(text) % 3 = 0)::int), 4) as skip_rate from documents group by lang")
def triage_coverage(spark, sf_dir):
    return evalstats.triage_coverage(table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_type"), (F.length("text") % 3 != 0).alias("keep")))


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag <> 'N' and l_linestatus = 'F' and l_quantity > 40")
def alert_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", F.lit("norm")).otherwise(F.lit("statutory")).alias("basis"), (F.col("l_linestatus") == "F").alias("verified"), F.when(F.col("l_quantity") > 40, F.lit("high")).otherwise(F.lit("low")).alias("severity"))
    return evalstats.alerts(rows).select("l_orderkey", "l_linenumber")


_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@query(f"with h as (select page_id, {_HOST} as host from pages), m as (select distinct host from h where page_id % 17 = 0) select page_id from h where host not in (select host from m)")
def mute_list(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    muted = pages.where("page_id % 17 = 0").select(F.parse_url(F.col("url"), F.lit("HOST")).alias("host"))
    return evalstats.unmuted(pages, muted).select("page_id")


@query("with s as (select doc_id, quality, row_number() over (partition by doc_id order by c desc) as k, c from (select doc_id, quality, 0.5::double as c from labels union all select doc_id, 1 - quality, 0.25 + 0.5 * (doc_id % 2) from labels)) select d.doc_id, s.quality as suggested_quality, s.c::double as suggested_confidence from documents d left join s on d.doc_id = s.doc_id and k = 1")
def suggestions_beside(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    said = labels.select("doc_id", "quality", F.lit(0.5).alias("confidence")).unionByName(labels.select("doc_id", (1 - F.col("quality")).cast(labels.schema["quality"].dataType).alias("quality"), (0.25 + 0.5 * (F.col("doc_id") % 2)).alias("confidence")))
    return evalstats.with_suggestions(table(spark, sf_dir, "documents").select("doc_id"), said, "doc_id")


@query("select l.doc_id, d.text is not null as there from labels l join documents d using (doc_id) where toxic = 0")
def blind_labels(spark, sf_dir):
    labels = evalstats.blind(table(spark, sf_dir, "labels").withColumn("assisted", F.col("toxic") == 1))
    return evalstats.labelled(table(spark, sf_dir, "documents"), labels, "doc_id").select("doc_id", F.col("text").isNotNull().alias("there"))


@query("select conv_id, turn, (length(text) // 4 + 300)::int as tokens from conversations where turn < 3")
def first_turns_cost(spark, sf_dir):
    """The first three turns of each conversation, as first clauses, and what reading them would cost in tokens."""
    own = audit.first_clauses(table(spark, sf_dir, "conversations").withColumn("order", F.col("turn")), 3)
    return own.select("conv_id", "turn", evalstats.token_estimate(F.col("text"), 1000).alias("tokens"))


SQL["hard_cut_3000"] = r"""
with recursive s as (select doc_id, coalesce(text, '') as text, string_split(regexp_replace(coalesce(text, ''), '([.;])\s+', '\1' || chr(1), 'g'), chr(1)) as s from documents),
g as (
  select doc_id, s, 1 as i, trim(s[1], """ + _BLANK + """) as cur, null::int as size from s
  union all
  select doc_id, s, i + 1, case when i = len(s) then '' when cur <> '' and length(cur) + length(s[i + 1]) > 3000 then s[i + 1] else trim(cur || ' ' || s[i + 1], """ + _BLANK + """) end,
    case when (i = len(s) or cur <> '' and length(cur) + length(s[i + 1]) > 3000) and trim(cur, """ + _BLANK + """) <> '' then length(trim(cur, """ + _BLANK + """)) end from g where i <= len(s)),
p as (select doc_id, count(size) as n, max(size) as longest from g group by doc_id)
select doc_id, greatest(n, 1)::int as n_pieces, coalesce(longest, length(text))::int as longest from p join s using (doc_id)"""

_BLOCKS = _TAGS.replace("nav\\b", "table\\b").replace("</nav", "</table").replace("header", "nothing").replace("footer", "nothing")
_JOINED = "trim(regexp_replace(regexp_replace(regexp_replace(" + "replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(" + _BLOCKS + r", '(?i)</?(p|div|br|tr|li|h1|h2|h3|h4|h5|h6)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&amp;', '&')" + r", '[ \t\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{2,}', chr(10), 'g'), ' ' || chr(10))"


SQL["html_blocks"] = "with t as (select page_id, " + _JOINED + " as t from pages) select page_id, len(string_split(t, chr(10)))::int as n_lines, sha1(t) as text_sha1 from t"

SQL["repaired_lines"] = r"""
with recursive l as (select doc_id, string_split(text, chr(10)) as l from documents),
g as (
  select doc_id, l, 0 as i, '' as open, null::varchar as shut from l
  union all
  select doc_id, l, i + 1,
    case when i = len(l) or x = '' then '' when open = '' or fresh then x when hyphen then left(open, length(open) - 1) || x else open || ' ' || x end,
    case when open <> '' and (i = len(l) or x = '' or fresh) then open end
  from (select *, regexp_matches(open, '[.;:!?]\s*$') and regexp_matches(x, '^[A-Z0-9("'']') as fresh, regexp_matches(open, '[a-z]-$') and regexp_matches(x, '^[a-z]') as hyphen
    from (select *, trim(coalesce(l[i + 1], '')) as x from g where i <= len(l)))),
t as (select doc_id, coalesce(string_agg(shut, chr(10) order by i), '') as t from g group by doc_id)
select doc_id, len(string_split(t, chr(10)))::int as n_lines, sha1(t) as text_sha1 from t"""

SQL["near_dup_greedy"] = "with recursive " + _DIGESTS + """,
sets as (select doc_id, string_agg(digest, ',' order by digest) as s from digests group by doc_id), leads as (select doc_id, min(doc_id) over (partition by s) as leader from sets),
own as (select d.* from digests d join leads l on d.doc_id = l.doc_id and l.leader = l.doc_id), sizes as (select doc_id, count(*) as n from own group by doc_id),
e as (select x.doc_id as a, y.doc_id as b, count(*) as shared from own x join own y on x.digest = y.digest and x.doc_id < y.doc_id group by all),
near as (select a, b from e join sizes p on p.doc_id = a join sizes q on q.doc_id = b where shared / least(p.n, q.n) >= 0.85),
turns as materialized (select b, list(a order by a) as smaller, row_number() over (order by b) as i from near group by b),
g as (select 0::bigint as i, []::bigint[] as gone union all select g.i + 1, case when len(list_filter(t.smaller, lambda a: not list_contains(gone, a))) > 0 then list_append(gone, t.b) else gone end from g join turns t on t.i = g.i + 1),
last as (select arg_max(gone, i) as gone from g)
select l.doc_id, l.doc_id = l.leader and not list_contains(gone, l.leader) as kept, case when l.doc_id <> l.leader then l.leader when list_contains(gone, l.doc_id) then list_min(list_filter(t.smaller, lambda a: not list_contains(gone, a))) end as match
from leads l cross join last left join turns t on t.b = l.doc_id"""


@query("with " + _DRAFTS + """,
pairs as (select coalesce(x.doc_id, y.doc_id) as doc_id, x.idx as old_idx, y.idx as new_idx, x.text as old_text, y.text as new_text, x.hash is distinct from y.hash as changed from old x full join new y on x.doc_id = y.doc_id and x.idx = y.idx),
f as (select *, coalesce(length(old_text) > 100, false) as b, coalesce(length(new_text) > 108, false) as a from pairs)
select doc_id, sum((not b and a)::int)::bigint as new, sum((b and a and changed)::int)::bigint as reworded, sum((b and a and not changed)::int)::bigint as persisted, sum((b and not a and new_idx is not null and not changed)::int)::bigint as vanished,
  sum((b and not a and (new_idx is null or changed))::int)::bigint as resolved from f where a or b group by doc_id""")
def draft_diff_by_place(spark, sf_dir):
    """What becomes of findings where clauses are matched by their place, so that changed ones are reworded."""
    old, new = _drafts(spark, sf_dir)
    side = lambda df, name: df.select("doc_id", "idx", F.col("idx").alias(name))
    pairs = side(old, "old_idx").join(side(new, "new_idx"), ["doc_id", "idx"], "full").select("doc_id", "old_idx", "new_idx", F.lit(0.5).alias("similarity"))
    found = lambda df, n: df.where(F.length("text") > n).select("doc_id", "idx", F.lit("R").alias("rule_id"), F.lit("low").alias("severity"))
    return versions.summary(versions.diff(pairs, old, new, found(old, 100), found(new, 108)))
