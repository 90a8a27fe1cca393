"""The training-data operators as queries over whole tables, and DuckDB SQL for those that it can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontaminate, mixing, quality_rules, simhash, token_counts, toxicity, url_filter, warc, weak_quality
from palimpsest.llm.shared import checkpoint_dir, cut, gone
from palimpsest.session import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hit_spans", "items")


def spans(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(column)


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.format_pairs(chat.answer_swaps(table(spark, sf_dir, "conversations")))
    return pairs.select(F.col("conv").alias("conv_id"), F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen_completion", spans("chosen_mask"), "rejected_completion", spans("rejected_mask"))


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), keep=("page_id",)).drop("score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    found = cut(warc.round_trip(table(spark, sf_dir, "pages"), folder))
    gone(spark, folder)
    return found


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_decontamination, op2_preference_format, op3_length_histogram, op4_toxicity, op5_url_filter, op6_simhash, op7_mixing, op8_quality_rules, op9_warc, op10_weak_quality)
    return {f.__name__: f for f in (*ops, pipeline)}


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_decontamination": f"""
with items as (select cast(item_id as varchar) item, {_WORDS} w from benchmark),
windows as (
  select distinct item, least(len(w), 10) k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') s
  from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from items where len(w) > 0)),
sizes as (select distinct k from windows),
docs as (select row_number() over () r, doc_id, {_WORDS} w from documents),
places as (
  select r, k, i, array_to_string(w[i : i + k - 1], ' ') s
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) i from docs, sizes where len(w) >= k)),
found as (select r, p.k, i, item from places p join windows v on p.k = v.k and p.s = v.s),
hits as (select r, count(distinct i + j) n from (select r, i, unnest(range(k)) j from found) group by r),
named as (select r, count(*) n, string_agg(item, ',' order by item) names from (select distinct r, item from found where item is not null) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(h.n, 0) as bigint) n_hit, cast(coalesce(m.n, 0) as bigint) n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated
from docs left join hits h using (r) left join named m using (r)""",
    "op2_preference_format": r"""
with turns as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i, '<|' || role || '|>' || chr(10) as head from turns),
answers as (select conv_id, max(i) as at from numbered where role = 'assistant' group by conv_id),
last_ as (select n.* from numbered n join answers a on n.conv_id = a.conv_id and n.i = a.at),
swapped as (
  select c.conv_id, c.i, case when c.i = a.at then o.role else c.role end as role, case when c.i = a.at then o.text else c.text end as text,
    case when c.i = a.at then o.head else c.head end as head
  from numbered c join answers a on a.conv_id = c.conv_id join last_ o on o.conv_id = xor(c.conv_id, 1)),
pairs as (
  select a.conv_id, a.i, a.role, a.text, a.head, b.role as role2, b.text as text2, b.head as head2,
    bool_or(b.conv_id is null or a.role <> b.role or a.text <> b.text) over (partition by a.conv_id order by a.i) as apart
  from numbered a left join swapped b on a.conv_id = b.conv_id and a.i = b.i),
long_ as (
  select conv_id, i, apart, 1 as side, role, head, text from pairs union all
  select conv_id, i, apart, 2, role2, head2, text2 from pairs where role2 is not null),
placed as (
  select *, head || text || '<|end|>' || chr(10) as whole,
    coalesce(sum(len(head) + len(text) + 8) over (partition by conv_id, side, apart order by i rows between unbounded preceding and 1 preceding), 0) + len(head) as pos
  from long_)
select conv_id,
  cast(count(*) filter (side = 1 and not apart) as bigint) prompt_turns,
  coalesce(string_agg(whole, '' order by i) filter (side = 1 and not apart), '') prompt,
  coalesce(string_agg(whole, '' order by i) filter (side = 1 and apart), '') chosen_completion,
  coalesce(string_agg(cast(pos as bigint) || '-' || cast(pos + len(text) + 8 as bigint), ',' order by i) filter (side = 1 and apart and role = 'assistant'), '') chosen_mask,
  coalesce(string_agg(whole, '' order by i) filter (side = 2 and apart), '') rejected_completion,
  coalesce(string_agg(cast(pos as bigint) || '-' || cast(pos + len(text) + 8 as bigint), ',' order by i) filter (side = 2 and apart and role = 'assistant'), '') rejected_mask
from placed group by conv_id""",
    "op7_mixing": r"""
with docs as (
  select row_number() over () r, doc_id, source is null as missing, coalesce(source, '') as src,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
    md5(coalesce(cast(doc_id as varchar), '') || chr(31) || coalesce(text, '')) k
  from documents),
sources as (
  select missing, src, cast(sum(size) as bigint) source_size, row_number() over (order by missing, src) place from docs group by missing, src),
weighted as (select *, [3, 1, 2][(place - 1) % 3 + 1] w, 2 * source_size as lim from sources),
levelled as (
  select *, row_number() over up as rk,
    (1.5 * cast(sum(source_size) over () as double) - coalesce(cast(sum(lim) over before as double), 0)) / cast(sum(w) over () - coalesce(sum(w) over before, 0) as double) lev
  from weighted window up as (order by lim / w, place), before as (order by lim / w, place rows between unbounded preceding and 1 preceding)),
goal as (
  select missing, src, source_size, coalesce(least(cast(lim as double), (select arg_min(lev, rk) from levelled where lim > lev * w) * w), cast(lim as double)) target from levelled),
run as (
  select r, doc_id, size, k, g.*, sum(size) over (partition by d.missing, d.src order by k) as ends, sum(size) over (partition by d.missing, d.src, k) as there
  from docs d join goal g using (missing, src)),
rest as (select *, case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end as epochs from run),
last_ as (select *, cast(floor(target) as bigint) - epochs * source_size as left_ from rest)
select doc_id, size, source_size, target,
  cast(epochs * size + case when ends <= left_ then size when ends - there < left_ then size * (left_ - (ends - there)) // there else 0 end as bigint) taken
from last_""",
    "op9_warc": r"""
with rows as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as d from pages),
firsts as (select d, max(page_id) as first_, count(*) n from rows group by d),
coded as (
  select page_id, octet_length(encode(body)) as n_bytes, d, first_,
    list_transform(range(8), lambda g: cast('0x' || substr(d, cast(5 * g + 1 as int), 5) as bigint)) as groups
  from rows join firsts using (d))
select page_id, cast(n_bytes as bigint) payload_bytes,
  array_to_string(list_transform(groups, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v // 32768 as int) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v // 1024 % 32 as int) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v // 32 % 32 as int) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v % 32 as int) + 1, 1)), '') payload_digest,
  case when page_id is distinct from first_ and first_ is not null then 'revisit' else 'response' end record_type,
  case when page_id is distinct from first_ then first_ end refers_to
from coded""",
}


def _url_filter_sql() -> str:
    """The models' smoothing, order by order, as common table expressions."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}')"
    case = lambda k: "case " + " ".join(f"when {fits(r[1])} then '{r[k]}'" for r in rules) + " end"
    levels = []
    for n in range(1, url_filter.ORDER + 1):
        base = f"""
n{n} as (
  select substr(gram, {url_filter.ORDER - n + 1}, {n}) g, sum(a) a, sum(b) b from counts group by 1),
c{n} as (
  select *, sum(a) over c a_all, sum(b) over c b_all, sum((a > 0)::int) over c a_kinds, sum((b > 0)::int) over c b_kinds from n{n} window c as (partition by substr(g, 1, {n - 1})))"""
        if n == 1:
            chance = lambda k: f"({k} + 1.0::double) / ({k}_all + (select count(distinct substr(gram, {url_filter.ORDER}, 1)) from counts)::double)"
            levels.append(f"{base},\np1 as (select g, {chance('a')} pa, {chance('b')} pb from c1)")
        else:
            chance = lambda k: f"case when {k}_all = 0 then p.p{k} else ({k} + {k}_kinds * p.p{k}) / cast({k}_all + {k}_kinds as double) end"
            levels.append(f"{base},\np{n} as (select c.g, {chance('a')} pa, {chance('b')} pb from c{n} c join p{n - 1} p on p.g = substr(c.g, 2))")
    return rf"""
with rests as (
  select row_number() over () r, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
parts as (
  select r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from rests),
judged as (
  select *, {case(1)} "rule", {case(0)} said, substr(md5(host || path), 1, 1) < '4' tested,
    repeat(chr(2), {url_filter.ORDER - 1}) || host || path || chr(3) spelt
  from parts),
grams as (select r, said, tested, substr(spelt, i, {url_filter.ORDER}) gram from (select *, unnest(range(1, len(spelt) - {url_filter.ORDER} + 2)) i from judged)),
counts as (
  select gram, count(*) filter (said = 'allow' and not tested) a, count(*) filter (said = 'block' and not tested) b from grams group by 1),{",".join(levels)},
scored as (select r, round(cast(sum(cast(round(ln(pa) - ln(pb), 6) as decimal(18, 6))) as double) / count(*), 9) score from grams join p{url_filter.ORDER} on g = gram group by 1),
bins as (
  select greatest(-2000, least(2000, cast(floor(score * 100) as int))) bin, count(*) filter (said = 'allow') a, count(*) filter (said = 'block') b
  from judged join scored using (r) where said is not null and tested group by 1),
gains as (
  select bin, (bin + coalesce(lag(bin) over (order by bin), bin)) / 200 middle,
    case when sum(a) over () > 0 and sum(b) over () > 0 then round(coalesce(sum(b) over below, 0) / sum(b) over () - coalesce(sum(a) over below, 0) / sum(a) over (), 9) end gain
  from bins window below as (order by bin rows between unbounded preceding and 1 preceding)),
least_ as (select coalesce((select case when gain is null then 0 else middle end from gains order by gain desc nulls last, bin limit 1), 0) t)
select page_id, host, path, "rule", coalesce(said, case when score >= t then 'allow' else 'block' end) verdict from judged join scored using (r), least_"""


SQL["op5_url_filter"] = _url_filter_sql()


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
