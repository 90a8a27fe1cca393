"""DuckDB SQL that several oracles share."""

from __future__ import annotations

WORD = r"[A-Za-z0-9]+(?:[''’\-][A-Za-z0-9]+)*"


def words(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '{WORD}'), lambda x: lower(x))"


def sentences(column: str) -> str:
    """Sentences with boundaries marked; the engine has no lookaround, so each boundary keeps its neighbours."""
    return rf"""regexp_replace(regexp_replace({column}, '([.!?])\s+([A-Z0-9"“''])', '\1' || chr(1) || '\2', 'g'), '(\S)\n+', '\1' || chr(1), 'g')"""


#: passages: doc_id, paragraph_index, sentence_index, text, tokens, quoted, attributed, kind.  corpus: source_id, source_sentence, tokens.
PASSAGES = rf"""
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as paragraph_index from documents where text is not null),
quoted_spans as (
  select doc_id, paragraph_index, line, regexp_extract_all(line, '["“]([^"”]{{2,}}?)["”]', 1) q from lines),
pieces as (
  select doc_id, paragraph_index, line, q, unnest(list_filter(list_transform(string_split({sentences('line')}, chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')) s,
    generate_subscripts(list_filter(list_transform(string_split({sentences('line')}, chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> ''), 1) - 1 as sentence_index
  from quoted_spans),
tokened as (select *, {words('s')} tokens from pieces),
passages as (
  select doc_id, paragraph_index, sentence_index, s as text, tokens,
    regexp_full_match(s, '["“](.|\n)*["”]') and len(s) >= 2 or list_contains(list_transform(q, lambda x: contains(x, s)), true) as quoted,
    case when len(tokens) < 3 then 'short'
      when trim(lower(regexp_replace(s, '\s+', ' ', 'g')), ' .:') in ('all rights reserved', 'this page intentionally left blank', 'table of contents', 'conflict of interest', 'the authors declare no competing interests', 'author contributions', 'supplementary material', 'corresponding author') then 'boilerplate'
      else 'scored' end as kind,
    regexp_matches(s, '\[(\d+(?:\s*[-,]\s*\d+)*)\]|\b[A-Z][A-Za-z-]+(?:\s+et al\.)?\s*\(\s*\d{{4}}[a-z]?\s*\)') as attributed
  from tokened),
source_pieces as (
  select item_id as source_id, unnest(list_filter(list_transform(string_split({sentences('text')}, chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')) s,
    generate_subscripts(list_filter(list_transform(string_split({sentences('text')}, chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> ''), 1) - 1 as source_sentence
  from benchmark),
corpus as (select source_id, source_sentence, s as text, {words('s')} tokens from source_pieces where len({words('s')}) >= 8)"""

#: cand: the candidate pairs with a number; aligned: matched words, coverage and ratio of each; hit: the aligned words of the passage.
ALIGNED = rf"""
left_tokens as (select doc_id, paragraph_index, sentence_index, unnest(list_distinct(tokens)) t from passages where kind = 'scored' and len(tokens) >= 8),
right_tokens as (select source_id, source_sentence, unnest(list_distinct(tokens)) t from corpus),
shared as (
  select doc_id, paragraph_index, sentence_index, source_id, source_sentence, count(*) shared
  from left_tokens join right_tokens using (t) group by all having count(*) >= 4),
ranked as (
  select *, row_number() over (partition by doc_id, paragraph_index, sentence_index order by shared desc, source_id, source_sentence) candidate_rank from shared),
cand as (
  select row_number() over () pid, r.*, p.tokens a, c.tokens b, p.quoted, p.attributed
  from ranked r join passages p using (doc_id, paragraph_index, sentence_index) join corpus c using (source_id, source_sentence)
  where candidate_rank <= 200 and len(list_intersect(p.tokens, c.tokens)) >= 4),
eq as (
  select x.pid, x.i, y.j from (select pid, unnest(a) w, generate_subscripts(a, 1) i from cand) x
  join (select pid, unnest(b) w, generate_subscripts(b, 1) j from cand) y on x.pid = y.pid and x.w = y.w),
isl as (select pid, i, j, i - row_number() over (partition by pid, i - j order by i) g from eq),
run as (select pid, i, j, max(i) over (partition by pid, i - j, g) - i + 1 r from isl),
walk(pid, alo, ahi, blo, bhi, mi, k) as (
  select pid, 1::bigint, len(a) + 1, 1::bigint, len(b) + 1, 0::bigint, 0::bigint from cand
  union all
  select pid, case s when 0 then alo else mi + k end, case s when 0 then mi else ahi end, case s when 0 then blo else mj + k end, case s when 0 then mj else bhi end, mi, case s when 0 then k else 0 end
  from (
    select w.pid, w.alo, w.ahi, w.blo, w.bhi, max(least(r.r, w.ahi - r.i, w.bhi - r.j)) k,
      arg_max(r.i, least(r.r, w.ahi - r.i, w.bhi - r.j) * 1000000000 - r.i * 10000 - r.j) mi, arg_max(r.j, least(r.r, w.ahi - r.i, w.bhi - r.j) * 1000000000 - r.i * 10000 - r.j) mj
    from walk w join run r on r.pid = w.pid and r.i >= w.alo and r.i < w.ahi and r.j >= w.blo and r.j < w.bhi group by 1, 2, 3, 4, 5) q, (values (0), (1)) v(s)),
blocks as (select pid, mi - 1 as mi, k from walk where k > 0),
counted as (select c.*, coalesce(m.matched, 0)::bigint matched from cand c left join (select pid, sum(k) matched from blocks group by 1) m using (pid)),
rated as (select *, matched / len(a) coverage, 2.0 * matched / (len(a) + len(b)) ratio from counted),
aligned as (select * from rated where matched >= 8 and coverage >= 0.5 and (coverage >= 0.9 or ratio >= 0.75)),
best as (
  select *, row_number() over (partition by doc_id, paragraph_index, sentence_index, source_id order by matched desc, source_sentence) best,
    case when quoted and attributed then 'attributed_quotation' when quoted then 'quotation' when attributed then 'cited_match' else 'suspected_unattributed' end classification
  from aligned),
matches as (
  select *, printf('PM-%04d', row_number() over (partition by doc_id order by list_position(['suspected_unattributed', 'external_match', 'quotation', 'cited_match', 'attributed_quotation', 'semantic_related'], classification), matched desc, paragraph_index, sentence_index, source_id)) match_id,
    case when coverage >= 0.9 then 'exact' else 'near_exact' end "method"
  from best where best = 1),
positions as (select m.doc_id, m.source_id, m.match_id, m.classification, m.paragraph_index, m.sentence_index, unnest(range(mi, mi + k)) token_index from matches m join blocks using (pid)),
excluded as (
  select d.doc_id, cast(coalesce(sum(len(tokens)) filter (kind = 'scored'), 0) as bigint) scored_words, cast(0 as bigint) references_words, cast(count(*) filter (kind = 'boilerplate') as bigint) boilerplate_passages
  from (select distinct doc_id from documents) d left join passages p on p.doc_id = d.doc_id group by 1)"""
