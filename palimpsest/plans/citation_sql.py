"""DuckDB SQL of the citation oracles: parsed entries, mentions with their ids, all kinds of issue, and fixes."""

from __future__ import annotations

def names(c: str, *skip: str) -> str:
    return rf"""list_distinct(list_filter(list_transform(list_filter(regexp_extract_all({c}, '[A-Za-z][A-Za-z''’.-]*'), lambda x: lower(x) not in ({', '.join(repr(s) for s in skip)})), lambda x: lower(regexp_replace(x, '[^A-Za-z]', '', 'g'))), lambda x: x <> ''))"""


def n_words(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '\S+'))"


def parsed(source: str) -> str:
    """refs: the fields of entries, from a query of doc_id, position and text."""
    return rf"""
e(doc_id, pos, raw0) as ({source}),
t as (select doc_id, cast(pos as bigint) pos, trim(raw0) raw, regexp_extract(trim(raw0), '^\[?(\d+)\]?\.?\s*(.+)', 1) n, case when regexp_matches(trim(raw0), '^\[?(\d+)\]?\.?\s*(.+)') then regexp_extract(trim(raw0), '^\[?(\d+)\]?\.?\s*(.+)', 2) else trim(raw0) end body from e),
h as (
  select *, case when n <> '' then n else cast(pos as varchar) end id, regexp_split_to_array(body, '\.\s+|\s+\((?:19|20)\d{{2}}')[1] head, regexp_extract(body, '[“"](.+?)[”"]', 1) quoted,
    regexp_replace(body, '(?i)https?://\S+|doi:\s*\S+|10\.\d{{4,9}}/\S+', '', 'g') rest, regexp_extract(body, '\b((?:19|20)\d{{2}}[a-z]?)\b', 1) yr,
    lower(rtrim(regexp_extract(body, '(?i)10\.\d{{4,9}}/\S+'), '.,;)')) doi, trim(regexp_extract(body, '(?i)\b(IEEE|ACM|Nature|Springer|Elsevier|Wiley|MDPI|Proceedings|Journal|Transactions)[^.]{{0,80}}'), ' .,') venue from t),
p as (
  select *, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(head, ',\s+([A-Z][a-z]+,)', chr(1) || '\1', 'g'), ',\s+([A-Z]\.\s*[A-Z])', chr(1) || '\1', 'g'), '\s+and\s+|;\s+|' || chr(1)), lambda x: trim(x, ' .')), lambda x: x <> '' and lower(x) not in ('et al', 'et al.')) people,
    list_transform(list_filter(string_split(rest, '.'), lambda x: trim(x) <> ''), lambda x: trim(x, ' .')) pieces from h),
q as (
  select *, case when len(head) between 1 and 220 then list_filter(people, lambda x: {n_words('x')} <= 6)[1:8] else [] end authors,
    case when quoted <> '' then trim(quoted) when len(pieces) >= 2 then case when {n_words('pieces[2]')} >= 3 then pieces[2] else pieces[1] end else trim(rest) end title from p),
refs as (
  select *, case when len(authors) > 0 then {names("array_to_string(authors, ' ; ')", 'et', 'al', 'and')}
      else {names(r"regexp_replace(case when yr <> '' then regexp_split_to_array(raw, '\b(?:19|20)\d{2}[a-z]?\b')[1] else string_split(raw, '.')[1] end, '^\s*\[?\d+\]?[.)]?\s*', '')", 'et', 'al', 'and')} end as names,
    case when doi <> '' then 'doi:' || doi when title <> '' then 'title:' || trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(regexp_replace(title, '\s+', ' ', 'g')), '^\s*\[?\d+\]?\.?\s*', '')), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) end as rkey
  from q)"""


#: each: mentions in ``paras`` (doc_id, paragraph_index, text).
MENTIONS = r"""
each as (
  select doc_id, paragraph_index, unnest(regexp_extract_all(text, '\[\d+(?:\s*[-,]\s*\d+)*\]|\b[A-Z][A-Za-z-]+(?:\s+et al\.)?\s*\(\d{4}[a-z]?\)')) m,
    generate_subscripts(regexp_extract_all(text, '\[\d+(?:\s*[-,]\s*\d+)*\]|\b[A-Z][A-Za-z-]+(?:\s+et al\.)?\s*\(\d{4}[a-z]?\)'), 1) k from paras)"""
#: cites: mentions in order, with the numbers that they name.
CITES = rf"""
told as (
  select row_number() over (partition by doc_id order by paragraph_index, k) spot, doc_id, m as text, case when starts_with(m, '[') then 'numeric' else 'author_year' end kind,
    case when starts_with(m, '[') then string_split(regexp_replace(m, '[\[\]\s]', '', 'g'), ',') else [] end parts from each),
bounds as (select *, list_transform(parts, lambda x: try_cast(string_split(x, '-')[1] as bigint)) lo, list_transform(parts, lambda x: try_cast(string_split(x, '-')[-1] as bigint)) hi from told),
cites as (
  select spot, doc_id, text, kind, case when kind = 'numeric' and list_bool_and(list_transform(range(1, len(lo) + 1), lambda i: coalesce(lo[i] >= 1 and hi[i] >= lo[i] and hi[i] - lo[i] <= 999, false)))
    then list_transform(flatten(list_transform(range(1, len(lo) + 1), lambda i: range(lo[i], hi[i] + 1))), lambda x: cast(x as varchar)) else [] end ids from bounds)"""


def issues(style: str) -> str:
    """found: a row for each issue, where a venue expects ``style`` (numeric or author-year)."""
    wrong, strict = ("numeric", "true") if style == "author-year" else ("author_year", "false")
    return rf"""
people_ as (select *, {names(r"regexp_replace(regexp_replace(text, '\(\s*(?:19|20)\d{2}[a-z]?\s*\)', '', 'g'), '\b(?:19|20)\d{2}[a-z]?\b', '', 'g')", 'et', 'al')} who, regexp_extract(text, '\b((?:19|20)\d{{2}}[a-z]?)\b', 1) yr from cites where kind = 'author_year' and len(ids) = 0),
met as (
  select c.spot, c.doc_id, c.text, c.yr, list(distinct r.id) filter (c.yr <> '' and r.yr = c.yr) resolved, list_sort(list(distinct r.yr) filter (r.yr <> '')) yrs
  from people_ c left join refs r on r.doc_id = c.doc_id and list_has_any(r.names, c.who) group by all),
numbered_ as (select spot, doc_id, text, unnest(ids) id, generate_subscripts(ids, 1) k from cites),
ids as (select spot, doc_id, text, id from numbered_ union all select spot, doc_id, text, unnest(resolved) from met),
nums as (select distinct doc_id, try_cast(id as bigint) n from refs where regexp_matches(id, '^[0-9]+$') and try_cast(id as bigint) is not null),
holes as (select doc_id, coalesce(lag(n) over (partition by doc_id order by n), 0) + 1 low, n - 1 high from nums where n >= 1),
firsts as (select doc_id, id, min((spot, k)) f from numbered_ where regexp_matches(id, '^[0-9]+$') group by 1, 2),
turns as (select *, row_number() over (partition by doc_id order by f) turn from firsts where doc_id in (select doc_id from nums)),
placed as (select *, row_number() over (partition by doc_id order by pos) place from refs),
families as (select doc_id, authors[1] first_, lower(regexp_replace(regexp_split_to_array(authors[1], '\s+')[1], '[^A-Za-z]', '', 'g')) family from refs where len(authors) > 0),
longest as (select doc_id, pos, list_sort(list_transform(names, lambda x: {{'l': -len(x), 'n': x}}))[1].n n from refs where len(names) > 0),
ordered as (select doc_id, list(n order by pos) o from longest group by 1),
gaps_ as (
  select doc_id, id, list_filter([case when len(authors) = 0 and not regexp_matches(raw, '[A-Z][a-z]+') then 'author' end, case when title = '' and len(raw) <= 40 then 'title' end, case when yr = '' and not regexp_matches(raw, '\b(19|20)\d{{2}}\b') then 'year' end], lambda x: x is not null) gap from refs),
found as (
  select doc_id, 'numbering_issues' category, 'invalid_numeric_citation' kind_, text citation, null detail from cites where kind = 'numeric' and len(ids) = 0 union all
  select doc_id, 'author_year_mismatches', 'author_year_mismatch', text, array_to_string(yrs, ', ') from met where resolved is null and yr <> '' and len(yrs) > 0 union all
  select doc_id, 'missing_references', 'missing_reference', text, null from met where resolved is null and not (yr <> '' and coalesce(len(yrs), 0) > 0) union all
  select doc_id, 'duplicate_citation_numbers', 'duplicate_citation_number', text, id from ids group by doc_id, spot, text, id having count(*) > 1 union all
  select doc_id, 'missing_references', 'missing_reference', text, id from ids i where not exists (select 1 from refs r where r.doc_id = i.doc_id and r.id = i.id) union all
  select doc_id, 'uncited_references', 'uncited_reference', id, null from refs r where id <> '' and not exists (select 1 from ids i where r.doc_id = i.doc_id and r.id = i.id) union all
  select doc_id, 'style_mismatches', 'citation_style_mismatch', text, null from cites where kind = '{wrong}' union all
  select doc_id, 'duplicate_reference_numbers', 'duplicate_reference_number', id, null from refs where id <> '' group by doc_id, id having count(*) > 1 union all
  select doc_id, 'duplicate_references', 'duplicate_reference', string_agg(id, ', ' order by pos), rkey from refs where rkey is not null group by doc_id, rkey having count(*) > 1 union all
  select doc_id, 'numbering_issues', 'missing_reference_number', '[' || unnest(case when high - low < 999 then list_transform(range(low, high + 1), lambda x: cast(x as varchar)) else [low || '-' || high] end) || ']', null from holes where low <= high union all
  select doc_id, 'numbering_issues', 'incorrect_citation_order', '[' || arg_min(id, turn) || ']', cast(min(turn) as varchar) from turns where cast(id as bigint) <> turn group by 1 union all
  select doc_id, 'numbering_issues', 'bibliography_order', '[' || id || ']', cast(place as varchar) from placed where regexp_matches(id, '^[0-9]+$') and cast(id as bigint) <> place union all
  select doc_id, 'malformed_references', 'malformed_reference', id, null from refs where len(raw) < 15 or {n_words('raw')} < 4 or len(names) = 0 or title = '' or (yr = '' and doi = '') union all
  select doc_id, 'invalid_dois', 'invalid_doi', id, null from refs where regexp_matches(raw, '(?i)\bdoi\b|doi\.org') and not regexp_matches(raw, '(?i)10\.\d{{4,9}}/\S+') union all
  select doc_id, 'missing_dois', 'doi_review', id, null from refs where (venue <> '' or regexp_matches(raw, '(?i)\b(journal|transactions|proceedings|vol\.?|volume)\b')) and doi = '' union all
  select doc_id, 'references_wrong_order', 'author_year_reference_order', null, null from ordered where o <> list_sort(o) and {strict} union all
  select doc_id, 'invalid_structure', 'invalid_reference_structure', id, array_to_string(gap, ', ') from gaps_ where len(gap) > 0 and {strict} union all
  select doc_id, 'inconsistent_title_formatting', 'inconsistent_title_formatting', id, null from refs where upper(title) = title and lower(title) <> title and {n_words('title')} > 4 and {strict} union all
  select doc_id, 'inconsistent_authors', 'inconsistent_author_names', family, array_to_string(list_sort(list(distinct first_)), ', ') from families where family <> '' group by doc_id, family having count(distinct first_) > 1 union all
  select doc_id, 'inconsistent_years', 'inconsistent_year', rkey, array_to_string(list_sort(list(distinct yr)), ', ') from refs where starts_with(rkey, 'title:') and yr <> '' group by doc_id, rkey having count(distinct yr) > 1)"""


#: fixed: citations and entries with duplicates merged and numbers closed up.
FIXES = r"""
fx as (
  select *, case when doi <> '' then regexp_replace(raw, '(?i)(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?10\.\d{4,9}/\S+', doi) else raw end raw2, row_number() over w again, first_value(id) over w fst
  from refs window w as (partition by doc_id, coalesce(rkey, 'position:' || pos) order by pos)),
aliases as (select doc_id, id old, min(fst) nw from fx where again > 1 and id <> '' group by 1, 2),
kept as (select *, bool_and(regexp_matches(id, '^[0-9]+$') or id = '') over (partition by doc_id) numd, row_number() over (partition by doc_id order by pos) turn from fx where again = 1),
numbers as (select doc_id, case when id = '' then cast(turn as varchar) else id end old, min(cast(turn as varchar)) nw from kept where numd group by 1, 2),
numbered_ as (select spot, doc_id, unnest(ids) id, generate_subscripts(ids, 1) k from cites),
once as (select m.spot, m.doc_id, coalesce(a.nw, m.id) id, min(k) k from numbered_ m left join aliases a on a.doc_id = m.doc_id and a.old = m.id group by 1, 2, 3),
twice as (select m.spot, m.doc_id, coalesce(a.nw, m.id) id, min(k) k from once m left join numbers a on a.doc_id = m.doc_id and a.old = m.id group by 1, 2, 3),
lists as (select doc_id, spot, string_agg(id, ', ' order by k) ids from twice group by 1, 2),
fixed as (
  select c.doc_id, 'citation' kind_, c.spot pos, case when l.ids is not null and (c.kind = 'numeric' or regexp_full_match(trim(c.text), '\[.+\]')) then '[' || l.ids || ']' else c.text end as text
  from cites c left join lists l using (doc_id, spot) union all
  select doc_id, 'reference', pos, case when numd then '[' || turn || '] ' || regexp_replace(raw2, '^\[?\d+\]?\.?\s*', '') else raw2 end from kept)"""
