"""DuckDB SQL of the oracles on manuscripts and venues: rules of compliance, their score, and the ranking of venues."""

from __future__ import annotations

from palimpsest.operators import compliance, journals, quality
from palimpsest.plans import citation_sql


def value(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, (list, tuple)):
        return f"[{', '.join(map(value, x))}]::varchar[]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def rows(table) -> str:
    return ", ".join(f"({', '.join(map(value, r))})" for r in table)


def _venues(config: dict) -> str:
    """Profiles as rows: journal_id, type, word_limit, abstract_limit, keywords_required, required sections and declarations, topics with aliases."""
    out = []
    for p in journals.resolve(config):
        aliases = [x for key, others in (p.get("scope_aliases") or {}).items() for x in (key, *others)]
        out.append((p["journal_id"], p["article_type"], p.get("word_limit"), (p.get("abstract_formatting") or {}).get("max_words"), bool((p.get("keyword_formatting") or {}).get("required")), p.get("required_sections") or [], p.get("required_declarations") or [], [*(p.get("scope_topics") or []), *aliases]))
    return rows(out)


def tables(manuscripts, config: dict) -> str:
    """ms and venue, and what is read off a manuscript's text."""
    found = [(m[0], m[1], m[2], m[3], [s[0] for s in m[4]], [s[1] for s in m[4]], [s[2] for s in m[4]], [s[2] for s in m[4]] + ([m[5]] if m[5] else [])) for m in manuscripts]
    any_of = lambda c, phrases: "(" + " or ".join(f"contains({c}, '{p}')" for p in phrases) + ")"
    intro = ", ".join(map(value, quality.ALIASES.get("introduction", ("introduction",))))
    said = ", ".join(f"case when regexp_matches(lower(terms), {value(p)}) or list_contains(detected, '{n}') then '{n}' end" for n, p in compliance.DECLARATIONS.items())
    return f"""
ms(doc_id, title, abstract, keywords, heads, types, contents, lines) as (values {rows(found)}),
venue(journal_id, type_, word_limit, abstract_limit, keywords_required, required_sections, required_declarations, topics) as (values {_venues(config)}),
m1_ as (
  select *, list_distinct(list_concat(list_transform(types, lambda x: replace(lower(x), ' ', '_')), list_transform(heads, lambda x: replace(lower(x), ' ', '_')))) detected,
    concat_ws(' ', title, abstract, array_to_string(list_transform(range(1, len(heads) + 1), lambda i: case when contents[i] <> '' then contents[i] else heads[i] end), ' '), array_to_string(keywords, ' ')) terms,
    lower(array_to_string(list_transform(list_filter(range(1, len(heads) + 1), lambda i: lower(types[i]) in ({intro}) or lower(heads[i]) in ({intro})), lambda i: contents[i]), ' ')) intro
  from ms),
m2_ as (
  select *, {citation_sql.n_words('terms')} word_count, {citation_sql.n_words('abstract')} abstract_words, list_filter([{said}], lambda x: x is not null) declared, {any_of('intro', quality.GAP)} gap from m1_)"""


def compliance_rules(manuscripts, config: dict) -> str:
    """ruled: a row for each rule of each manuscript and venue."""
    plain = "replace(replace(lower(trim(type_)), '-', '_'), ' ', '_')"
    kind = "case " + " ".join(f"when {plain} = '{k}' then '{v}'" for k, v in [*((k, k) for k in compliance.ARTICLE_TYPES), *compliance.OTHER_NAMES.items()]) + " else 'original_research' end"
    preset = lambda k: "case " + " ".join(f"when kind = '{n}' then {value(x[k])}" for n, x in compliance.ARTICLE_TYPES.items()) + " end"
    counted = " union all ".join(
        f"select doc_id, journal_id, 'citations.{c}' rule_id, 'citations' category, case when n = 0 then 'passed' else '{'failed' if c in compliance.FAILING_CITATIONS else 'warning'}' end status, 'none' expected, cast(n as varchar) actual from (select doc_id, journal_id, (select count(*) from found f where f.doc_id = c_.doc_id and f.category = '{c}') n from c_)"
        for c in compliance.CITATION_RULES
    )
    within = lambda n, most: f"case when coalesce({most}, 0) <= 0 then 'not_applicable' when {n} <= {most} then 'passed' else 'failed' end, cast({most} as varchar), cast({n} as varchar)"
    return f"""
{tables(manuscripts, config)},
paras as (select doc_id, unnest(lines) as text, generate_subscripts(lines, 1) - 1 as paragraph_index from ms),
{citation_sql.MENTIONS}, {citation_sql.CITES},
{citation_sql.parsed('''select doc_id, row_number() over (partition by doc_id order by k), l from (
  select doc_id, trim(unnest(string_split(body, chr(10)))) l, generate_subscripts(string_split(body, chr(10)), 1) k from (select doc_id, contents[list_position(types, 'references')] body from ms where list_contains(types, 'references'))) where l <> ''
''')}, {citation_sql.issues('numeric')},
k_ as (select *, {kind} kind from m2_, venue),
r_ as (select *, list_distinct(list_concat({preset(0)}, required_sections, required_declarations)) required, {preset(1)} opt from k_),
c_ as (
  select *, list_filter(opt, lambda x: not list_contains(required, x)) optional_,
    list_concat(detected, declared, list_filter([case when title <> '' then 'title' end, case when trim(abstract) <> '' then 'abstract' end, case when len(keywords) > 0 then 'keywords' end, case when gap then 'research_gap' end], lambda x: x is not null)) components from r_),
ruled as (
  select doc_id, journal_id, 'structure.' || c rule_id, 'structural_completeness' category, case when list_contains(components, c) then 'passed' else 'failed' end status, 'present' expected, case when list_contains(components, c) then 'present' else 'missing' end actual
  from (select *, unnest(required) c from c_) union all
  select doc_id, journal_id, 'structure.optional.' || c, 'structural_completeness', case when list_contains(components, c) then 'passed' else 'not_applicable' end, 'optional', case when list_contains(components, c) then 'present' else 'not present' end from (select *, unnest(optional_) c from c_) union all
  select doc_id, journal_id, 'declaration.' || c, 'declarations', case when list_contains(declared, c) then 'passed' else 'failed' end, 'present', case when list_contains(declared, c) then 'present' else 'missing' end from (select *, unnest(required_declarations) c from c_) union all
  select doc_id, journal_id, 'length.word_limit', 'formatting', {within('word_count', 'word_limit')} from c_ union all
  select doc_id, journal_id, 'length.abstract_limit', 'formatting', {within('abstract_words', 'abstract_limit')} from c_ union all
  select doc_id, journal_id, 'formatting.keywords', 'formatting', case when len(keywords) > 0 then 'passed' else 'failed' end, 'keywords', cast(len(keywords) as varchar) from c_ where keywords_required union all
  select doc_id, journal_id, unnest(['figures.captions', 'tables.captions']), 'figures_tables', 'not_applicable', 'a caption each', '0' from c_ union all
  select doc_id, journal_id, 'figures.table.numbering', 'figures_tables', 'manual_review', 'sequential', null from c_ union all
  select doc_id, journal_id, 'citations.style', 'citations', 'manual_review', null, null from c_ union all
  select doc_id, journal_id, 'submission.file_format', 'submission', 'passed', 'docx', 'docx' from c_ union all
  select doc_id, journal_id, 'length.page_limit', 'formatting', 'not_applicable', null, null from c_ union all
  {counted})"""


SCORE = """
counts as (
  select doc_id, journal_id, count(*) filter (status = 'passed') passed, count(*) filter (status = 'failed') failed, count(*) filter (status = 'warning') warning, count(*) filter (status = 'manual_review') manual_review, count(*) filter (status = 'not_applicable') not_applicable
  from ruled group by 1, 2)
select *, case when passed + failed + warning > 0 then cast(round_even(100.0 * passed / (passed + failed + warning), 0) as int) end compliance_score,
  case when failed > 0 then 'failed' when warning + manual_review > 0 then 'warning' else 'passed' end overall_status from counts"""


def journal_ranking(manuscripts, config: dict) -> str:
    stop = value(journals.STOP_WORDS)
    words = lambda c: f"list_distinct(regexp_extract_all({c}, '[a-z0-9]+'))"
    squeezed = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
    fields = {"title": "title", "abstract": "abstract", "keywords": "array_to_string(keywords, ' ')", "sections": "array_to_string(list_transform(range(1, len(heads) + 1), lambda i: concat_ws(' ', heads[i], contents[i])), ' ')", "subject_area": "''"}
    shared = lambda f: f"len(list_intersect(w, {words(f'f_{f}')}))"
    strength = lambda f, x: f"case when regexp_matches(f_{f}, '\\b' || topic || '\\b') then {x} when len(w) = 1 and {shared(f)} > 0 then {x} * 0.8 when {shared(f)} >= 2 and {shared(f)} / len(w) >= 0.67 then {x} * 0.65 else 0.0 end"
    return f"""
with {tables(manuscripts, config)},
d_ as (select *, {', '.join(f'{squeezed(c)} f_{n}' for n, c in fields.items())} from m2_),
e_ as (select *, len(list_filter({words(" || ' ' || ".join(f'f_{n}' for n in fields))}, lambda x: not list_contains({stop}, x))) >= 6 enough from d_),
wanted as (
  select journal_id, topic, list_filter({words('topic')}, lambda x: not list_contains({stop}, x)) w from (select distinct journal_id, {squeezed('t')} topic from (select journal_id, unnest(topics) t from venue)) where topic <> ''),
sizes as (select journal_id, count(*) n from wanted where len(w) > 0 group by 1),
hits as (
  select doc_id, journal_id, topic, least(1.0::double, s / 1.5) s from (select doc_id, journal_id, topic, cast(greatest({', '.join(strength(f, x) for f, x in journals.FIELDS.items())}) as double) s from e_, wanted where enough and len(w) > 0) where s > 0),
by_ as (select doc_id, journal_id, sum(s) total, string_agg(topic, '|' order by s desc, topic) topics from hits group by 1, 2),
s_ as (
  select e.*, v.*, case when not enough then 'insufficient_content' when n is null then 'scope_unavailable' else 'evaluated' end match_status, case when enough and n is not null then round_even(coalesce(total, 0.0) / n, 4) end scope_score, coalesce(b.topics, '') found_topics,
    list_filter([len(list_filter(required_sections, lambda x: not list_contains(detected, x))) = 0, case when word_limit > 0 then word_count > 0 and word_count <= word_limit end, case when abstract_limit > 0 then abstract_words > 0 and abstract_words <= abstract_limit end, case when keywords_required then len(keywords) > 0 end], lambda x: x is not null) checks
  from e_ e cross join venue v left join sizes z on z.journal_id = v.journal_id left join by_ b on b.doc_id = e.doc_id and b.journal_id = v.journal_id),
f_ as (select *, cast(round_even(100.0 * len(list_filter(checks, lambda x: x)) / len(checks), 0) as int) formatting_score from s_),
g_ as (select *, case when match_status = 'evaluated' then round_even((scope_score * {journals.SCOPE} + formatting_score / 100.0 * {journals.FORMAT}) / ({journals.SCOPE} + {journals.FORMAT}), 4) end suitability from f_)
select doc_id, journal_id, scope_score, found_topics topics, match_status, formatting_score, suitability, coalesce(suitability, 0.0) >= {journals.SUITABLE} suitable,
  row_number() over (partition by doc_id order by coalesce(suitability, -1.0) desc, coalesce(scope_score, -1.0) desc, journal_id) "rank" from g_"""
