"""Queries on structure, citations, assessment, evaluation and relational state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.arrow import fingerprint
from palimpsest.operators import citations, compliance, dashboard, duplicates, evaluation, features, journals, overlap, quality, state, structure
from palimpsest.operators.graph import reliable
from palimpsest.plans import citation_sql, manuscript_sql
from palimpsest.plans.overlap import GROUPS
from palimpsest.session import table

#: Venue profiles and manuscripts of our own, for queries that no test table fits.
PROFILES = {
    "bases": {"plain": {"required_sections": ["abstract", "introduction", "methodology", "results", "references"], "word_limit": 400, "abstract_formatting": {"max_words": 40}, "keyword_formatting": {"required": True}}},
    "profiles": [
        {"extends": "plain", "journal_id": "crops", "journal_name": "Crop Monitoring", "article_type": "research article", "citation_style": "numeric", "scope_topics": ["crop disease", "leaf imaging", "plant pathology"], "required_declarations": ["funding"]},
        {"extends": "plain", "journal_id": "water", "journal_name": "Irrigation Letters", "article_type": "short communication", "citation_style": "author-year", "scope_topics": ["irrigation scheduling", "soil moisture"], "scope_aliases": {"drip irrigation": ["micro irrigation"]}, "word_limit": 60},
    ],
}
MANUSCRIPTS = (
    ("m1", "Leaf imaging for crop disease detection", "We propose a model that finds crop disease on leaf images.", ["crop disease", "imaging", "deep learning"], [
        ("Introduction", "introduction", "Little is known about early symptoms. Prior work used a baseline [2]."), ("Methods", "methodology", "We train a network on 1,200 images obtained from a public dataset with a random seed."),
        ("Results", "results", "Accuracy rose to 91.5% compared with the baseline [1]."), ("References", "references", "[1] Smith, J. Leaf images in practice. Journal of Plants, 2021. doi:10.1234/plants.1\n[3] Brown, A. Crop records. Proceedings of Fields, 2019.")], "Funding: this work was supported by a grant."),
    ("m2", "Irrigation scheduling from soil moisture", "Irrigation scheduling with soil moisture probes in dry regions.", ["irrigation"], [("Introduction", "introduction", "Various farms use several probes (many researchers agree)."), ("Body", "other", "Soil moisture was measured on farms. Soil moisture was measured on farms.")], ""),
    ("m3", "", "", [], [], "Too short."),
)
CITING = (
    (1, 0, "Shown before [1, 1] and again [3-4]; Smith (2020) agrees, Brown et al. (2021) does not."),
    (1, 1, "No mention here."),
    (2, 0, "[2] comes first, then [1]. A range [1-999999999999999999999999] is too long."),
    (2, 1, "Jones (2018) and [0-2] and [5-3]."),
    (3, 0, "Lee (2015) and Nobody (1999) cite [4], [2000000] and [4, 1, 4]."),
)
ENTRIES = (
    (1, 1, '[1] Smith, J. and Doe, R. "Overlap in long texts." Journal of Records, 2020. doi:10.1234/abc.1'),
    (1, 2, "[2] Brown, A. Sorting of pairs at scale. Proceedings of Sorting, 2019. https://example.org/p.pdf."),
    (1, 3, "[2] Brown, A. Sorting of pairs at scale. Proceedings of Sorting, 2018."),
    (2, 1, "1. Jones, K. THE STATE OF ALL TEXTS TODAY. 2018. DOI missing"),
    (2, 2, "Short one."),
    (3, 1, "[1] Lee, P. First study of records. Journal of Records, 2015. doi:10.5555/x.1"),
    (3, 2, "[4] Lee, Paul. Second study of records. Journal of Records, 2016. doi 10.55/y"),
    (3, 3, "[2000000] Kim, S. Third study of all records. Journal of Records, 2017. doi:10.5555/X.1"),
)


def manuscripts(spark: SparkSession) -> DataFrame:
    schema = f"doc_id string, title string, abstract string, keywords array<string>, sections {quality.SECTIONS}, paragraphs array<string>"
    parts = lambda m: [(f"SEC-{k:02d}", heading, kind, 1, content, k) for k, (heading, kind, content) in enumerate(m[4], 1)]
    return quality.complete(spark.createDataFrame([(*m[:4], parts(m), [s[2] for s in m[4]] + ([m[5]] if m[5] else [])) for m in MANUSCRIPTS], schema))


def as_manuscripts(docs: DataFrame) -> DataFrame:
    """Documents as manuscripts: their lines are paragraphs."""
    return quality.complete(docs.select("doc_id", F.split(T.text_of(F.col("text")), "\n").alias("paragraphs")))


def citing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CITING, "doc_id long, paragraph_index int, text string")


def entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "doc_id long, position long, raw_text string")


def citation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = citations.mentions(citing(spark))
    return rows.select("doc_id", F.col("paragraph_index").cast("long").alias("paragraph_index"), "text", "citation_type", F.col("position").cast("long").alias("position"))


def citation_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = citations.mentions(citing(spark)).where("citation_type = 'numeric'")
    return rows.select("doc_id", "text", F.array_join("reference_ids", ",").alias("ids"))


def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = citations.parse_references(entries(spark))
    return rows.select("doc_id", "position", "id", "year", "doi", "url", "venue")


def citation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.issues(citations.mentions(citing(spark)), citations.parse_references(entries(spark)), "author-year")


def citation_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites, refs = citations.fix_references(citations.mentions(citing(spark)), citations.parse_references(entries(spark)))
    left = cites.select("doc_id", F.lit("citation").alias("kind"), F.col("position").cast("long").alias("position"), "text")
    return left.unionByName(refs.select("doc_id", F.lit("reference").alias("kind"), F.col("position"), F.col("raw_text").alias("text")))


def section_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overlap.paragraphs(table(spark, sf_dir, "documents")).withColumnRenamed("paragraph_index", "pos")
    found = structure.sections(rows)
    return found.select("doc_id", "section_id", "position", "heading", F.length("content").cast("long").alias("n_chars"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pages of eight lines."""
    rows = overlap.paragraphs(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.floor(F.col("paragraph_index") / 8).alias("page"), F.col("paragraph_index").alias("k"), F.col("text").alias("line"))


def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.page_furniture(_pages(spark, sf_dir))


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n\n")
    return structure.page_spans(_pages(spark, sf_dir).groupBy("doc_id", "page").agg(text.alias("text")))


def methodology_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.with_evidence(as_manuscripts(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.col("methodology_score").cast("long").alias("methodology_score"), F.array_join("methodology_missing", "|").alias("missing"))


def writing_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.writing_findings(as_manuscripts(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.col("unit").cast("long").alias("unit"), F.col("k").cast("long").alias("k"), "finding", "is_issue")


def _assessed(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manuscripts with evidence, venues, and the manuscripts' citation issues."""
    rows = manuscripts(spark)
    venues = journals.profiles(spark, PROFILES)
    lines = rows.select("doc_id", F.posexplode("paragraphs").alias("paragraph_index", "text"))
    parts = rows.select("doc_id", F.posexplode("sections").alias("position", "s")).select("doc_id", "position", F.col("s.type").alias("type"), F.col("s.content").alias("content"))
    refs = citations.parse_references(structure.reference_lines(parts))
    issues = citations.issues(citations.mentions(lines), refs, "numeric")
    return quality.with_evidence(rows), venues, issues


def _with_profile(rows: DataFrame, venues: DataFrame) -> DataFrame:
    return rows.drop("article_type").crossJoin(venues.drop("scope_topics", "scope_aliases"))


def compliance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, venues, issues = _assessed(spark)
    return compliance.rules(_with_profile(rows, venues), issues)


def compliance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.summary(compliance_rules(spark, sf_dir))


def journal_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, venues, _ = _assessed(spark)
    found = journals.suitability(rows, venues)
    return found.select("doc_id", "journal_id", "scope_score", F.array_join("topics", "|").alias("topics"), "match_status", "formatting_score", "suitability", "suitable", "rank")


def _ready(spark: SparkSession) -> DataFrame:
    rows, venues, issues = _assessed(spark)
    first = venues.where("journal_id = 'crops'")
    rows = quality.with_writing(quality.with_completeness(_with_profile(rows, first)))
    fit = journals.suitability(rows.withColumn("article_type", F.lit("")), first).select("doc_id", F.bround(F.coalesce("suitability", F.lit(0.0)) * 100, 0).cast("int").alias("suitability_points"))
    scored = rows.join(quality.citation_scores(issues), "doc_id", "left").join(fit, "doc_id")
    required = F.col("required_sections")
    checks = [~F.col("word_limit_exceeded"), ~F.col("abstract_limit_exceeded"), ~F.col("keywords_required") | (F.size("keywords") > 0), F.size("uncaptioned_figures") == 0, F.size("uncaptioned_tables") == 0, F.size("unnumbered_equations") == 0]
    scored = scored.withColumns({"structure_score": F.bround(100.0 * F.size(F.array_intersect(required, quality.detected())) / F.size(required), 0).cast("int"), "citation_score": F.coalesce("citation_score", F.lit(0)), "formatting_score": F.bround(100.0 * sum((c.cast("int") for c in checks), F.lit(0)) / len(checks), 0).cast("int")})
    return quality.with_quality(quality.readiness(scored))


def readiness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ready(spark).select("doc_id", "quality_score", *quality.DIMENSIONS, "overall_readiness")


def improvement_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, venues, issues = _assessed(spark)
    full = quality.with_completeness(_with_profile(rows, venues.where("journal_id = 'crops'")))
    return quality.improvements(full, issues, quality.writing_findings(rows))


def prioritised_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.actions(improvement_list(spark, sf_dir), compliance_rules(spark, sf_dir).where("journal_id = 'crops'"))


def dashboard_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = reliable(_ready(spark).select("doc_id", "overall_readiness", "completeness_score"))
    nothing = ready.select("doc_id", F.lit(None).cast("double").alias("overall_similarity")).where("false")
    return dashboard.indicators(ready, compliance_score(spark, sf_dir).where("journal_id = 'crops'"), ready, nothing, improvement_list(spark, sf_dir))


def dimension_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.dimension_summary(_ready(spark), improvement_list(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score that is made of their length alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_scored(spark, sf_dir), 0.5)


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sweep(_scored(spark, sf_dir)).select("threshold", "tp", "fp", "fn", "tn", "f1")


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_threshold(_scored(spark, sf_dir))


def brier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.brier(_scored(spark, sf_dir)).select(F.round("brier", 9).alias("brier"), "n")


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.precision_recall(_scored(spark, sf_dir))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set (ids divisible by 20) against all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return evaluation.retrieval_ranks(docs.where("id % 20 = 0"), docs)


def retrieval_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir).where("rank <= 5").select("query_id", "corpus_id", "similarity", F.col("rank").cast("long").alias("rank"))


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = duplicates.near_groups(table(spark, sf_dir, "documents"))
    truth = groups.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "group_id").join(groups.select(F.col("doc_id").alias("corpus_id"), "group_id"), "group_id").where("query_id <> corpus_id").select("query_id", "corpus_id")
    return evaluation.recall_at(_retrieved(spark, sf_dir), truth)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled passage pairs: passages with a source that they match, and with the source after it, which they don't."""
    corpus = overlap.corpus_sentences(table(spark, sf_dir, "benchmark"))
    found = overlap.aligned(overlap.paragraphs(table(spark, sf_dir, "documents")), corpus)
    pairs = found.select(F.concat(F.lit("d"), "doc_id").alias("suspicious_document_id"), F.concat(F.lit("b"), "source_id").alias("source_document_id"), F.col("text").alias("suspicious_text"), "source_text", F.lit(1).alias("label"), "source_id")
    pairs = reliable(pairs)
    other = corpus.groupBy((F.col("source_id") - 1).alias("source_id")).agg(F.min("source_text").alias("other"))
    wrong = pairs.join(other, "source_id").select("suspicious_document_id", F.concat(F.lit("b"), F.col("source_id") + 1).alias("source_document_id"), "suspicious_text", F.col("other").alias("source_text"), F.lit(0).alias("label"), "source_id")
    return pairs.unionByName(wrong).drop("source_id")


def leak_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = duplicates.pair_groups(_labelled(spark, sf_dir), fingerprint)
    return rows.groupBy("leak_group").agg(F.count("*").alias("pairs"), F.sum("label").alias("positives"))


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("group", F.col("doc_id") % 97)
    return evaluation.split_groups(rows, "group", "quality")


def logreg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reliable(features.extracted(_labelled(spark, sf_dir)))
    names = tuple(n for n in features.NAMES if n != "semantic_cosine")
    scored = evaluation.predict(evaluation.train(rows, names), rows)
    return scored.select("suspicious_document_id", "source_document_id", "label", "score", "predicted", evaluation.lexical_baseline("word_overlap", "char_overlap").alias("baseline"), features.weighted_score_of(names).alias("weighted"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return state.latest(rows, ["user_id"], ["ts", "event_id"])


def folded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("big", F.when(F.col("value") > 50, F.col("value")))
    return state.folded(rows, ["user_id"], ["ts", "event_id"], ["event_type", "big"])


def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.next_version(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return state.page(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 25)


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.newest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], 3)
    return rows.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


def access_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, their customers as owners, their lines' suppliers as collaborators, the richest customers as admins."""
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("owner_id"))
    shared = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("user_id"), F.when(F.col("l_returnflag") == "R", "reviewer").when(F.col("l_returnflag") == "A", "editor").otherwise("viewer").alias("role"), F.when(F.col("l_linestatus") == "F", "accepted").otherwise("pending").alias("status"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") >= 9000).alias("is_admin"))
    rows = state.accessible(documents, shared, users).withColumn("may_edit", state.capability(F.col("role"), "edit"))
    return rows.groupBy("role", "may_edit").agg(F.count("*").alias("n"))


def named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers looked up among the suppliers, which have few of their numbers: the others are unknown."""
    rows = state.with_names(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "supplier"), "o_custkey", "s_suppkey", "s_name")
    return rows.groupBy("name").agg(F.count("*").alias("n"))


def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "struct<k:long>")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates as versions of each other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    rows = pairs.join(docs, "doc_id").join(docs.select(F.col("doc_id").alias("near_duplicate_of"), F.col("text").alias("before")), "near_duplicate_of")
    return state.version_diff(rows, "before", "text").select("doc_id", "near_duplicate_of", "blocks", "lines_added", "lines_removed")


QUERIES = (
    citation_mentions, citation_ranges, reference_parse, citation_issues, citation_fixes, section_segmentation, page_furniture, page_spans, methodology_checks, writing_findings,
    compliance_rules, compliance_score, journal_ranking, readiness_scores, improvement_list, prioritised_actions, dashboard_indicators, dimension_summary, confusion_metrics, threshold_sweep, best_threshold, brier_score, precision_recall,
    retrieval_ranks, retrieval_recall, leak_groups, group_split, logreg_scores, latest_state, folded_state, next_version, paged_listing, notifications, access_roles, named_rows,
    json_columns, version_diff,
)

_quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
_values = lambda rows: ", ".join(f"({', '.join(map(_quote, r))})" for r in rows)
_CITING = rf"""
paras(doc_id, paragraph_index, text) as (values {_values(CITING)}),
{citation_sql.MENTIONS}"""
_SCORED = "scored as (select doc_id, least(1.0::double, n_chars / 4000.0::double) s, quality l from documents join labels using (doc_id))"
_CELLS = "count(*) filter (s >= t and l = 1) tp, count(*) filter (s >= t and l <> 1) fp, count(*) filter (s < t and l = 1) fn, count(*) filter (s < t and l <> 1) tn"
_LINES = "lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 k from documents)"
_any = lambda col, words: "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"
_MISSING = ", ".join(f"case when not regexp_matches(t, '{p}') then '{n}' end" for n, p in quality.METHOD_CHECKS.items())
_RANKS = r"""
sets as (select doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+(?:[''’\-][A-Za-z0-9]+)*'), lambda x: lower(x))) w from documents),
tokens as (select doc_id, len(w) n, unnest(w) t from sets),
shared as (select a.doc_id q, b.doc_id c, a.n, b.n m, count(*) k from tokens a join tokens b using (t) where a.doc_id % 20 = 0 and b.doc_id <> a.doc_id group by all),
ranks as (select q query_id, c corpus_id, k / (n + m - k) similarity, row_number() over (partition by q order by k / (n + m - k) desc, c) "rank" from shared)"""

SQL = {
    "citation_mentions": f"""
with {_CITING}
select cast(doc_id as bigint) doc_id, cast(paragraph_index as bigint) paragraph_index, m as text, case when starts_with(m, '[') then 'numeric' else 'author_year' end citation_type,
  row_number() over (partition by doc_id order by paragraph_index, k) "position" from each""",
    "citation_ranges": rf"""
with {_CITING},
parts as (
  select row_number() over () r, doc_id, m, string_split(regexp_replace(m, '[\[\]\s]', '', 'g'), ',') p from each where starts_with(m, '[')),
b as (
  select r, doc_id, m, list_transform(p, lambda x: try_cast(string_split(x, '-')[1] as bigint)) lo, list_transform(p, lambda x: try_cast(string_split(x, '-')[-1] as bigint)) hi from parts)
select cast(doc_id as bigint) doc_id, m as text,
  case when list_bool_and(list_transform(range(1, len(lo) + 1), lambda i: coalesce(lo[i] >= 1 and hi[i] >= lo[i] and hi[i] - lo[i] <= 999, false)))
    then array_to_string(flatten(list_transform(range(1, len(lo) + 1), lambda i: range(lo[i], hi[i] + 1))), ',') else '' end ids
from b""",
    "reference_parse": rf"""
with e(doc_id, "position", raw) as (values {_values(ENTRIES)}),
t as (select *, regexp_extract(raw, '^\[?(\d+)\]?\.?\s*(.+)', 1) n, case when regexp_matches(raw, '^\[?(\d+)\]?\.?\s*(.+)') then regexp_extract(raw, '^\[?(\d+)\]?\.?\s*(.+)', 2) else raw end body from e)
select cast(doc_id as bigint) doc_id, cast("position" as bigint) "position", case when n <> '' then n else cast("position" as varchar) end id, nullif(regexp_extract(body, '\b((?:19|20)\d{{2}}[a-z]?)\b', 1), '') "year",
  nullif(lower(rtrim(regexp_extract(body, '(?i)10\.\d{{4,9}}/\S+'), '.,;)')), '') doi, nullif(rtrim(regexp_extract(body, 'https?://\S+'), '.,'), '') url,
  nullif(trim(regexp_extract(body, '(?i)\b(IEEE|ACM|Nature|Springer|Elsevier|Wiley|MDPI|Proceedings|Journal|Transactions)[^.]{{0,80}}'), ' .,'), '') venue
from t""",
    "citation_issues": f"""
with {_CITING}, {citation_sql.CITES}, {citation_sql.parsed('values ' + _values(ENTRIES))}, {citation_sql.issues('author-year')}
select cast(doc_id as bigint) doc_id, category, kind_ as "type", case when kind_ = 'invalid_numeric_citation' then 'high' else case category {" ".join(f"when '{k}' then '{v}'" for k, v in citations.SEVERITY.items())} end end severity, citation, detail from found""",
    "citation_fixes": f"with {_CITING}, {citation_sql.CITES}, {citation_sql.parsed('values ' + _values(ENTRIES))}, {citation_sql.FIXES} select cast(doc_id as bigint) doc_id, kind_ kind, pos \"position\", text from fixed",
    "compliance_rules": f"with {manuscript_sql.compliance_rules(MANUSCRIPTS, PROFILES)} select * from ruled",
    "compliance_score": f"with {manuscript_sql.compliance_rules(MANUSCRIPTS, PROFILES)}, {manuscript_sql.SCORE}",
    "journal_ranking": manuscript_sql.journal_ranking(MANUSCRIPTS, PROFILES),
    "section_segmentation": rf"""
with {_LINES},
s as (select doc_id, k, trim(line, ' ' || chr(9) || chr(13)) t from lines),
h as (
  select *, (regexp_matches(t, '^(?:\d+|[IVXLC]+)(?:[.)]|\s+)') or regexp_matches(t, '^(?:\d+(?:\.\d+)*[.)]?\s+)?[A-Z][^.!?]{{2,80}}$')) and len(regexp_extract_all(t, '\S+')) <= 12 as is_head from s where t <> ''),
n as (select *, sum(is_head::int) over (partition by doc_id order by k) n, bool_or(is_head) over (partition by doc_id) any_head from h)
select doc_id, printf('SEC-%02d', greatest(n, 1)::bigint) section_id, greatest(n, 1)::bigint "position", coalesce(max(t) filter (is_head), 'Body') heading,
  cast(len(coalesce(string_agg(t, chr(10) order by k) filter (not is_head), '')) as bigint) n_chars
from n where n > 0 or not any_head group by doc_id, n""",
    "page_furniture": f"""
with {_LINES},
p as (
  select doc_id, k // 8 page, line, row_number() over (partition by doc_id, k // 8 order by k) up, row_number() over (partition by doc_id, k // 8 order by k desc) down from lines),
c as (select doc_id, line, sum((up <= 2)::int + (down <= 2)::int) n from p where len(line) >= 4 group by 1, 2),
m as (select doc_id, count(distinct page) pages from p group by 1)
select doc_id, line from c join m using (doc_id) where pages >= 2 and n >= greatest(2, floor(pages * 0.6))""",
    "page_spans": f"""
with {_LINES},
p as (select doc_id, k // 8 page, string_agg(line, chr(10) || chr(10) order by k) t from lines group by 1, 2),
o as (select *, coalesce(sum(len(t)) over before, 0) b, coalesce(max((len(t) > 0)::int) over before, 0) opened from p window before as (partition by doc_id order by page rows between unbounded preceding and 1 preceding)),
s as (select *, b + sum(2 * opened) over (partition by doc_id order by page) st from o)
select doc_id, page, cast(st as bigint) "start", cast(st + len(t) as bigint) "end" from s""",
    "methodology_checks": f"""
with t as (select doc_id, lower(coalesce(text, '')) t from documents),
m as (select doc_id, list_filter([{_MISSING}], lambda x: x is not null) missing from t)
select doc_id, cast(round_even((14 - len(missing)) * 100.0 / 14, 0) as bigint) methodology_score, coalesce(array_to_string(missing, '|'), '') missing from m""",
    "writing_findings": rf"""
with {_LINES},
p as (
  select doc_id, k unit, string_split(regexp_replace(trim(line), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) s from lines),
s as (select doc_id, unit, unnest(s) t, generate_subscripts(s, 1) - 1 k from p),
f as (
  select *, lower(t) low, len(regexp_extract_all(t, '\S+')) n, regexp_matches(t, '\d') digit from s where t <> ''),
g as (select *, row_number() over (partition by doc_id, regexp_replace(low, '\s+', ' ', 'g') order by unit, k) > 1 again from f),
x as (
  select doc_id, unit, k, list_filter([case when n > 35 then 'long_sentence' end, case when {_any('low', quality.INFORMAL)} then 'informal' end,
    case when {_any('low', quality.VAGUE)} and not digit then 'vague_quantity' end, case when regexp_matches(low, '{quality.COMPARATIVE}') and not digit then 'unsupported_comparison' end,
    case when regexp_matches(low, '{quality.PASSIVE}') and n > 18 then 'long_passive' end, case when again then 'repeated' end], lambda v: v is not null) flags from g),
c as (select *, coalesce(sum(len(flags)) over (partition by doc_id order by unit, k rows between unbounded preceding and 1 preceding), 0) before from x where len(flags) > 0)
select doc_id, unit, k, finding, finding <> 'long_passive' is_issue from (select doc_id, unit, k, unnest(flags) finding from c where before < 20)""",
    "confusion_metrics": f"""
with {_SCORED}, c as (select {_CELLS} from (select *, 0.5 t from scored))
select *, (tp + tn) / (tp + fp + fn + tn) accuracy, case when tp + fp = 0 then 0.0 else tp / (tp + fp) end "precision", case when tp + fn = 0 then 0.0 else tp / (tp + fn) end recall,
  case when fp + tn = 0 then 0.0 else fp / (fp + tn) end false_positive_rate, case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end f1 from c""",
    "threshold_sweep": f"""
with {_SCORED}, steps as (select unnest(range(1, 20)) * 5 / 100.0::double t), c as (select t threshold, {_CELLS} from scored, steps group by t)
select *, case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end f1 from c""",
    "best_threshold": f"""
with {_SCORED}, steps as (select unnest(range(1, 20)) * 5 / 100.0::double t), c as (select t threshold, {_CELLS} from scored, steps group by t),
f as (select threshold, case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end f1 from c)
select threshold, f1 from f order by f1 desc, threshold desc limit 1""",
    "brier_score": f"with {_SCORED} select round(avg((s - l) * (s - l)), 9) brier, count(*) n from scored",
    "precision_recall": f"""
with {_SCORED}, g as (select s threshold, sum((l = 1)::int) hits, count(*) n from scored group by 1)
select threshold, sum(hits) over (order by threshold desc) / sum(n) over (order by threshold desc) "precision", sum(hits) over (order by threshold desc) / sum(hits) over () recall from g""",
    "retrieval_ranks": f'with {_RANKS} select * from ranks where "rank" <= 5',
    "retrieval_recall": f"""
with recursive {GROUPS}, {_RANKS},
truth as (select a.doc_id query_id, b.doc_id corpus_id from groups a join groups b using (group_id) where a.doc_id % 20 = 0 and b.doc_id <> a.doc_id)
select count(*) queries, avg(case when "rank" <= 1 then 1.0 else 0.0 end) recall_at_1, avg(case when "rank" <= 5 then 1.0 else 0.0 end) recall_at_5, avg(case when "rank" <= 10 then 1.0 else 0.0 end) recall_at_10
from truth left join ranks using (query_id, corpus_id)""",
    "latest_state": """
select user_id, max(ts) ts, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type, arg_max("value", (ts, event_id)) "value" from events group by 1""",
    "folded_state": """
select user_id, arg_max(event_type, (ts, event_id)) event_type, arg_max("value", (ts, event_id)) filter ("value" > 50) big from events group by 1""",
    "next_version": "select l_orderkey, cast(max(l_linenumber) + 1 as bigint) next_version from lineitem group by 1",
    "paged_listing": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50",
    "notifications": """
select user_id, event_id, r as "rank" from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 3""",
    "access_roles": """
with a as (
  select o_custkey u, o_orderkey d, 0 o from orders union all
  select l_suppkey, l_orderkey, case l_returnflag when 'A' then 2 when 'R' then 3 else 4 end from lineitem where l_linestatus = 'F' union all
  select c_custkey, null, 1 from customer where c_acctbal >= 9000),
r as (select u, d, min(o) o from a group by 1, 2)
select case o when 0 then 'owner' when 1 then 'admin' when 2 then 'editor' when 3 then 'reviewer' else 'viewer' end "role", o <= 2 may_edit, count(*) n from r group by o""",
    "named_rows": "select coalesce(s_name, 'Unknown') \"name\", count(*) n from orders left join supplier on o_custkey = s_suppkey group by 1",
    "json_columns": "select event_type, count(json_extract(props, '$.k')) n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) total from events group by 1",
}
