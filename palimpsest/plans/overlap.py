"""Queries on text, overlap, duplicates and features, over documents (manuscripts) and benchmark (corpus)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import duplicates, features, overlap, report
from palimpsest.operators.graph import reliable
from palimpsest.plans.prelude import ALIGNED, PASSAGES, words
from palimpsest.session import table


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.passages(overlap.paragraphs(table(spark, sf_dir, "documents")))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).where("kind = 'scored'")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.corpus_sentences(table(spark, sf_dir, "benchmark"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.aligned(overlap.paragraphs(table(spark, sf_dir, "documents")), _corpus(spark, sf_dir))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentence_texts(F.col("text"))).alias("sentence_index", "sentence"))
    return rows.select("doc_id", F.col("sentence_index").cast("long").alias("sentence_index"), "sentence")


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.col("tokens")
    rows = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("tokens"), T.alnum_words(F.col("text")).alias("plain"))
    return rows.select("doc_id", F.size(tokens).cast("long").alias("n_words"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"), F.size(F.array_distinct("plain")).cast("long").alias("n_alnum"), F.size(F.filter(tokens, lambda t: F.length(t) >= 2)).cast("long").alias("n_long"))


def word_ngram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select(T.words(F.col("text")).alias("tokens"))
    grams = tokens.select(F.explode(T.ngrams(F.col("tokens"), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "gram").limit(50)


def passage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("k", "passage"))
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), "passage")


def html_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", T.without_tags(F.col("html")).alias("text"))
    return rows.select("page_id", F.length("text").cast("long").alias("n_chars"), T.word_count(F.col("text")).cast("long").alias("n_words"), F.md5("text").alias("text_md5"))


def boilerplate_and_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.exclusions(_found(spark, sf_dir), table(spark, sf_dir, "documents"))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overlap.candidates(_scored(spark, sf_dir), _corpus(spark, sf_dir))
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("paragraph_index", "sentence_index")], "source_id", F.col("source_sentence").cast("long").alias("source_sentence"), "shared", F.col("candidate_rank").cast("long").alias("candidate_rank"))


def alignment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(spark, sf_dir)
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("paragraph_index", "sentence_index")], "source_id", *[F.col(c).cast("long").alias(c) for c in ("source_sentence", "matched")], "coverage", "ratio")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.matches(aligned(spark, sf_dir))


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _matches(spark, sf_dir)
    return rows.select("doc_id", "match_id", *[F.col(c).cast("long").alias(c) for c in ("paragraph_index", "sentence_index")], "source_id", F.col("source_sentence").cast("long").alias("source_sentence"), "method", "classification", "matched_words", "similarity")


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    return overlap.source_summary(_matches(spark, sf_dir), overlap.exclusions(found))


def document_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    rows = overlap.document_report(_matches(spark, sf_dir), overlap.exclusions(found, table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "scored_words", "boilerplate_passages", "matched_words", "suspected_words", "match_count", "source_count", "exact_count", "overall_similarity", "score_status")


def match_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.warnings(_matches(spark, sf_dir))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_duplicates(table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_groups(table(spark, sf_dir, "documents"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match as a pair of texts: the passage and the source sentence."""
    return aligned(spark, sf_dir).select("doc_id", "paragraph_index", "sentence_index", "source_id", "source_sentence", F.col("source_text"), F.col("text").alias("suspicious_text"))


def lexical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.lexical(_pairs(spark, sf_dir))
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("paragraph_index", "sentence_index")], "source_id", F.col("source_sentence").cast("long").alias("source_sentence"), "word_overlap", "char_overlap", "distinctive_phrase_ratio", "passage_length_ratio")


UNICODE_WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"


def exact_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and near phrases of matched pairs; their words are read from the original text by the offsets found."""
    rows = features.exact_phrases(_pairs(spark, sf_dir), least=3, threshold=0.6).select("doc_id", "paragraph_index", "sentence_index", "source_id", "source_sentence", F.explode("phrases").alias("p"))
    phrase = F.array_join(F.regexp_extract_all(F.lower("p.matched_text"), F.lit(UNICODE_WORD), F.lit(0)), " ")
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("paragraph_index", "sentence_index")], "source_id", F.col("source_sentence").cast("long").alias("source_sentence"), phrase.alias("phrase"), F.col("p.matched_tokens").cast("long").alias("matched_tokens"), "p.score")


def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.tfidf(table(spark, sf_dir, "benchmark"), "item_id", "text", most=None)
    return rows.select(F.col("id").alias("item_id"), "term", F.round("weight", 6).alias("weight"))


def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against the item after each."""
    items = table(spark, sf_dir, "benchmark")
    vectors = features.tfidf(items, "item_id", "text", most=None)
    pairs = items.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return features.tfidf_cosine(pairs, vectors, vectors)


def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted score of matched pairs from all features that need no embedding model; terms' frequencies are the benchmark's."""
    rows = features.extracted(_pairs(spark, sf_dir), fitted_on=table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))
    score = features.weighted_score_of(tuple(n for n in features.NAMES if n != "semantic_cosine"))
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("paragraph_index", "sentence_index")], "source_id", F.col("source_sentence").cast("long").alias("source_sentence"), "exact_phrase_match", "tfidf_cosine", score.alias("score"), F.when(score >= features.SUSPICIOUS, "suspicious").otherwise("clean").alias("label"))


def classifier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten candidates of each passage, which a classifier would score."""
    rows = overlap.candidates(_scored(spark, sf_dir), _corpus(spark, sf_dir), most=10)
    return rows.groupBy("source_id").agg(F.count("*").alias("candidates"), F.max("shared").alias("most_shared"))


def offset_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 100 characters of the benchmark's items, and the page on which each sentence starts."""
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 100).cast("int")), lambda k: F.struct((k + 1).alias("page"), (k * 100).alias("start"), ((k + 1) * 100).alias("end")))
    pages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), spans.alias("spans"))
    rows = _corpus(spark, sf_dir).join(pages, "source_id")
    return rows.select("source_id", F.col("source_sentence").cast("long").alias("source_sentence"), overlap.page_of(F.col("spans"), F.col("source_start")).cast("long").alias("page"))


def semantic_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), features.unit(F.col("embedding")).alias("vector"))
    found = features.best_match(vectors.where("id % 20 = 0"), vectors, threshold=-1.0)
    return found.select("query_id", "corpus_id", F.round("similarity", 6).alias("similarity"))


def _semantic(spark: SparkSession, sf_dir: str, lexical: DataFrame) -> DataFrame:
    """Vectors as passages (the stated query set: ids divisible by 20) of documents without a lexical match, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), features.unit(F.col("embedding")).alias("vector"))
    passages = vectors.where("source_id % 20 = 0").select(F.col("source_id").alias("doc_id"), F.lit(0).alias("paragraph_index"), F.lit(0).alias("sentence_index"), "vector", F.concat(F.lit("v"), "source_id").alias("own"))
    return report.semantic_matches(passages.join(lexical.select("doc_id").distinct(), "doc_id", "left_anti"), vectors.withColumn("source_id", F.concat(F.lit("v"), "source_id")), 0.4)


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lexical, semantic and external matches; an exact copy counts as what an external provider has found."""
    lexical = reliable(_matches(spark, sf_dir))
    external = duplicates.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("x"), "duplicate_of").alias("source_id"), F.lit(1.0).alias("similarity"))
    return lexical, _semantic(spark, sf_dir, lexical), external


def semantic_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _semantic(spark, sf_dir, _matches(spark, sf_dir))
    return rows.select("doc_id", "source_id", "similarity", "method", "classification")


def match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.group_sources(report.groups(*_routed(spark, sf_dir)))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = overlap.exclusions(_found(spark, sf_dir), table(spark, sf_dir, "documents"))
    return report.summary(*_routed(spark, sf_dir), excluded).drop("references_words", "boilerplate_passages")


QUERIES = (sentence_split, token_stats, word_ngram_topk, passage_windows, html_text_scan, boilerplate_and_exclusions, candidate_pairs, alignment_scores, match_report, source_summary, document_overlap, match_warnings, exact_duplicates, near_duplicates, duplicate_groups, lexical_features, exact_phrases, tfidf_terms, tfidf_cosine, weighted_score, classifier_candidates, offset_to_page, semantic_best_match, semantic_matches, match_groups, report_summary)

_ALNUM = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_SHINGLED = f"""
tk as (select doc_id, {_ALNUM} w from documents),
sh as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from tk where len(w) >= LEAST_WORDS)),
sz as (select doc_id, count(*) n from sh group by 1),
jac as (
  select x.doc_id a, y.doc_id b from sh x join sh y using (s) join sz m on m.doc_id = x.doc_id join sz n on n.doc_id = y.doc_id
  where x.doc_id <> y.doc_id group by 1, 2, m.n, n.n having count(*) >= 0.8 * (m.n + n.n - count(*)))"""
#: groups: doc_id and group_id, the components of near duplicates.
GROUPS = f"""{_SHINGLED.replace('LEAST_WORDS', '0')},
reach(a, b) as (select a, b from jac union select r.a, j.b from reach r join jac j on r.b = j.a),
groups as (select d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) group_id from documents d left join reach r on r.a = d.doc_id group by d.doc_id)"""
_GRAMS = lambda c, n: f"list_transform(range(1, len({c}) - {n - 1} + 1), lambda i: array_to_string({c}[i : i + {n - 1}], ' '))"
_CHARS = lambda c, n: f"list_transform(range(1, len({c}) - {n - 1} + 1), lambda i: substr({c}, i, {n}))"

_TFIDF = r"""
w as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') w from benchmark),
t as (
  select item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) term from w),
tf as (select item_id, term, count(*) tf from t group by 1, 2),
df as (select term, count(*) df from tf group by 1),
x as (select item_id, term, tf * (ln((1 + (select count(*) from benchmark where trim(text) <> '')) / (1 + df)) + 1) v from tf join df using (term)),
vectors as (select item_id, term, v / sqrt(sum(v * v) over (partition by item_id)) weight from x)"""
_LEXICAL = f"""
t as (
  select a.doc_id, a.paragraph_index, a.sentence_index, a.source_id, a.source_sentence, c.tokens x, p.tokens y,
    lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))) s, lower(trim(regexp_replace(p.text, '\\s+', ' ', 'g'))) u
  from aligned a join passages p using (doc_id, paragraph_index, sentence_index) join corpus c using (source_id, source_sentence)),
g as (
  select *, list_distinct(list_concat(x, {_GRAMS('x', 2)})) gx, list_distinct(list_concat(y, {_GRAMS('y', 2)})) gy,
    list_distinct(list_concat({_CHARS('s', 3)}, {_CHARS('s', 4)}, {_CHARS('s', 5)})) cx, list_distinct(list_concat({_CHARS('u', 3)}, {_CHARS('u', 4)}, {_CHARS('u', 5)})) cy
  from t),
lexical as (
  select doc_id, cast(paragraph_index as bigint) paragraph_index, cast(sentence_index as bigint) sentence_index, source_id, cast(source_sentence as bigint) source_sentence,
    round_even(len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy))), 4) word_overlap, round_even(len(list_intersect(cx, cy)) / len(list_distinct(list_concat(cx, cy))), 4) char_overlap,
    round_even((len(list_distinct(list_concat(x, y))) - len(list_intersect(list_distinct(x), list_distinct(y)))) / len(list_distinct(list_concat(x, y))), 4) distinctive_phrase_ratio,
    least(len(x), len(y)) / greatest(len(x), len(y)) passage_length_ratio
  from g)"""

_SEMANTIC = """
ev as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
nearest as (
  select q.vec_id doc_id, arg_min(c.vec_id, (-round(list_cosine_similarity(q.e, c.e), 12), 'v' || c.vec_id)) source_id, max(list_cosine_similarity(q.e, c.e)) s
  from ev q, ev c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and q.vec_id not in (select doc_id from matches) group by 1),
semantic as (select doc_id, 'v' || source_id source_id, round_even(s, 4) similarity from nearest where s >= 0.4)"""
_ROUTED = """
routed as (
  select doc_id, 'lexical' "group", cast(source_id as varchar) source_id, round_even(ratio, 4) similarity from matches union all
  select doc_id, 'semantic', source_id, similarity from semantic union all
  select doc_id, 'external', 'x' || first_, 1.0::double from (select *, min(doc_id) over (partition by coalesce(text, '')) first_ from documents) where doc_id > first_)"""

SQL = {
    "sentence_split": f"""
with recursive {PASSAGES}
select doc_id, cast(row_number() over (partition by doc_id order by paragraph_index, sentence_index) - 1 as bigint) sentence_index, text as sentence from passages""",
    "token_stats": f"""
select doc_id, cast(len(w) as bigint) n_words, cast(len(list_distinct(w)) as bigint) n_distinct, cast(len(list_distinct({_ALNUM})) as bigint) n_alnum,
  cast(len(list_filter(w, lambda x: len(x) >= 2)) as bigint) n_long
from (select doc_id, text, {words("coalesce(text, '')")} w from documents)""",
    "word_ngram_topk": f"""
select gram, cast(count(*) as bigint) n from (select unnest({_GRAMS('w', 2)}) gram from (select {words('text')} w from documents where text is not null) where len(w) >= 2)
group by gram order by n desc, gram limit 50""",
    "passage_windows": r"""
with c as (
  select doc_id, unnest(list_transform(range(0, cast(case when len(text) <= 400 then 0 else ceil((len(text) - 400) / 320) end as bigint) + 1), lambda k: trim(substr(text, k * 320 + 1, 400), ' ' || chr(9) || chr(10) || chr(13)))) passage,
    generate_subscripts(range(0, cast(case when len(text) <= 400 then 0 else ceil((len(text) - 400) / 320) end as bigint) + 1), 1) i
  from documents where trim(coalesce(text, '')) <> '')
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as bigint) k, passage from c where passage <> ''""",
    "html_text_scan": rf"""
with t as (
  select page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '', '') x from pages),
e as (select page_id, replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') x from t),
s as (select page_id, trim(regexp_replace(x, '[\s\p{{Z}}]+', ' ', 'g')) x from e)
select page_id, cast(len(x) as bigint) n_chars, cast(len({words('x')}) as bigint) n_words, md5(x) text_md5 from s""",
    "boilerplate_and_exclusions": f"with recursive {PASSAGES}, {ALIGNED} select * from excluded",
    "candidate_pairs": f"""
with recursive {PASSAGES}, {ALIGNED}
select doc_id, cast(paragraph_index as bigint) paragraph_index, cast(sentence_index as bigint) sentence_index, source_id, cast(source_sentence as bigint) source_sentence, shared, candidate_rank from ranked where candidate_rank <= 200""",
    "alignment_scores": f"""
with recursive {PASSAGES}, {ALIGNED}
select doc_id, cast(paragraph_index as bigint) paragraph_index, cast(sentence_index as bigint) sentence_index, source_id, cast(source_sentence as bigint) source_sentence, matched, coverage, ratio from aligned""",
    "match_report": f"""
with recursive {PASSAGES}, {ALIGNED}
select doc_id, match_id, cast(paragraph_index as bigint) paragraph_index, cast(sentence_index as bigint) sentence_index, source_id, cast(source_sentence as bigint) source_sentence,
  "method", classification, matched matched_words, round_even(ratio, 4) similarity from matches""",
    "source_summary": f"""
with recursive {PASSAGES}, {ALIGNED},
p as (select doc_id, source_id, count(distinct (paragraph_index, sentence_index, token_index)) matched_words from positions group by 1, 2),
m as (select doc_id, source_id, count(*) passage_count, max(round_even(ratio, 4)) max_similarity from matches group by 1, 2)
select doc_id, source_id, matched_words, passage_count, max_similarity, round_even(matched_words / scored_words, 4) similarity from p join m using (doc_id, source_id) join excluded using (doc_id)""",
    "document_overlap": f"""
with recursive {PASSAGES}, {ALIGNED},
p as (select doc_id, count(distinct (paragraph_index, sentence_index, token_index)) w, count(distinct (paragraph_index, sentence_index, token_index)) filter (classification = 'suspected_unattributed') sw from positions group by 1),
m as (select doc_id, count(*) c, count(distinct source_id) sc, count(*) filter ("method" = 'exact') ec from matches group by 1)
select doc_id, scored_words, boilerplate_passages, coalesce(w, 0) matched_words, coalesce(sw, 0) suspected_words, coalesce(c, 0) match_count, coalesce(sc, 0) source_count, coalesce(ec, 0) exact_count,
  case when scored_words > 0 then round_even(coalesce(w, 0) / scored_words, 4) end overall_similarity, case when scored_words > 0 then 'available' else 'insufficient_content' end score_status
from excluded left join p using (doc_id) left join m using (doc_id)""",
    "match_warnings": f"""
with recursive {PASSAGES}, {ALIGNED}
select doc_id, match_id, case classification when 'suspected_unattributed' then 'match_without_citation' else 'quotation_without_citation' end "type",
  case classification when 'suspected_unattributed' then 'high' else 'medium' end severity
from matches where classification in ('suspected_unattributed', 'quotation', 'attributed_quotation')""",
    "exact_duplicates": """
select doc_id, sha256(coalesce(text, '')) sha256, first_ duplicate_of
from (select *, min(doc_id) over (partition by coalesce(text, '')) first_ from documents) where doc_id > first_""",
    "near_duplicates": f"with {_SHINGLED.replace('LEAST_WORDS', '1')} select a doc_id, min(b) near_duplicate_of from jac group by 1",
    "duplicate_groups": f"with recursive {GROUPS} select * from groups",
    "lexical_features": f"with recursive {PASSAGES}, {ALIGNED}, {_LEXICAL} select * from lexical",
    "exact_phrases": rf"""
with recursive {PASSAGES}, {ALIGNED},
uni as (
  select pid, a.doc_id, a.paragraph_index, a.sentence_index, a.source_id, a.source_sentence, regexp_extract_all(lower(c.text), '{UNICODE_WORD.replace("'", "''")}') x, regexp_extract_all(lower(p.text), '{UNICODE_WORD.replace("'", "''")}') y
  from aligned a join passages p using (doc_id, paragraph_index, sentence_index) join corpus c using (source_id, source_sentence)),
same as (select u.pid, u.i, v.j from (select pid, unnest(x) w, generate_subscripts(x, 1) i from uni) u join (select pid, unnest(y) w, generate_subscripts(y, 1) j from uni) v on u.pid = v.pid and u.w = v.w),
runs as (select pid, min(i) s, count(*) k from (select pid, i, j, i - row_number() over (partition by pid, i - j order by i) g from same) group by pid, i - j, g)
select distinct doc_id, cast(paragraph_index as bigint) paragraph_index, cast(sentence_index as bigint) sentence_index, source_id, cast(source_sentence as bigint) source_sentence,
  array_to_string(x[s : s + k - 1], ' ') phrase, cast(k as bigint) matched_tokens, round_even(k / least(len(x), len(y)), 4) score
from uni join runs using (pid) where k >= 3 and k >= 0.6 * least(len(x), len(y))""",
    "weighted_score": f"""
with recursive {PASSAGES}, {ALIGNED}, {_LEXICAL},
phrase as (
  select doc_id, paragraph_index, sentence_index, source_id, source_sentence, max(case when bk.k >= 4 and bk.k >= 0.75 * least(len(a), len(b)) then 1.0::double else 0.0::double end) exact_phrase_match
  from aligned left join blocks bk using (pid) group by all),
known as (select count(*) n from benchmark where trim(text) <> ''),
bw as (select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') w from benchmark),
bt as (select distinct item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) term from bw),
idf as (select term, ln((1 + any_value(n)) / (1 + count(*))) + 1 v from bt, known group by 1),
both_ as (
  select row_number() over () r, a.doc_id, a.paragraph_index, a.sentence_index, a.source_id, a.source_sentence, regexp_extract_all(lower(c.text), '[\\p{{L}}\\p{{N}}_]{{2,}}') x, regexp_extract_all(lower(p.text), '[\\p{{L}}\\p{{N}}_]{{2,}}') y, p.text ptext
  from aligned a join passages p using (doc_id, paragraph_index, sentence_index) join corpus c using (source_id, source_sentence)),
xt as (select r, term, count(*) * any_value(v) wt from (select r, unnest(list_concat(x, list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]))) term from both_) join idf using (term) group by 1, 2),
yt as (select r, term, count(*) * any_value(v) wt from (select r, unnest(list_concat(y, list_transform(range(1, len(y)), lambda i: y[i] || ' ' || y[i + 1]))) term from both_) join idf using (term) group by 1, 2),
norms as (select r, sqrt(sum(wt * wt)) nx from xt group by 1), normsy as (select r, sqrt(sum(wt * wt)) ny from yt group by 1),
dots as (select xt.r, sum(xt.wt * yt.wt) dot from xt join yt on xt.r = yt.r and xt.term = yt.term group by 1),
cosine as (select b.*, round_even(coalesce(dot / (nx * ny), 0.0), 4) tfidf_cosine from both_ b left join dots using (r) left join norms using (r) left join normsy using (r)),
scored_ as (
  select c.doc_id, cast(c.paragraph_index as bigint) paragraph_index, cast(c.sentence_index as bigint) sentence_index, c.source_id, cast(c.source_sentence as bigint) source_sentence, exact_phrase_match, tfidf_cosine,
    round_even(least(1.0, exact_phrase_match * 0.30::double + word_overlap * 0.20::double + char_overlap * 0.10::double + tfidf_cosine * 0.25::double + distinctive_phrase_ratio * 0.05::double), 4) score
  from cosine c join phrase p on p.doc_id = c.doc_id and p.paragraph_index = c.paragraph_index and p.sentence_index = c.sentence_index and p.source_id = c.source_id and p.source_sentence = c.source_sentence
  join lexical l on l.doc_id = c.doc_id and l.paragraph_index = c.paragraph_index and l.sentence_index = c.sentence_index and l.source_id = c.source_id and l.source_sentence = c.source_sentence)
select *, case when score >= 0.55 then 'suspicious' else 'clean' end "label" from scored_""",
    "semantic_matches": f"""
with recursive {PASSAGES}, {ALIGNED}, {_SEMANTIC} select doc_id, source_id, similarity, 'semantic' "method", 'semantic_related' classification from semantic""",
    "match_groups": f"""
with recursive {PASSAGES}, {ALIGNED}, {_SEMANTIC}, {_ROUTED} select doc_id, "group", source_id, count(*) passage_count, max(similarity) max_similarity from routed group by all""",
    "report_summary": f"""
with recursive {PASSAGES}, {ALIGNED}, {_SEMANTIC}, {_ROUTED},
p as (select doc_id, count(distinct (paragraph_index, sentence_index, token_index)) w, count(distinct (paragraph_index, sentence_index, token_index)) filter (classification = 'suspected_unattributed') sw from positions group by 1),
m as (select doc_id, count(*) filter (classification = 'cited_match') cited, count(*) filter (classification in ('quotation', 'attributed_quotation')) quoted from matches group by 1),
c as (
  select doc_id, count(*) match_count, count(distinct source_id) source_count, count(*) filter ("group" = 'lexical') lm, count(*) filter ("group" = 'semantic') sm, count(*) filter ("group" = 'external') em,
    count(distinct source_id) filter ("group" = 'lexical') ls, count(distinct source_id) filter ("group" = 'semantic') ss, count(distinct source_id) filter ("group" = 'external') es from routed group by 1)
select e.doc_id, scored_words total_words, coalesce(w, 0) matched_words, coalesce(sw, 0) suspected_unattributed_words, coalesce(cited, 0) attributed_match_count, coalesce(quoted, 0) quotation_match_count,
  case when scored_words > 0 then round_even(coalesce(w, 0) / scored_words, 4) end overall_similarity, case when scored_words > 0 then round_even(coalesce(sw, 0) / scored_words, 4) end suspected_unattributed_ratio,
  case when scored_words > 0 then 'available' else 'insufficient_content' end score_status, coalesce(match_count, 0) match_count, coalesce(source_count, 0) source_count,
  coalesce(lm, 0) lexical_match_count, coalesce(sm, 0) semantic_match_count, coalesce(em, 0) external_match_count, coalesce(ls, 0) lexical_source_count, coalesce(ss, 0) semantic_source_count, coalesce(es, 0) external_source_count
from excluded e left join p using (doc_id) left join m using (doc_id) left join c using (doc_id)""",
    "classifier_candidates": f"""
with recursive {PASSAGES}, {ALIGNED} select source_id, count(*) candidates, max(shared) most_shared from ranked where candidate_rank <= 10 group by 1""",
    "tfidf_terms": f"with {_TFIDF} select item_id, term, round(weight, 6) weight from vectors",
    "tfidf_cosine": f"""
with {_TFIDF}, d as (select p.item_id a, sum(p.weight * q.weight) dot from vectors p join vectors q on q.item_id = p.item_id + 1 and p.term = q.term group by 1)
select item_id a, item_id + 1 b, round_even(coalesce(dot, 0.0), 4) tfidf_cosine from benchmark left join d on a = item_id""",
    "offset_to_page": f"""
with recursive {PASSAGES}, starts as (select source_id, source_sentence, instr(b.text, c.text) - 1 st from corpus c join benchmark b on b.item_id = c.source_id)
select source_id, cast(source_sentence as bigint) source_sentence, cast(st // 100 + 1 as bigint) page from starts""",
    "semantic_best_match": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
s as (
  select q.vec_id query_id, c.vec_id corpus_id, list_cosine_similarity(q.e, c.e) s from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, arg_min(corpus_id, (-round(s, 9), corpus_id)) corpus_id, round(max(s), 6) similarity from s group by 1""",
}
