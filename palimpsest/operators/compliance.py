"""Compliance of manuscripts with venue profiles: a row for each rule, and what they add up to.

``rows`` are manuscripts (see ``quality``) with evidence, joined with a profile's columns:
journal_id, required_sections, optional_sections, required_declarations, word_limit,
abstract_limit, keywords_required, page_limit, allowed_formats, anonymity_required,
supplementary_allowed; and article_type, source_format, page_count where known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import quality as Q

#: What each article type needs, other names of types, and how declarations read.
ARTICLE_TYPES = {
    "original_research": (
        ("title", "abstract", "keywords", "introduction", "methodology", "results", "discussion", "conclusion", "references"),
        ("related_work", "research_gap", "limitations", "future_work", "acknowledgments", "funding", "author_contributions", "conflict_of_interest", "data_availability", "ethics", "supplementary_material"),
    ),
    "review": (
        ("title", "abstract", "keywords", "introduction", "related_work", "discussion", "conclusion", "references"),
        ("methodology", "results", "research_gap", "limitations", "future_work", "acknowledgments", "funding", "conflict_of_interest", "data_availability"),
    ),
    "conference_paper": (
        ("title", "abstract", "keywords", "introduction", "methodology", "results", "conclusion", "references"),
        ("related_work", "discussion", "limitations", "acknowledgments", "funding"),
    ),
    "short_communication": (
        ("title", "abstract", "introduction", "methodology", "results", "references"),
        ("keywords", "discussion", "conclusion", "limitations"),
    ),
}
OTHER_NAMES = {
    "research_article": "original_research", "research_paper": "original_research", "journal_article": "original_research", "transactions_journal_article": "original_research", "article": "original_research",
    "conference": "conference_paper", "proceedings": "conference_paper", "survey": "review", "systematic_review": "review", "literature_review": "review",
    "short_paper": "short_communication", "communication": "short_communication",
}
DECLARATIONS = {
    "funding": r"\b(funding|funded by|financial support|grant (?:number|no\.?)|this work was supported)\b",
    "author_contributions": r"\b(author contributions?|authors? contribut|cr edit|credit authorship)\b",
    "conflict_of_interest": r"\b(conflict of interest|conflicts of interest|competing interests?|no conflict)\b",
    "data_availability": r"\b(data availability|data are available|data is available|available (?:upon|on) request|data can be found)\b",
    "ethics": r"\b(ethics? (?:statement|approval)|ethical approval|institutional review board|\birb\b|informed consent)\b",
    "acknowledgments": r"\backnowledge?ments?\b|\bwe thank\b",
    "supplementary_material": r"\b(supplementary|supporting information|supporting material|appendix)\b",
}
FAILING_CITATIONS = ("missing_references",)
CITATION_RULES = (
    "missing_references", "uncited_references", "duplicate_references", "duplicate_reference_numbers", "numbering_issues", "duplicate_citation_numbers",
    "malformed_references", "invalid_dois", "author_year_mismatches", "style_mismatches", "references_wrong_order", "invalid_structure",
)


def article_type(value: Column) -> Column:
    """A type's usual name; original research for what is unknown."""
    plain = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")
    named = F.when(plain.isin(*ARTICLE_TYPES), plain)
    for other, name in OTHER_NAMES.items():
        named = named.when(plain == other, name)
    return named.otherwise("original_research")


def article_types(spark) -> DataFrame:
    """(article_type, required, optional) of all types."""
    return spark.createDataFrame([(k, list(a), list(b)) for k, (a, b) in ARTICLE_TYPES.items()], "article_type string, required array<string>, optional array<string>")


def _strings(names) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def declared() -> Column:
    """Declarations that the text or a heading makes."""
    text, heads = F.lower(Q.terms()), Q.detected()
    return F.array_compact(F.array(*[F.when(text.rlike(p) | F.array_contains(heads, n), n) for n, p in DECLARATIONS.items()]))


def with_components(rows: DataFrame) -> DataFrame:
    """``rows`` with kind, required, optional and detected components."""
    kind = article_type(F.col("article_type"))
    preset = lambda k: reduce(lambda a, x: a.when(kind == x[0], _strings(x[1][k])), ARTICLE_TYPES.items(), F.when(F.lit(False), _strings(()))).otherwise(_strings(()))
    empty = lambda c: F.coalesce(c, _strings(()))
    rows = rows.withColumns({"kind": kind, "declared": declared()})
    rows = rows.withColumn("required", F.array_distinct(F.concat(preset(0), empty(F.col("required_sections")), empty(F.col("required_declarations")))))
    rows = rows.withColumn("optional", F.array_except(F.array_distinct(F.concat(preset(1), empty(F.col("optional_sections")))), F.col("required")))
    plain = {"title": F.col("title") != "", "abstract": F.trim("abstract") != "", "keywords": F.size("keywords") > 0, "references": F.size("references") > 0 if "references" in rows.columns else F.lit(False), "research_gap": F.col("gap_in_introduction")}
    return rows.withColumn("components", F.array_distinct(F.concat(Q.detected(), F.array_compact(F.array(*[F.when(c, n) for n, c in plain.items()])), F.col("declared"))))


def rules(rows: DataFrame, citation_issues: DataFrame | None = None) -> DataFrame:
    """(doc_id, journal_id, rule_id, category, status, expected, actual): a row for each rule of each manuscript and profile."""
    rows = with_components(rows)
    if citation_issues is not None:
        counts = citation_issues.groupBy("doc_id").pivot("category", list(CITATION_RULES)).count()
        rows = rows.join(counts.select("doc_id", *[F.col(c).alias(f"n_{c}") for c in CITATION_RULES]), "doc_id", "left")

    def rule(name: Column | str, category: str, status: Column | str, expected: Column | str | None, actual: Column | str | None) -> Column:
        as_text = lambda c: (F.lit(c) if c is None or isinstance(c, str) else c).cast("string")
        return F.struct(as_text(name).alias("rule_id"), F.lit(category).alias("category"), as_text(status).alias("status"), as_text(expected).alias("expected"), as_text(actual).alias("actual"))

    has = lambda c: F.array_contains("components", c)
    limit = lambda col: F.coalesce(F.col(col), F.lit(0)) > 0
    within = lambda n, col: F.when(~limit(col), "not_applicable").when(F.col(n) <= F.col(col), "passed").otherwise("failed")

    def captions(col: str) -> Column:
        bare = F.size(F.filter(col, lambda f: F.coalesce(f["caption"], F.lit("")) == ""))
        return rule(f"{col}.captions", "figures_tables", F.when(F.size(col) == 0, "not_applicable").when(bare > 0, "failed").otherwise("passed"), "a caption each", bare)

    form = F.lower(F.coalesce(F.col("source_format"), F.lit("docx"))) if "source_format" in rows.columns else F.lit("docx")
    allowed = F.transform(F.coalesce("allowed_formats", F.array(F.lit("docx"))), lambda f: F.ltrim(F.lower(f), F.lit(".")))
    pages = F.col("page_count") if "page_count" in rows.columns else F.lit(None).cast("int")
    fixed = [
        rule("length.word_limit", "formatting", within("word_count", "word_limit"), F.col("word_limit"), F.col("word_count")),
        rule("length.abstract_limit", "formatting", within("abstract_words", "abstract_limit"), F.col("abstract_limit"), F.col("abstract_words")),
        F.when(F.coalesce("keywords_required", F.lit(False)), rule("formatting.keywords", "formatting", F.when(F.size("keywords") > 0, "passed").otherwise("failed"), "keywords", F.size("keywords"))),
        captions("figures"),
        captions("tables"),
        rule("figures.table.numbering", "figures_tables", "manual_review", "sequential", None),
        rule("citations.style", "citations", "manual_review", None, None),
        rule("submission.file_format", "submission", F.when(F.array_contains(allowed, form), "passed").otherwise("warning"), F.array_join(allowed, ", "), form),
        rule("length.page_limit", "formatting", F.when(~limit("page_limit"), "not_applicable").when(pages.isNull() | (pages == 0), "manual_review").when(pages <= F.col("page_limit"), "passed").otherwise("failed"), F.col("page_limit"), pages),
        F.when(F.coalesce("anonymity_required", F.lit(False)), rule("submission.anonymity", "submission", "manual_review", "anonymous", None)),
        F.when(F.coalesce("supplementary_allowed", F.lit(False)), rule("submission.supplementary", "submission", "manual_review", None, None)),
    ]
    if citation_issues is not None:
        for c in CITATION_RULES:
            n = F.coalesce(f"n_{c}", F.lit(0))
            fixed.append(rule(f"citations.{c}", "citations", F.when(n == 0, "passed").otherwise("failed" if c in FAILING_CITATIONS else "warning"), "none", n))
    each = F.concat(
        F.transform("required", lambda c: rule(F.concat(F.lit("structure."), c), "structural_completeness", F.when(has(c), "passed").otherwise("failed"), "present", F.when(has(c), "present").otherwise("missing"))),
        F.transform("optional", lambda c: rule(F.concat(F.lit("structure.optional."), c), "structural_completeness", F.when(has(c), "passed").otherwise("not_applicable"), "optional", F.when(has(c), "present").otherwise("not present"))),
        F.transform(F.coalesce("required_declarations", _strings(())), lambda c: rule(F.concat(F.lit("declaration."), c), "declarations", F.when(F.array_contains("declared", c), "passed").otherwise("failed"), "present", F.when(F.array_contains("declared", c), "present").otherwise("missing"))),
        F.array_compact(F.array(*fixed)),
    )
    return rows.select("doc_id", "journal_id", F.explode(each).alias("r")).select("doc_id", "journal_id", "r.*")


STATUSES = ("passed", "failed", "warning", "manual_review", "not_applicable")


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, journal_id, a count for each status, compliance_score, overall_status): the score is the share passed of rules decided automatically."""
    counts = found.groupBy("doc_id", "journal_id").agg(*[F.sum((F.col("status") == s).cast("long")).alias(s) for s in STATUSES])
    decided = F.col("passed") + F.col("failed") + F.col("warning")
    overall = F.when(F.col("failed") > 0, "failed").when(F.col("warning") + F.col("manual_review") > 0, "warning").otherwise("passed")
    return counts.withColumn("compliance_score", F.when(decided > 0, F.bround(100.0 * F.col("passed") / decided, 0).cast("int"))).withColumn("overall_status", overall)


def word_budget(rows: DataFrame) -> DataFrame:
    """(doc_id, section, words, share, suggested_cut): sections by length, and how many words to take from each if the limit is exceeded."""
    from pyspark.sql import Window

    from palimpsest.functions import text as T

    each = rows.select("doc_id", F.col("word_limit").alias("word_limit"), "word_count", F.posexplode("sections").alias("k", "s")).select("doc_id", "word_limit", "word_count", "k", F.col("s.heading").alias("section"), T.blank_words(F.col("s.content")).alias("words"))
    total = F.sum("words").over(Window.partitionBy("doc_id"))
    excess = F.when(F.coalesce(F.col("word_limit"), F.lit(0)) > 0, F.greatest(F.lit(0), F.col("word_count") - F.col("word_limit"))).otherwise(0)
    share = F.when(total > 0, F.col("words") / total).otherwise(0.0)
    return each.select("doc_id", "k", "section", "words", share.alias("share"), excess.alias("excess"), F.ceil(excess * share).cast("long").alias("suggested_cut"))
