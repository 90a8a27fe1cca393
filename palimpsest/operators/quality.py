"""Rule-based assessment of manuscripts: evidence, completeness, writing, suggestions, readiness.

A manuscript is a row: doc_id, title, abstract, keywords (array), paragraphs (array),
sections (array of structs with heading, type, content), figures and tables (arrays of
structs with id and caption), equations (array of structs with id and number).  Missing
columns can be added with ``complete``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T

SECTIONS = "array<struct<section_id:string,heading:string,type:string,level:int,content:string,position:int>>"
COLUMNS = {
    "title": "string", "authors": "array<string>", "abstract": "string", "keywords": "array<string>", "paragraphs": "array<string>", "sections": SECTIONS,
    "figures": "array<struct<id:string,caption:string>>", "tables": "array<struct<id:string,caption:string>>", "equations": "array<struct<id:string,number:string>>",
    "subject_area": "string", "article_type": "string",
}

#: The words and patterns that count as evidence.
GAP = ("research gap", "little is known", "few studies", "limited work", "has not been", "remains unexplored")
CLAIM = ("we propose", "our contribution", "this study contributes", "we present", "we introduce")
COMPARISON = ("prior work", "existing work", "compared with", "baseline", "state-of-the-art")
NOVEL = ("research gap", "novel", "little is known", "limited work")
INFORMAL = ("obviously", "awesome", "huge", "a lot of", "kind of")
VAGUE = ("various", "several", "some studies", "many researchers", "significant")
COMPARATIVE = r"\b(outperforms|significantly better|clearly superior)\b"
PASSIVE = r"\b(?:is|are|was|were|be|been|being)\s+\w+ed\b"
METHOD_CHECKS = {
    "research methodology": r"\b(method|methodology|approach|protocol)\b",
    "dataset": r"\b(dataset|data set|corpus|cohort)\b",
    "dataset size": r"\b\d[\d,]*(?:\.\d+)?\s*(?:samples|records|participants|patients|images|documents|observations)\b",
    "data source": r"\b(data source|collected from|obtained from|public dataset|repository)\b",
    "preprocessing": r"\b(preprocess|normaliz|filter|cleaned|augmentation)\w*\b",
    "experimental setup": r"\b(experimental setup|experiment protocol|train.?test split|validation set|study design)\b",
    "algorithms or models": r"\b(model|algorithm|architecture|classifier|regression|network)\b",
    "parameters": r"\b(parameter|hyperparameter|learning rate|epochs|batch size|threshold)\b",
    "training procedure": r"\b(train|training|fine.?tun|optimizer)\w*\b",
    "evaluation metrics": r"\b(metric|accuracy|precision|recall|f1|auc|rmse|mae|bleu)\b",
    "baseline methods": r"\b(baseline|benchmark|compared with|comparison)\b",
    "statistical validation": r"\b(p.?value|confidence interval|statistical|significance test|standard deviation)\b",
    "reproducibility information": r"\b(reproducib|random seed|code available|data availability|software version)\w*\b",
    "limitations": r"\blimitations?\b",
}
TEXT_CONTRIBUTIONS = {
    "proposed method": r"\b(we propose|we present|we introduce|our method|our approach)\b",
    "algorithm or model contribution": r"\b(algorithm|model|architecture|framework|method)\b",
    "implementation contribution": r"\b(implementation|prototype|system|software|code)\b",
    "baseline comparison": r"\b(baseline|compared with|comparison|state-of-the-art)\b",
    "limitations": r"\blimitations?\b",
}
MEASURED = r"\b\d+(?:\.\d+)?\s*(?:%|ms|seconds?|accuracy|f1|auc|rmse)\b"
REPRODUCIBLE = r"\b(reproducib|random seed|code available|data availability)\w*\b"
ALIASES = {"methodology": ("methodology", "methods", "materials and methods"), "results": ("results", "findings")}
CORE = ("abstract", "introduction", "methodology", "results", "conclusion", "references")
PENALTY = {"high": 20, "medium": 8, "low": 3}


def complete(rows: DataFrame) -> DataFrame:
    """``rows`` with every manuscript column; nulls read as empty."""
    for name, kind in COLUMNS.items():
        value = F.col(name).cast(kind) if name in rows.columns and not kind.startswith("array<struct") else F.col(name) if name in rows.columns else F.lit(None).cast(kind)
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit("")
        rows = rows.withColumn(name, F.coalesce(value, empty))
    return rows


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def evidence(signals: list[Column]) -> Column:
    """The share of signals that hold, of 100, ties to the even number."""
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(False)).cast("int") for s in signals])
    return F.bround(total * 100.0 / len(signals), 0).cast("int")


def terms() -> Column:
    """All of a manuscript's text: title, abstract, section contents (or headings), keywords."""
    body = F.array_join(F.transform("sections", lambda s: F.coalesce(F.when(s["content"] != "", s["content"]), s["heading"], F.lit(""))), " ")
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), body, F.array_join("keywords", " "))


def section_text(name: str) -> Column:
    """The contents of sections of a type or heading, aliases included."""
    wanted = ALIASES.get(name, (name,))
    fits = F.filter("sections", lambda s: F.lower(F.coalesce(s["type"], F.lit(""))).isin(*wanted) | F.lower(F.coalesce(s["heading"], F.lit(""))).isin(*wanted))
    return F.array_join(F.transform(fits, lambda s: F.coalesce(s["content"], F.lit(""))), " ")


def detected() -> Column:
    """Section types and headings, lower-cased, with underscores."""
    plain = lambda c: F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("_"))
    return F.array_distinct(F.concat(F.transform("sections", lambda s: plain(s["type"])), F.transform("sections", lambda s: plain(s["heading"]))))


def with_evidence(rows: DataFrame) -> DataFrame:
    """``rows`` with novelty, methodology and contribution scores, the checks that failed, and word counts.

    Texts are put together in one step and looked at in the next, so each is built once.
    """
    paragraphs = F.array_join("paragraphs", "\n")
    rows = rows.withColumns({"__all": F.lower(terms()), "__intro": F.lower(section_text("introduction")), "__m": section_text("methodology"), "__results": F.lower(section_text("results"))})
    rows = rows.withColumn("__method", F.lower(F.when(F.col("__m") != "", F.col("__m")).otherwise(paragraphs)))
    all_, intro, method, results = (F.col(c) for c in ("__all", "__intro", "__method", "__results"))
    m = F.lower("__m")
    gap, claim, compare = any_of(all_, GAP), any_of(all_, CLAIM), any_of(all_, COMPARISON)
    has_method = (m != "") | all_.rlike(r"\b(method|model|algorithm|approach)\b")
    has_results = (results != "") | all_.rlike(r"\b(results?|accuracy|\d+(?:\.\d+)?%)(?!\w)")
    rows = rows.withColumn("__checks", F.array(*[F.coalesce(method.rlike(p), F.lit(False)) for p in METHOD_CHECKS.values()]))  # each pattern is matched once
    checks = {n: F.get("__checks", F.lit(k)) for k, n in enumerate(METHOD_CHECKS)}
    contributions = {
        "problem significance": (F.col("title") != "") & ((F.col("abstract") != "") | (intro != "")),
        "technical novelty framing": any_of(all_, NOVEL),
        **{n: all_.rlike(p) for n, p in TEXT_CONTRIBUTIONS.items()},
        "experimental contribution": results != "",
        "measurable results": results.rlike(MEASURED),
        "reproducibility": m.rlike(REPRODUCIBLE),
    }
    missing = lambda found: F.array_compact(F.array(*[F.when(~c, n) for n, c in found.items()]))
    return rows.withColumns(
        {
            "novelty_score": evidence([gap, claim, compare, has_method, has_results, F.size("keywords") >= 3]),
            "research_gap_clarity": evidence([gap, compare]),
            "contribution_strength": evidence([claim, has_method, has_results]),
            "gap_in_introduction": any_of(intro, GAP),
            "has_introduction": intro != "",
            "methodology_score": evidence(list(checks.values())),
            "methodology_missing": missing(checks),
            "contribution_score": evidence(list(contributions.values())),
            "contribution_missing": missing(contributions),
            "word_count": T.blank_words(all_),
            "abstract_words": T.blank_words(F.col("abstract")),
        }
    ).drop("__all", "__intro", "__m", "__method", "__results", "__checks")


def with_completeness(rows: DataFrame) -> DataFrame:
    """``rows`` (evidence and a venue's required_sections, optional_sections, word_limit, abstract_limit) with what is missing, and a score."""
    extra = F.array_compact(F.array(*[F.when(c, n) for n, c in (("title", F.col("title") != ""), ("abstract", F.col("abstract") != ""), ("keywords", F.size("keywords") > 0), ("research_gap", F.col("gap_in_introduction")))]))
    has_refs = F.array(F.lit("references")) if "references" in rows.columns else F.array().cast("array<string>")
    refs = F.when(F.size("references") > 0, has_refs).otherwise(F.array().cast("array<string>")) if "references" in rows.columns else has_refs
    rows = rows.withColumn("detected_sections", F.array_distinct(F.concat(detected(), extra, refs)))
    no_caption = lambda c: F.transform(F.filter(c, lambda x: F.coalesce(x["caption"], F.lit("")) == ""), lambda x: x["id"])
    required = F.coalesce("required_sections", F.array().cast("array<string>"))
    optional = F.coalesce("optional_sections", F.array().cast("array<string>"))
    missing = F.filter(required, lambda s: ~F.array_contains("detected_sections", s))
    over = lambda n, limit: F.coalesce((F.col(limit) > 0) & (F.col(n) > F.col(limit)), F.lit(False))
    return rows.withColumns(
        {
            "missing_required": missing,
            "missing_optional": F.filter(optional, lambda s: ~F.array_contains("detected_sections", s)),
            "completeness_score": F.when(F.size(required) == 0, 100).otherwise(F.bround(100.0 * (F.size(required) - F.size(missing)) / F.size(required), 0)).cast("int"),
            "uncaptioned_figures": no_caption("figures"),
            "uncaptioned_tables": no_caption("tables"),
            "unnumbered_equations": F.transform(F.filter("equations", lambda x: F.coalesce(x["number"], F.lit("")) == ""), lambda x: x["id"]),
            "word_limit_exceeded": over("word_count", "word_limit"),
            "abstract_limit_exceeded": over("abstract_words", "abstract_limit"),
        }
    )


def writing_sentences(rows: DataFrame) -> DataFrame:
    """(doc_id, unit, k, sentence): sentences of paragraphs, or of section contents where there are none."""
    units = F.when(F.size("paragraphs") > 0, F.col("paragraphs")).otherwise(F.transform("sections", lambda s: F.coalesce(s["content"], F.lit(""))))
    each = rows.select("doc_id", F.posexplode(units).alias("unit", "text"))
    return each.select("doc_id", "unit", F.posexplode(F.split(T.strip(F.col("text")), r"(?U)(?<=[.!?])\s+")).alias("k", "sentence")).where("sentence <> ''")


def writing_findings(rows: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, unit, k, sentence, finding, is_issue), up to the sentence with which a document has ``most`` findings.

    All findings of that sentence are listed.  A long passive is a finding but not an issue.
    """
    s = F.col("sentence")
    rows = writing_sentences(rows).withColumns({"lower": F.lower(s), "n": T.blank_words(s), "digit": s.rlike(r"\d")})
    rows = rows.withColumn("same", F.regexp_replace("lower", r"(?U)\s+", " "))
    again = F.row_number().over(Window.partitionBy("doc_id", "same").orderBy("unit", "k")) > 1
    low, many = F.col("lower"), F.col("n")
    flags = F.array_compact(
        F.array(
            F.when(many > 35, "long_sentence"),
            F.when(any_of(low, INFORMAL), "informal"),
            F.when(any_of(low, VAGUE) & ~F.col("digit"), "vague_quantity"),
            F.when(low.rlike(COMPARATIVE) & ~F.col("digit"), "unsupported_comparison"),
            F.when(low.rlike(PASSIVE) & (many > 18), "long_passive"),
            F.when(F.col("again"), "repeated"),
        )
    )
    flagged = rows.withColumn("again", again).withColumn("flags", flags).where("size(flags) > 0")
    before = F.sum(F.size("flags")).over(Window.partitionBy("doc_id").orderBy("unit", "k").rowsBetween(Window.unboundedPreceding, -1))
    kept = flagged.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most)
    return kept.select("doc_id", "unit", "k", "sentence", F.explode("flags").alias("finding")).withColumn("is_issue", F.col("finding") != "long_passive")


def with_writing(rows: DataFrame) -> DataFrame:
    """``rows`` with writing_issues (a number) and writing_score."""
    found = writing_findings(rows).groupBy("doc_id").agg(F.sum(F.col("is_issue").cast("int")).alias("__issues"))
    no_abstract = (F.col("abstract") == "") & ~F.array_contains(detected(), "abstract")
    issues = F.coalesce("__issues", F.lit(0)) + no_abstract.cast("int") + (F.size("keywords") < 3).cast("int")
    return rows.join(found, "doc_id", "left").withColumn("writing_issues", issues.cast("int")).drop("__issues").withColumn("writing_score", F.greatest(F.lit(0), 100 - 8 * F.col("writing_issues")))


def with_quality(rows: DataFrame) -> DataFrame:
    """``rows`` (evidence, completeness, writing) with quality_score; null under 40 words."""
    first = F.try_element_at("paragraphs", F.lit(1))
    body = T.squeeze(F.when(F.col("abstract") != "", F.col("abstract")).otherwise(first))
    clean = (F.col("writing_issues") == 0) & (F.size("keywords") > 0) & (F.length(body) >= 120)
    missing = F.filter(F.coalesce("required_sections", F.array(*map(F.lit, CORE))), lambda s: ~F.array_contains(detected(), s))
    score = evidence([F.size(missing) == 0, F.col("gap_in_introduction"), F.col("methodology_score") >= 60, F.col("contribution_score") >= 60, clean])
    return rows.withColumn("quality_score", F.when(F.col("word_count") >= 40, score))


def citation_scores(found: DataFrame) -> DataFrame:
    """(doc_id, issue_count, citation_score): 100 less a penalty for each issue, at least 0."""
    cost = reduce(lambda a, kv: a.when(F.col("severity") == kv[0], kv[1]), PENALTY.items(), F.when(F.lit(False), 0)).otherwise(0)
    return found.groupBy("doc_id").agg(F.count("*").alias("issue_count"), F.greatest(F.lit(0), 100 - F.sum(cost)).cast("int").alias("citation_score"))


DIMENSIONS = ("structure_score", "citation_score", "completeness_score", "methodology_score", "contribution_score", "novelty_score", "writing_score", "suitability_points", "formatting_score")


def readiness(rows: DataFrame) -> DataFrame:
    """``rows`` with overall_readiness: the mean of nine dimensions, ties to the even number, and a status for each."""
    mean = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in DIMENSIONS]) / len(DIMENSIONS)
    return rows.withColumn("overall_readiness", F.bround(mean.cast("double"), 0).cast("int")).withColumns({c.rsplit("_", 1)[0] + "_status": status(F.col(c)) for c in DIMENSIONS})


def status(score: Column) -> Column:
    return F.when(score >= 80, "Good").when(score >= 60, "Moderate").otherwise("Needs Review")


PRIORITY = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3, "LOW": 4}


def improvements(rows: DataFrame, issues: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, improvement_id, category, section, issue, original): all that is to be done about a manuscript, numbered.

    ``rows`` has evidence and completeness.  Missing references come first, then other
    citation issues, sections, captions, methods, framing, limits and writing.
    """
    none = F.lit(None).cast("string")

    def of(frame: DataFrame, rank: int, category: Column, section: Column, issue: Column, original: Column = none, at: Column | None = None) -> DataFrame:
        place = at if at is not None else F.lit(0)
        return frame.select("doc_id", F.lit(rank).alias("rank"), place.cast("int").alias("place"), category.alias("category"), section.alias("section"), issue.alias("issue"), original.cast("string").alias("original"))

    text = F.concat_ws(" ", F.col("type"), F.col("citation"), F.col("detail"))
    parts = [
        of(issues.where("category = 'missing_references'"), 1, F.lit("CRITICAL"), F.lit("References"), text, F.col("citation")),
        of(issues.where("category <> 'missing_references'"), 2, F.upper("severity"), F.lit("References"), text, F.col("citation")),
        of(rows.select("doc_id", F.posexplode("missing_required").alias("at", "x")), 3, F.lit("HIGH"), F.col("x"), F.concat(F.lit("Required section not detected: "), F.col("x")), at=F.col("at")),
        of(rows.where("size(uncaptioned_figures) > 0"), 4, F.lit("HIGH"), F.lit("Figures"), F.concat(F.lit("Missing figure captions: "), F.array_join("uncaptioned_figures", ", "))),
        of(rows.where("size(uncaptioned_tables) > 0"), 5, F.lit("HIGH"), F.lit("Tables"), F.concat(F.lit("Missing table captions: "), F.array_join("uncaptioned_tables", ", "))),
        of(rows.select("doc_id", F.posexplode(F.slice("methodology_missing", 1, 6)).alias("at", "x")), 6, F.lit("HIGH"), F.lit("methodology"), F.concat(F.lit("Methodology does not clearly identify "), F.col("x")), at=F.col("at")),
        of(rows.where("has_introduction and not gap_in_introduction"), 7, F.lit("MEDIUM"), F.lit("introduction"), F.lit("No explicit research gap in the introduction")),
        of(rows.where("size(unnumbered_equations) > 0"), 8, F.lit("MEDIUM"), F.lit("Equations"), F.concat(F.lit("Unnumbered equations: "), F.array_join("unnumbered_equations", ", "))),
        of(rows.where("word_limit_exceeded"), 9, F.lit("HIGH"), F.lit("Manuscript"), F.format_string("Word limit exceeded: %d of %d", "word_count", "word_limit")),
        of(rows.where("abstract_limit_exceeded"), 10, F.lit("MEDIUM"), F.lit("Abstract"), F.format_string("Abstract limit exceeded: %d of %d", "abstract_words", "abstract_limit")),
    ]
    few = findings.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("unit", "k", "finding"))).where("r <= 5")
    parts.append(of(few, 11, F.lit("LOW"), F.lit("writing"), F.col("finding"), F.col("sentence"), at=F.col("r")))
    union = reduce(lambda a, b: a.unionByName(b), parts)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "place", "issue", "original"))
    return union.withColumn("improvement_id", F.format_string("improvement-%d", number)).drop("rank", "place")


def locate(rows: DataFrame, needle: str) -> DataFrame:
    """(doc_id, kind, index): sections, paragraphs and abstracts that contain ``needle``, whatever its case and white space."""
    pattern = flexible(F.lit(needle))
    fits = lambda c: F.rlike(F.coalesce(c, F.lit("")), pattern)
    sections = rows.select("doc_id", F.lit("section").alias("kind"), F.posexplode("sections").alias("index", "s")).where(fits(F.col("s.content"))).drop("s")
    paras = rows.select("doc_id", F.lit("paragraph").alias("kind"), F.posexplode("paragraphs").alias("index", "s")).where(fits(F.col("s"))).drop("s")
    return sections.unionByName(paras).unionByName(rows.where(fits(F.col("abstract"))).select("doc_id", F.lit("abstract").alias("kind"), F.lit(None).cast("int").alias("index")))


def flexible(needle: Column) -> Column:
    """A pattern for a text with any white space between its words, whatever the case."""
    quoted = F.transform(F.filter(F.split(needle, r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit("(?iu)"), F.array_join(quoted, r"\s+"))


def replace_first(text: Column, original: Column, replacement: Column) -> Column:
    """``text`` with the first place of ``original`` (see ``flexible``) replaced; unchanged without one."""
    found = F.coalesce(F.regexp_substr(text, flexible(original)), F.lit(""))
    at = F.instr(text, found)
    return F.when((F.coalesce(original, F.lit("")) != "") & (found != ""), F.concat(F.substring(text, F.lit(1), at - 1), replacement, F.substring(text, at + F.length(found), F.length(text)))).otherwise(text)


def invented(original: Column, revised: Column) -> Column:
    """Numbers and citations in ``revised`` that ``original`` doesn't have: what a revision must not add."""
    pick = lambda c, p: F.array_distinct(F.regexp_extract_all(T.text_of(c), F.lit(p), F.lit(0)))
    numbers = r"\d+(?:[.,]\d+)*"
    cites = r"(?i)\[(?:\d+(?:\s*[-,]\s*\d+)*)\]|\b[A-Z][A-Za-z-]+(?:\s+et al\.)?\s*\(\s*\d{4}[a-z]?\s*\)|\bdoi:\s*10\.\d{4,9}/\S+|10\.\d{4,9}/\S+"
    return F.concat(F.array_except(pick(revised, numbers), pick(original, numbers)), F.array_except(pick(revised, cites), pick(original, cites)))
