"""Structure of parsed documents: sections, captions, equations, front matter, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T

#: Headings that name a kind of section, and words of affiliations.
HEADINGS = {
    "introduction": "introduction", "background": "background", "related work": "related_work", "literature review": "related_work", "methodology": "methodology",
    "materials and methods": "methodology", "materials & methods": "methodology", "proposed method": "methodology", "proposed methods": "methodology", "methods": "methodology",
    "results": "results", "discussion": "discussion", "conclusion": "conclusion", "future work": "future_work", "limitations": "limitations", "research gap": "research_gap",
    "references": "references", "bibliography": "references", "abstract": "abstract", "keywords": "keywords",
}
INSTITUTIONS = ("university", "department", "institute", "laboratory")
NUMBERED = r"^\d+(?:\.\d+)*[.)]?\s+"


def bare(heading: Column) -> Column:
    """A heading without its number and colons at its ends, lower-cased."""
    return F.trim(T.strip_chars(F.regexp_replace(F.lower(heading), NUMBERED, ""), " :"))


def section_type(heading: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, bare(heading)), F.lit("other"))


def is_heading(line: Column, style: Column | None = None) -> Column:
    """A line in a heading style, or one of 12 words or less that is numbered or a capitalised phrase without a sentence's end."""
    numbered = line.rlike(r"^(?:\d+|[IVXLC]+)(?:[.)]|\s+)")
    phrase = line.rlike(r"(?s)^(?:\d+(?:\.\d+)*[.)]?\s+)?[A-Z][^.!?]{2,80}$")
    short = (numbered | phrase) & (T.blank_words(line) <= 12)
    return short if style is None else F.lower(F.coalesce(style, F.lit(""))).startswith("heading") | short


def heading_level(heading: Column) -> Column:
    """The depth of a heading's number; 1 without."""
    number = F.regexp_extract(heading, r"^(\d+(?:\.\d+)*)[.)]?\s+", 1)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section_id, position, heading, type, level, content) of ``lines`` (doc_id, pos, text).

    A heading opens a section that runs to the next one.  Lines before the first heading are
    in none, unless a document has no heading: then all are one section, Body.
    """
    rows = lines.withColumn("text", T.strip(T.text_of(F.col("text")))).where("text <> ''").withColumn("head", is_heading(F.col("text")))
    number = F.sum(F.col("head").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos"))
    any_ = F.max("head").over(Window.partitionBy("doc_id"))
    rows = rows.withColumns({"section_no": number, "any_head": any_}).where("section_no > 0 or not any_head")
    each = rows.groupBy("doc_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "head"))).alias("all"))
    heading = F.when(F.col("all")[0]["head"], F.col("all")[0]["text"]).otherwise("Body")
    content = F.array_join(F.transform(F.filter("all", lambda x: ~x["head"]), lambda x: x["text"]), "\n")
    each = each.withColumns({"heading": heading, "content": content, "position": F.greatest(F.col("section_no"), F.lit(1))})
    kind = section_type(F.col("heading"))
    return each.select("doc_id", F.format_string("SEC-%02d", "position").alias("section_id"), F.col("position").cast("long").alias("position"), "heading", kind.alias("type"), heading_level(F.col("heading")).alias("level"), "content")


def captions(lines: DataFrame, kind: str) -> DataFrame:
    """(doc_id, number, caption): ``Figure 1. ...`` and ``Table 1: ...`` lines; the last of a number counts."""
    label = {"figure": r"(?:Figure|Fig\.)", "table": "Table"}[kind]
    pattern = rf"(?i)^{label}\s*(\d+)[.:]\s*(.+)$"
    text = T.strip(T.text_of(F.col("text")))
    rows = lines.where(text.rlike(pattern)).select("doc_id", "pos", F.regexp_extract(text, pattern, 1).cast("int").alias("number"), F.regexp_extract(text, pattern, 2).alias("caption"))
    return rows.groupBy("doc_id", "number").agg(F.max_by("caption", "pos").alias("caption"))


def objects_with_captions(objects: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, number, caption, has_object): parsed objects (doc_id, number) and captions, either of which may be alone."""
    rows = objects.withColumn("has_object", F.lit(True)).join(found, ["doc_id", "number"], "full_outer")
    return rows.select("doc_id", "number", F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("has_object", F.lit(False)).alias("has_object"))


def equation_numbers(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, number): numbers in brackets at the end of lines."""
    number = F.regexp_extract(T.strip(T.text_of(F.col("text"))), r"\((\d+)\)$", 1)
    return lines.withColumn("number", number).where("number <> ''").select("doc_id", "pos", "number")


def front_matter(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, title, authors, affiliations, abstract, keywords) by the usual places of these.

    The title is the first heading of 20 words or less that is not of the abstract,
    keywords or references, else an early line that names no institution.  Authors are the
    first of lines 2 to 5 with a comma and no institution; keywords follow their label.
    """
    text = T.strip(T.text_of(F.col("text")))
    rows = lines.withColumn("text", text).where("text <> ''").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).withColumns({"low": F.lower("text"), "words": T.blank_words(F.col("text"))})
    named = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.col("low").contains(w))
    first = lambda where: F.min(F.when(where, F.struct("n", "text")))["text"]
    keys = r"(?s)^key ?words:"
    by = rows.where("n <= 10 or low rlike '^key ?words:'").groupBy("doc_id").agg(
        first((F.col("n") <= 10) & (F.col("words") <= 30) & ~named("abstract", "keywords", "university", "department")).alias("early"),
        first(F.col("n").between(2, 5) & F.col("text").contains(",") & (F.col("words") < 30) & ~named(*INSTITUTIONS[:3])).alias("people"),
        F.array_sort(F.collect_list(F.when((F.col("n") <= 8) & named(*INSTITUTIONS), F.struct("n", "text")))).alias("places"),
        first(F.col("low").rlike(keys)).alias("keys"),
    )
    heads = parts.groupBy("doc_id").agg(
        F.min_by(F.col("heading"), F.when(~F.col("type").isin("abstract", "references", "keywords") & (T.blank_words(F.col("heading")) <= 20), F.col("position"))).alias("head"),
        F.min_by("content", F.when(F.col("type") == "abstract", F.col("position"))).alias("abstract"),
    )
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.filter(F.transform(F.split(c, ","), T.strip), lambda x: x != ""), none)
    title = F.coalesce("head", "early", F.lit("Untitled manuscript"))
    return by.join(heads, "doc_id", "left").select("doc_id", title.alias("title"), listed(F.col("people")).alias("authors"), F.transform("places", lambda x: x["text"]).alias("affiliations"), F.coalesce("abstract", F.lit("")).alias("abstract"), listed(F.substring_index("keys", ":", -1)).alias("keywords"))


def reference_lines(parts: DataFrame) -> DataFrame:
    """(doc_id, position, raw_text): lines of a document's first section of references."""
    first = parts.where("type = 'references'").groupBy("doc_id").agg(F.min_by("content", "position").alias("content"))
    rows = first.select("doc_id", F.posexplode(F.filter(F.transform(F.split("content", "\n"), T.strip), lambda x: x != "")).alias("k", "raw_text"))
    return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("position"), "raw_text")


def page_furniture(lines: DataFrame) -> DataFrame:
    """(doc_id, line): lines of four characters or more among the first or last two of at least two and 60 % of a document's pages.

    ``lines``: doc_id, page, k (order in the page), line.  A line that is both among the
    first and the last two of a page counts twice.
    """
    page = Window.partitionBy("doc_id", "page")
    rows = lines.withColumns({"up": F.row_number().over(page.orderBy("k")), "down": F.row_number().over(page.orderBy(F.col("k").desc()))})
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    weight = (F.col("up") <= 2).cast("int") + (F.col("down") <= 2).cast("int")
    count = rows.where(F.length("line") >= 4).groupBy("doc_id", "line").agg(F.sum(weight).alias("n")).join(pages, "doc_id")
    return count.where((F.col("pages") >= 2) & (F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.6)))).select("doc_id", "line")


def page_spans(pages: DataFrame, gap: int = 2) -> DataFrame:
    """(doc_id, page, start, end): where pages (doc_id, page, text) are in a document's text, ``gap`` characters apart.

    No gap comes before the first page with text.
    """
    order = Window.partitionBy("doc_id").orderBy("page")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = F.max((F.length("text") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = F.sum(F.when(F.coalesce("opened", F.lit(0)) > 0, gap).otherwise(0)).over(order)
    rows = pages.withColumns({"before": before, "opened": opened}).withColumn("start", (F.col("before") + gaps).cast("long"))
    return rows.select("doc_id", "page", "start", (F.col("start") + F.length("text")).alias("end"))


def format_warnings(rows: DataFrame) -> DataFrame:
    """(doc_id, warning, object_id): captions and equation numbers that are missing, each object once."""
    bare_ = lambda c, what: F.transform(F.filter(c, lambda x: F.coalesce(x[what], F.lit("")) == ""), lambda x: F.struct(F.lit(f"{c}_without_{what}").alias("warning"), x["id"].alias("object_id")))
    each = F.concat(bare_("figures", "caption"), bare_("tables", "caption"), bare_("equations", "number"))
    return rows.select("doc_id", F.explode(each).alias("w")).select("doc_id", "w.warning", "w.object_id").dropDuplicates()
