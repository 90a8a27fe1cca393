"""Text functions as column expressions: tokens, sentences, n-grams, windows, normal forms.

Several definitions of "word" and "sentence" exist side by side because the operators
need them so; each has its own name.  All of them run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that results depend on.
WORD = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"
ALNUM = r"[a-z0-9]+"
SENTENCE_END = r"""(?<=[.!?])\s+(?=[A-Z0-9"“'])|(?<=\S)\n+"""
#: What ``(?U)\s`` matches, for a class of Python's expressions.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SENTENCE_END_PLAIN = r"""(?<=[.!?])\s+(?=[A-Z0-9"‘“])"""
QUOTED = r"""["“]([^"”]{2,}?)["”]"""
CITATION = r"\[(\d+(?:\s*[-,]\s*\d+)*)\]|\b[A-Z][A-Za-z-]+(?:\s+et al\.)?\s*\(\s*\d{4}[a-z]?\s*\)"
BOILERPLATE = (
    "all rights reserved",
    "this page intentionally left blank",
    "table of contents",
    "conflict of interest",
    "the authors declare no competing interests",
    "author contributions",
    "supplementary material",
    "corresponding author",
)
BOILERPLATE_STARTS = (
    "all rights reserved",
    "table of contents",
    "conflict of interest",
    "author contributions",
    "the authors declare no competing interests",
)

#: Separates segments inside expressions; a text's own is read as a space.
MARK = "\x01"


def text_of(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def words(value: Column) -> Column:
    """Lower-cased ASCII words, in order."""
    return F.transform(F.regexp_extract_all(text_of(value), F.lit(WORD), F.lit(0)), F.lower)


def word_count(value: Column) -> Column:
    return F.regexp_count(text_of(value), F.lit(WORD))


def alnum_words(value: Column) -> Column:
    """Runs of a-z and 0-9 in lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text_of(value)), F.lit(ALNUM), F.lit(0))


def blank_words(value: Column) -> Column:
    """How many runs of anything but white space."""
    return F.regexp_count(text_of(value), F.lit(r"(?U)\S+"))


def squeeze(value: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text_of(value), r"(?U)\s+", " "), "^ | $", "")


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def strip_chars(value: Column, chars: str) -> Column:
    return F.trim(value, F.lit(chars))


def segments(value: Column, boundary: str) -> Column:
    """array<struct<text, start, end>> between matches of ``boundary``; ends stripped, blank ones dropped, offsets in characters of ``value``."""
    plain = F.translate(text_of(value), MARK, " ")
    pieces = F.split(F.regexp_replace(plain, f"(?U)({boundary})", f"$1{MARK}"), MARK, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        body = strip(piece)
        start = state["at"] + F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)^\s+", ""))
        item = F.struct(body.alias("text"), start.alias("start"), (start + F.length(body)).alias("end"))
        return F.struct((state["at"] + F.length(piece)).alias("at"), F.when(body == "", state["out"]).otherwise(F.concat(state["out"], F.array(item))).alias("out"))

    return F.aggregate(pieces, empty, step, lambda s: s["out"])


def sentence_texts(value: Column, boundary: str = SENTENCE_END) -> Column:
    """Sentences in order, without offsets: linear in the text's length."""
    plain = F.translate(text_of(value), MARK, " ")
    return F.filter(F.transform(F.split(F.regexp_replace(plain, f"(?U)({boundary})", f"$1{MARK}"), MARK, -1), strip), lambda s: s != "")


def period_sentences(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(squeeze(value)), r"\."), strip), lambda s: s != "")


def writing_sentences(value: Column) -> Column:
    return F.filter(F.split(squeeze(value), r"(?<=[.!?])\s+"), lambda s: s != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined runs of ``n`` tokens; none if there are fewer or ``n`` is not positive.

    ``tokens`` must be a column, not an expression: it is read again for every run.
    """
    if n <= 0:
        return F.array().cast("array<string>")
    some = F.size(tokens) >= n
    return F.when(some, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - (n - 1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def shingles(tokens: Column, n: int = 5) -> Column:
    """The set of ``n``-grams; all tokens as one where there are fewer."""
    return F.array_distinct(F.when(F.size(tokens) >= n, ngrams(tokens, n)).otherwise(F.array(F.array_join(tokens, " "))))


def char_ngrams(text: Column, n: int) -> Column:
    """Runs of ``n`` characters of ``text``, a column of plain text (see ``squeeze``)."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def windows(value: Column, size: int = 400, overlap: int = 80) -> Column:
    """Stripped windows of ``size`` characters, each ``size - overlap`` after the one before; the last is the first that reaches the end."""
    text, step = text_of(value), max(1, size - overlap)
    last = F.when(F.length(text) <= size, 0).otherwise(F.ceil((F.length(text) - size) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: strip(F.substring(text, k * step + 1, F.lit(size))))
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(F.filter(cut, lambda s: s != ""))


def join_hyphens(value: Column) -> Column:
    """Words cut at line ends made whole, then white space squeezed."""
    return squeeze(F.regexp_replace(text_of(value), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", ""))


def is_boilerplate(value: Column) -> Column:
    return strip_chars(F.lower(squeeze(value)), " .:").isin(*BOILERPLATE)


def drop_boilerplate_start(value: Column) -> Column:
    """Squeezed text without a stock phrase that it begins with."""
    text = squeeze(value)
    return F.regexp_replace(text, rf"(?i)^(?:{'|'.join(BOILERPLATE_STARTS)})[ \-:;,.\n]*", "")


def has_citation(value: Column) -> Column:
    return text_of(value).rlike(f"(?U){CITATION}")


def quotes(value: Column) -> Column:
    """Texts inside double quotation marks, in order."""
    return F.regexp_extract_all(text_of(value), F.lit(QUOTED), F.lit(1))


def quote_spans(value: Column) -> Column:
    """array<struct<start, end>> of what double quotation marks enclose.

    Every match is wrapped in marks; then segments alternate between outside and inside.
    """
    text = F.translate(text_of(value), MARK, " ")
    pieces = F.split(F.regexp_replace(text, r"""(["“])([^"”]{2,}?)(["”])""", f"$1{MARK}$2{MARK}$3"), MARK, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), (i % 2 == 1).alias("inside")))
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x["p"])).alias("at"),
        F.when(x["inside"], F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(x["p"])).alias("end"))))).otherwise(s["out"]).alias("out"),
    )
    return F.aggregate(numbered, zero, step, lambda s: s["out"])


def fully_quoted(value: Column) -> Column:
    return strip(text_of(value)).rlike(r"""(?s)^["“].*["”]$""")


def without_controls(value: Column) -> Column:
    """Without characters that XML 1.0 does not allow."""
    return F.regexp_replace(text_of(value), r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def letters(value: Column) -> Column:
    """A name's ASCII letters, lower-cased."""
    return F.lower(F.regexp_replace(text_of(value), "[^A-Za-z]", ""))


def plain_doi(value: Column) -> Column:
    """A DOI without resolver, prefix and trailing marks, lower-cased; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(text_of(value)), r"[.,;)]+$", ""), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    bare = F.regexp_replace(bare, r"(?i)^doi:\s*", "")
    return F.when(bare.rlike(r"(?i)^10\.\d{4,9}/"), F.lower(bare))


def title_of_file(name: Column) -> Column:
    return F.initcap(F.translate(F.regexp_replace(name, r"\.[^.]*$", ""), "_-", "  "))


def without_tags(html: Column) -> Column:
    """The text of HTML: no scripts, styles, comments or tags; five entities resolved; squeezed."""
    text = F.regexp_replace(text_of(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squeeze(text)


def half_even(value: Column, digits: int = 4) -> Column:
    return F.bround(value, digits)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays without repeats; 0 for two empty ones."""
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / all_)
