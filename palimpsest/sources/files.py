"""Readers: corpora, labelled pairs, reference documents, manuscripts, uploads.  All paths are Spark's."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.arrow import fingerprint

SPAN = "array<struct<page:int,start:int,end:int>>"
SOURCE = f"id string, title string, authors array<string>, year string, url string, source_type string, text string, filename string, page_spans {SPAN}"
PAIR = (
    "source_document_id string, suspicious_document_id string, source_text string, suspicious_text string, label string, source_start int, source_end int, suspicious_start int, "
    "suspicious_end int, citation_context string, document_group_id string, source_group_id string, derivative_group_id string, group_id string"
)
REQUIRED = ("source_document_id", "suspicious_document_id", "source_text", "suspicious_text", "label")
UPLOAD_BYTES = 15 * 1024 * 1024


def failing(rows: DataFrame, bad: F.Column, message: F.Column) -> DataFrame:
    """``rows``, or an error when one for which ``bad`` holds is read."""
    return rows.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def normal_sources(rows: DataFrame) -> DataFrame:
    """Sources with defaults for what they lack; one without id or text is an error."""
    for name, kind in (("title", "string"), ("authors", "array<string>"), ("year", "string"), ("url", "string"), ("source_type", "string"), ("filename", "string"), ("page_spans", SPAN)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    blank = (T.strip(T.text_of(F.col("id"))) == "") | (T.strip(T.text_of(F.col("text"))) == "")
    rows = failing(rows, blank, F.lit("a corpus source must have an id and a text"))
    full = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select("id", F.coalesce(full("title"), F.col("id")).alias("title"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.col("year").cast("string").alias("year"), "url", F.coalesce(full("source_type"), F.lit("corpus")).alias("source_type"), "text", "filename", F.coalesce("page_spans", F.array().cast(SPAN)).alias("page_spans"))


def json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Sources of JSON files: each a list, or an object with a list named sources."""
    raw = spark.read.text(path, wholetext=True)
    listed = f"array<struct<{', '.join(re.sub(r'^(\\w+) ', r'\\1:', c) for c in SOURCE.split(', '))}>>"
    items = F.when(F.ltrim("value").startswith("["), F.from_json("value", listed)).otherwise(F.from_json("value", f"struct<sources:{listed}>")["sources"])
    rows = failing(raw.select(items.alias("items")), F.col("items").isNull(), F.lit("a corpus file is a list of sources or has one"))
    return normal_sources(rows.select(F.explode("items").alias("s")).select("s.*"))


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A source for each text file: its id and title come from its name.  An empty file is an error."""
    name = F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")
    rows = spark.read.text(path, wholetext=True).select(F.concat(F.lit("file-"), name).alias("id"), T.title_of_file(F.col("_metadata.file_name")).alias("title"), F.lit("custom_corpus_file").alias("source_type"), F.col("value").alias("text"), F.col("_metadata.file_name").alias("filename"))
    return normal_sources(rows)


def account_corpus(references: DataFrame, user_id: str) -> DataFrame:
    """An account's indexed reference documents as sources."""
    rows = references.where((F.col("user_id") == user_id) & (F.col("status") == "indexed"))
    return normal_sources(rows.select("id", "title", F.from_json("authors_json", "array<string>").alias("authors"), F.col("year").cast("string").alias("year"), F.lit("account_reference").alias("source_type"), F.col("text_content").alias("text"), F.col("original_filename").alias("filename"), F.from_json("page_spans_json", SPAN).alias("page_spans")))


def combined(*corpora: DataFrame) -> DataFrame:
    """All sources together; an id that comes twice is an error."""
    rows = corpora[0]
    for more in corpora[1:]:
        rows = rows.unionByName(more)
    counts = rows.groupBy("id").agg(F.count("*").alias("n"))
    sound = failing(counts, F.col("n") > 1, F.concat(F.lit("two sources have the id "), F.col("id")))
    return rows.join(sound.select("id"), "id")


def corpus_info(sources: DataFrame) -> DataFrame:
    """One row: number of sources, by type, and a version that changes with any id or text."""
    each = F.sha2(F.concat_ws("\x1f", "id", "text"), 256)
    by = sources.groupBy("source_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", each.alias("h")))).alias("ids"))
    return by.agg(F.sum("n").alias("sources"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("by_type"), F.sha2(F.to_json(F.array_sort(F.flatten(F.collect_list("ids")))), 256).alias("version"))


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled passage pairs of a CSV, JSON Lines or JSON file (a list, or an object with a list named data)."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST")
        rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    elif suffix in ("jsonl", "ndjson"):
        rows = spark.read.schema(PAIR + ", metadata map<string,string>").json(path, mode="FAILFAST")
    elif suffix == "json":
        item = "struct<" + ", ".join(re.sub(r"^(\w+) ", r"\1:", c) for c in PAIR.split(", ")) + ", metadata:map<string,string>>"
        raw = spark.read.text(path, wholetext=True)
        items = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>")).otherwise(F.from_json("value", f"struct<data:array<{item}>>")["data"])
        rows = failing(raw.select(items.alias("items")), F.col("items").isNull(), F.lit("a dataset is a list of pairs or has one named data")).select(F.explode("items").alias("s")).select("s.*")
    else:
        raise ValueError(f"datasets are csv, json, jsonl or ndjson, not {suffix}")
    if lacking := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"the dataset lacks {', '.join(lacking)}")
    return rows


def valid_pairs(rows: DataFrame) -> DataFrame:
    """Pairs with labels 0 or 1 and all required fields, each once whichever side is which.

    A bad label, a blank field or a pair with two labels is an error.
    """
    label = F.lower(F.trim(F.col("label").cast("string"))).try_cast("double")
    rows = rows.withColumns({c: T.strip(T.text_of(F.col(c))) for c in REQUIRED[:4]} | {"label": label.cast("int"), "__raw": label})
    bad = F.coalesce(~F.col("__raw").isin(0.0, 1.0), F.lit(True))
    rows = failing(rows, bad, F.lit("labels are 0 or 1")).drop("__raw")
    blank = F.array_contains(F.array(*[F.col(c) for c in REQUIRED[:4]]), "")
    rows = failing(rows, blank, F.lit("a pair must have two ids and two texts"))
    a, b = fingerprint("source_text"), fingerprint("suspicious_text")
    rows = rows.withColumns({"__x": a, "__y": b}).withColumn("__key", F.concat_ws("\x1f", F.least("source_document_id", "suspicious_document_id"), F.greatest("source_document_id", "suspicious_document_id"), F.least("__x", "__y"), F.greatest("__x", "__y")))
    labels = rows.groupBy("__key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    sound = failing(labels, F.col("lo") != F.col("hi"), F.lit("a pair has two labels")).select("__key")
    return rows.join(sound, "__key").dropDuplicates(["__key"]).drop("__key", "__x", "__y")


def admitted(uploads: DataFrame) -> DataFrame:
    """``uploads`` (binaryFile) with problem: null for a DOCX or PDF that may be taken in."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    magic = F.hex(F.substring("content", 1, 5))
    problem = F.when(~suffix.isin("docx", "pdf"), "unsupported file type").when(F.col("length") == 0, "empty file").when(F.col("length") > UPLOAD_BYTES, "file too large")
    problem = problem.when((suffix == "pdf") & (magic != "255044462D"), "not a PDF").when((suffix == "docx") & ~magic.startswith("504B0304"), "not a DOCX")
    return uploads.withColumn("problem", problem)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(path, pos, style, text, equations): non-blank paragraphs of DOCX files (binaryFile), with the number of equations in each.  A file that can't be read gives a null text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    out.append((path, 0, None, None, 0))
                    continue
                pos = 0
                for p in root.iter(f"{_W}p"):
                    text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
                    style = p.find(f"{_W}pPr/{_W}pStyle")
                    maths = sum(1 for _ in p.iter(f"{_MATH}oMath"))
                    if text or maths:
                        out.append((path, pos, style.get(f"{_W}val") if style is not None else None, text, maths))
                        pos += 1
            yield pd.DataFrame(out, columns=["path", "pos", "style", "text", "equations"])

    return files.select("path", "content").mapInPandas(read, "path string, pos int, style string, text string, equations int")


def external_results(payloads: DataFrame) -> DataFrame:
    """(doc_id, source_id, title, url, similarity, matched_words, method): rows that a comparison service reported, from JSON (results or items)."""
    item = "array<struct<id:string,title:string,url:string,similarity:double,score:double,matched_words:int,matchedWords:int>>"
    items = F.coalesce(F.from_json("payload", f"struct<results:{item}>")["results"], F.from_json("payload", f"struct<items:{item}>")["items"])
    rows = payloads.select("doc_id", F.posexplode(items).alias("k", "r"))
    return rows.select("doc_id", F.coalesce("r.id", F.format_string("external-%d", F.col("k") + 1)).alias("source_id"), F.coalesce("r.title", F.lit("External source")).alias("title"), "r.url", F.coalesce("r.similarity", "r.score", F.lit(0.0)).alias("similarity"), F.coalesce("r.matched_words", "r.matchedWords", F.lit(0)).alias("matched_words"), F.lit("external").alias("method"))


def enriched(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """``rows`` with values of ``extra`` laid over theirs: only columns that they have, only values that are not null."""
    names = [c for c in rows.columns if c != key and c in extra.columns]
    over = extra.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in names])
    joined = rows.join(over, key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in names}).select(*rows.columns)


def ingest_status(files: DataFrame, known: DataFrame, near: DataFrame, least_words: int = 20) -> DataFrame:
    """``files`` (id, user_id, sha256, text, problem) with status and duplicate_of.

    failed: it could not be read.  duplicate: the account has the same bytes (``known``:
    user_id, sha256, id) or a near duplicate (``near``: id, near_duplicate_of).  needs_ocr:
    too few words.  Else indexed.
    """
    same = known.groupBy("user_id", "sha256").agg(F.min("id").alias("same"))
    rows = files.join(same, ["user_id", "sha256"], "left").join(near, "id", "left")
    other = F.coalesce("same", "near_duplicate_of")
    few = F.regexp_count(T.text_of(F.col("text")), F.lit(r"\b[\w'-]+\b")) < least_words
    status = F.when(F.col("problem").isNotNull(), "failed").when(other.isNotNull(), "duplicate").when(few, "needs_ocr").otherwise("indexed")
    return rows.withColumn("status", status).withColumn("duplicate_of", F.when(F.col("status") == "duplicate", other)).drop("same", "near_duplicate_of")
