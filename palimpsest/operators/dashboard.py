"""What an account or a manuscript's page shows: indicators, prioritised actions, averages, statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import quality as Q

#: The order of priorities.
PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def priority_counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, a count for each priority, zeros included)."""
    return found.groupBy(key).agg(*[F.sum((F.col("category") == p).cast("long")).alias(p.lower()) for p in PRIORITIES])


def actions(improvements: DataFrame, rules: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, rank, source, priority, title, section): urgent improvements and failed rules, the first ``most`` of each manuscript."""
    urgent = improvements.where(F.col("category").isin("CRITICAL", "HIGH")).select("doc_id", F.lit("improvement").alias("source"), F.col("category").alias("priority"), F.col("issue").alias("title"), "section", F.regexp_extract("improvement_id", r"(\d+)$", 1).cast("int").alias("at"))
    failed = rules.where("status = 'failed'").select("doc_id", F.lit("compliance").alias("source"), F.lit("HIGH").alias("priority"), F.col("rule_id").alias("title"), F.col("category").alias("section"), F.lit(0).alias("at"))
    order = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(order, F.col("source").desc(), "at", "title"))
    return urgent.unionByName(failed).withColumn("rank", rank).where(F.col("rank") <= most).drop("at")


def indicators(readiness: DataFrame, compliance: DataFrame, completeness: DataFrame, overlap: DataFrame, improvements: DataFrame) -> DataFrame:
    """(doc_id, key, available, value): five figures of each manuscript in ``readiness``; those without evidence are not available."""
    found = improvements.groupBy("doc_id").agg(F.count("*").alias("improvement"))
    rows = readiness.select("doc_id", F.col("overall_readiness").alias("readiness"))
    for frame, column, name in ((compliance, "compliance_score", "compliance"), (completeness, "completeness_score", "completeness"), (overlap, "overall_similarity", "similarity"), (found, "improvement", "improvement")):
        rows = rows.join(frame.select("doc_id", F.col(column).alias(name)), "doc_id", "left")
    keys = ("readiness", "compliance", "completeness", "similarity", "improvement")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).isNotNull().alias("available"), F.col(k).cast("double").alias("value")) for k in keys]))
    return rows.select("doc_id", each.alias("i")).select("doc_id", "i.*")


def account_summary(documents: DataFrame, readiness: DataFrame, improvements: DataFrame) -> DataFrame:
    """One row for each user of ``documents`` (doc_id, user_id, updated_at): manuscripts, how many are analysed, averages, open and urgent suggestions, the most recent one."""
    counts = improvements.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("category").isin("CRITICAL", "HIGH").cast("long")).alias("urgent"))
    rows = documents.join(readiness, "doc_id", "left").join(counts, "doc_id", "left")
    mean = lambda c: F.bround(F.avg(c), 0).cast("int")
    newest = F.max(F.struct("updated_at", "doc_id"))["doc_id"]
    return rows.groupBy("user_id").agg(
        F.count("*").alias("manuscripts"), F.count("overall_readiness").alias("analysed"), mean("overall_readiness").alias("readiness_average"), F.coalesce(F.sum("n"), F.lit(0)).alias("open_suggestions"),
        F.coalesce(F.sum("urgent"), F.lit(0)).alias("urgent_suggestions"), newest.alias("recent"), *[mean(c).alias(f"{c}_average") for c in Q.DIMENSIONS if c in readiness.columns],
    )


def confidence(evidence_type: Column, priority: Column) -> Column:
    return F.when(evidence_type == "factual", "high").when(priority.isin("CRITICAL", "HIGH"), "medium").otherwise("low")


def dimension_summary(rows: DataFrame, improvements: DataFrame) -> DataFrame:
    """(doc_id, key, available, count): thirteen dimensions of each manuscript with evidence, completeness and writing."""
    per = improvements.groupBy("doc_id").agg(F.sum((F.lower("section") == "methodology").cast("long")).alias("__m"), F.sum((F.lower("section") == "references").cast("long")).alias("__r"))
    rows = rows.join(per, "doc_id", "left").withColumn("__s", F.transform("detected_sections", lambda s: F.replace(s, F.lit("_"), F.lit(" "))))
    has = lambda *names: reduce(lambda a, b: a | b, [F.array_contains("__s", n) for n in names])
    yes, none = F.lit(True), F.lit(None).cast("long")
    keys = {
        "problem_clarity": ((F.col("abstract") != "") | (F.size("sections") > 0), none), "objectives_motivation": (F.col("abstract") != "", none), "literature_review": (has("related work", "literature review"), none),
        "research_gap_novelty": (yes, F.col("novelty_score")), "technical_contribution": (yes, F.col("contribution_score")), "methodology_reproducibility": (yes, F.col("methodology_score")),
        "experimental_design": (has("results"), none), "results_discussion": (has("results", "discussion"), none), "statistical_evidence": (yes, F.coalesce("__m", F.lit(0))),
        "limitations_future_work": (has("limitations", "future work"), none), "language_clarity": (yes, F.col("writing_issues")), "citation_completeness": (yes, F.coalesce("__r", F.lit(0))), "submission_readiness": (yes, none),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), a.alias("available"), n.cast("long").alias("count")) for k, (a, n) in keys.items()]))
    return rows.select("doc_id", each.alias("d")).select("doc_id", "d.*")


def searched(rows: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows that have ``term`` in any of ``columns``, whatever its case."""
    low = term.strip().lower()
    return rows if not low else rows.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(low) for c in columns]))


def engine_status(spark, model: bool, embeddings: bool, external: bool) -> DataFrame:
    """(engine, status): what can be used, as a table."""
    rows = [("lexical", True), ("classifier", model), ("semantic", embeddings), ("external", external)]
    return spark.createDataFrame([(n, "available" if on else "unavailable") for n, on in rows], "engine string, status string")


def scan_progress(scans: DataFrame) -> DataFrame:
    """(status, n, last_update): jobs by state."""
    return scans.groupBy("status").agg(F.count("*").alias("n"), F.max("updated_at").alias("last_update"))
