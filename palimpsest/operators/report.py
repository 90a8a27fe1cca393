"""The whole overlap report: semantic and external matches beside the lexical ones, classifier scores, and the summary."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import evaluation, features, overlap

#: From where on vectors are related, words that a passage needs, pairs of a passage that are scored.
RELATED, LEAST_WORDS, SCORED = 0.82, 6, 10


def unmatched(found: DataFrame, matches: DataFrame) -> DataFrame:
    """The passages of ``found`` of ``LEAST_WORDS`` words or more that no match has: what the semantic pass looks at."""
    return found.where(F.size("tokens") >= LEAST_WORDS).join(matches.select(*overlap.PASSAGE).distinct(), overlap.PASSAGE, "left_anti")


def semantic_matches(passages: DataFrame, corpus: DataFrame, threshold: float = RELATED) -> DataFrame:
    """(doc_id, paragraph_index, sentence_index, source_id, similarity, method, classification) of passages whose nearest vector reaches ``threshold``.

    ``passages`` have the columns of ``overlap.PASSAGE`` and vector, ``corpus`` has source_id
    and vector, all of length one.  Of equals the smallest source is taken; a passage with a
    column ``own`` is not compared with the source of that id.  They are topical signals: they
    add no matched words.
    """
    keyed = passages.withColumn("id", F.col("own") if "own" in passages.columns else F.concat_ws(":", *overlap.PASSAGE))
    near = features.best_match(keyed, corpus.select(F.col("source_id").alias("id"), "vector"), threshold)
    rows = keyed.select("id", *overlap.PASSAGE).join(near, F.col("id") == F.col("query_id"))
    return rows.select(*overlap.PASSAGE, F.col("corpus_id").alias("source_id"), T.half_even(F.col("similarity")).alias("similarity"), F.lit("semantic").alias("method"), F.lit("semantic_related").alias("classification"))


def groups(lexical: DataFrame, semantic: DataFrame, external: DataFrame) -> DataFrame:
    """(doc_id, group, source_id, similarity): all matches, routed by method into lexical, semantic and external."""
    of = lambda rows, name: rows.select("doc_id", F.lit(name).alias("group"), F.col("source_id").cast("string").alias("source_id"), F.col("similarity").cast("double").alias("similarity"))
    return of(lexical, "lexical").unionAll(of(semantic, "semantic")).unionAll(of(external, "external"))


def group_sources(routed: DataFrame) -> DataFrame:
    """For each document, group and source: matches and the best similarity."""
    return routed.groupBy("doc_id", "group", "source_id").agg(F.count("*").alias("passage_count"), F.max("similarity").alias("max_similarity"))


def summary(lexical: DataFrame, semantic: DataFrame, external: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row for each document of ``excluded``: overlap of lexical matches, and counts of matches and sources by group.

    Similarities are null, and the status ``insufficient_content``, where no word is scored.
    """
    routed = groups(lexical, semantic, external)
    of = lambda name: F.col("group") == name
    names = ("lexical", "semantic", "external")
    counted = routed.groupBy("doc_id").agg(
        F.count("*").alias("match_count"), F.countDistinct("source_id").alias("source_count"),
        *[F.sum(of(n).cast("long")).alias(f"{n}_match_count") for n in names], *[F.countDistinct(F.when(of(n), F.col("source_id"))).alias(f"{n}_source_count") for n in names],
    )
    lexical_ = overlap.document_report(lexical, excluded).drop("match_count", "source_count", "exact_count")
    rows = lexical_.join(counted, "doc_id", "left").na.fill(0, counted.columns[1:])
    return rows.withColumnsRenamed({"scored_words": "total_words", "suspected_words": "suspected_unattributed_words", "suspected_ratio": "suspected_unattributed_ratio"})


def classifier_scores(found: DataFrame, corpus: DataFrame, model: PipelineModel | None, names: tuple[str, ...], threshold: float = 0.5, limit: int = SCORED) -> tuple[DataFrame | None, dict]:
    """(scores, status): the model's opinion on the first ``limit`` candidates of each passage.

    Scores are (passage, source, positive_score, predicted_label), sorted: the highest score
    first, then by source and passage.  Without a model there are none and the
    status is ``unavailable``; if features or the model fail on the rows, it is ``failed``.
    """
    pairs = overlap.candidates(found, corpus, most=limit)
    status = {"engine": "classifier", "candidate_pair_count": pairs.count()}
    if model is None:
        return None, status | {"status": "unavailable", "detail": "no model is given"}
    texts = pairs.join(found.select(*overlap.PASSAGE, F.col("text").alias("suspicious_text"), "attributed"), overlap.PASSAGE).join(corpus.select(*overlap.SOURCE, "source_text"), overlap.SOURCE)
    rows = features.extracted(texts).withColumn("citation_context_indicator", F.col("attributed").cast("int"))
    missing = [n for n in names if n not in rows.columns]
    if missing:
        return None, status | {"status": "failed", "detail": f"the model needs {', '.join(missing)}"}
    scored = evaluation.predict(model, rows, threshold).withColumn("positive_score", T.half_even(F.col("score")))
    by = [F.col("positive_score").desc(), "source_id", *overlap.PASSAGE, "source_sentence"]
    ordered = scored.select(*overlap.PASSAGE, *overlap.SOURCE, "positive_score", F.col("predicted").alias("predicted_label")).orderBy(*by)
    return ordered, status | {"status": "completed", "threshold": threshold}
