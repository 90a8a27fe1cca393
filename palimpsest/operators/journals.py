"""Venue profiles and how well manuscripts fit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import quality as Q

#: Words that say nothing about scope, fields' weights, and what suitability is made of.
STOP_WORDS = (
    "a", "an", "and", "article", "applied", "empirical", "evaluation", "general", "computer", "interdisciplinary", "journal", "method", "methods", "of",
    "paper", "research", "science", "study", "studies", "system", "systems", "the", "with",
)
FIELDS = {"title": 1.5, "abstract": 1.2, "keywords": 1.5, "sections": 1.0, "subject_area": 1.5}
SCOPE, FORMAT, ARTICLE, SUITABLE = 0.65, 0.25, 0.10, 0.45
PROFILE = (
    "journal_id string, journal_name string, article_type string, citation_style string, word_limit int, page_limit int, required_sections array<string>, "
    "optional_sections array<string>, required_declarations array<string>, abstract_limit int, keywords_required boolean, scope_topics array<string>, "
    "scope_aliases map<string,array<string>>, allowed_formats array<string>, anonymity_required boolean, supplementary_allowed boolean"
)


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` laid on top, dictionaries within dictionaries too."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def resolve(config: dict) -> list[dict]:
    """Profiles of ``config`` (bases and profiles) with what they extend; a circle or an unknown base is an error."""
    bases = config.get("bases", {})

    def whole(item: dict, above: tuple[str, ...] = ()) -> dict:
        name = item.get("extends")
        if not name:
            return item
        if name in above:
            raise ValueError(f"profile bases extend each other: {' -> '.join((*above, name))}")
        if name not in bases:
            raise ValueError(f"unknown profile base: {name}")
        return merged(whole(bases[name], (*above, name)), {k: v for k, v in item.items() if k != "extends"})

    first: dict[str, dict] = {}
    for item in config.get("profiles", []):
        done = whole(item)
        first.setdefault(done["journal_id"], done)
    return list(first.values())


def profiles(spark: SparkSession, config: dict) -> DataFrame:
    """Resolved profiles as rows: a dimension of tens of rows, resolved in the driver."""
    rows = []
    for p in resolve(config):
        words = (p.get("keyword_formatting") or {}) | (p.get("keyword_rules") or {})
        rows.append((
            p["journal_id"], p.get("journal_name"), p.get("article_type"), p.get("citation_style"), p.get("word_limit"), p.get("page_limit"), p.get("required_sections") or [],
            p.get("optional_sections") or [], p.get("required_declarations") or [], (p.get("abstract_formatting") or {}).get("max_words"), bool(words.get("required")), p.get("scope_topics") or [],
            p.get("scope_aliases") or {}, p.get("allowed_formats") or ["docx"], bool(p.get("anonymity_required")), bool((p.get("supplementary_material_rules") or {}).get("allowed")),
        ))
    return spark.createDataFrame(rows, PROFILE)


def tokens(value: Column) -> Column:
    return F.array_except(F.array_distinct(T.alnum_words(value)), F.array(*map(F.lit, STOP_WORDS)))


def scope_scores(docs: DataFrame, journals: DataFrame) -> DataFrame:
    """(doc_id, journal_id, scope_score, topics, status) for every manuscript and venue.

    A topic counts in a field if the field has it as a phrase, or enough of its words; the
    best field counts, by its weight.  Either way the field has a word of the topic, so
    manuscripts and distinct topics are joined on words, however many venues share a topic.
    A row for each manuscript and venue is the result; which sides are broadcast is left to
    the optimiser, which knows their sizes.
    """
    body = F.array_join(F.transform("sections", lambda s: F.concat_ws(" ", F.coalesce(s["heading"], F.lit("")), F.coalesce(s["content"], F.lit("")))), " ")
    source = {"title": F.col("title"), "abstract": F.col("abstract"), "keywords": F.array_join("keywords", " "), "sections": body, "subject_area": F.col("subject_area")}
    fields = docs.select("doc_id", *[F.lower(T.squeeze(c)).alias(n) for n, c in source.items()])
    fields = fields.withColumns({f"{n}_words": F.array_distinct(T.alnum_words(F.col(n))) for n in FIELDS})
    enough = F.size(F.array_except(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}_words") for n in FIELDS]))), F.array(*map(F.lit, STOP_WORDS)))) >= 6
    aliases = F.flatten(F.transform(F.map_entries(F.coalesce("scope_aliases", F.create_map().cast("map<string,array<string>>"))), lambda e: F.concat(F.array(e["key"]), F.coalesce(e["value"], F.array().cast("array<string>")))))
    wanted = journals.select("journal_id", F.explode(F.array_distinct(F.transform(F.concat(F.coalesce("scope_topics", F.array().cast("array<string>")), aliases), lambda t: F.lower(T.squeeze(t))))).alias("topic")).where("topic <> ''")
    wanted = wanted.withColumn("topic_words", tokens(F.col("topic"))).where("size(topic_words) > 0")
    size = wanted.groupBy("journal_id").agg(F.count("*").alias("n_topics"))

    def strength(name: str, weight: float) -> Column:
        shared = F.size(F.array_intersect("topic_words", f"{name}_words"))
        phrase = F.rlike(F.col(name), F.concat(F.lit(r"\b\Q"), F.col("topic"), F.lit(r"\E\b")))
        return F.when(phrase, weight).when((F.size("topic_words") == 1) & (shared > 0), weight * 0.8).when((shared >= 2) & (shared / F.size("topic_words") >= 0.67), weight * 0.65).otherwise(0.0)

    topics = wanted.select("topic", "topic_words").distinct()
    words = fields.where(enough).select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}_words") for n in FIELDS])))).alias("word"))
    near = words.join(topics.select("topic", F.explode("topic_words").alias("word")), "word").select("doc_id", "topic").distinct()
    hits = near.join(topics, "topic").join(fields, "doc_id").withColumn("strength", F.greatest(*[strength(n, w) for n, w in FIELDS.items()])).where("strength > 0").select("doc_id", "topic", F.least(F.lit(1.0), F.col("strength") / 1.5).alias("strength"))
    by = hits.join(wanted.select("journal_id", "topic"), "topic").groupBy("doc_id", "journal_id").agg(F.sum("strength").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), "topic"))).alias("found"))
    every = fields.select("doc_id", enough.alias("enough")).crossJoin(journals.select("journal_id")).join(size, "journal_id", "left").join(by, ["doc_id", "journal_id"], "left")
    status = F.when(~F.col("enough"), "insufficient_content").when(F.col("n_topics").isNull(), "scope_unavailable").otherwise("evaluated")
    score = F.when(status == "evaluated", T.half_even(F.coalesce("total", F.lit(0.0)) / F.col("n_topics")))
    return every.select("doc_id", "journal_id", score.alias("scope_score"), F.coalesce(F.transform("found", lambda x: x["topic"]), F.array().cast("array<string>")).alias("topics"), status.alias("match_status"))


def suitability(docs: DataFrame, journals: DataFrame) -> DataFrame:
    """(doc_id, journal_id, scope_score, formatting_score, article_match, suitability, suitable, rank): venues ranked for each manuscript.

    ``docs`` has evidence (word counts).  What is not known is left out and the other weights
    share its place.
    """
    scope = scope_scores(docs, journals)
    slim = docs.select("doc_id", "word_count", "abstract_words", F.size("keywords").alias("n_keywords"), Q.detected().alias("found"), F.lower(F.trim("article_type")).alias("own_type"))
    rows = scope.join(slim, "doc_id").join(journals.drop("scope_topics", "scope_aliases"), "journal_id")
    required = F.coalesce("required_sections", F.array().cast("array<string>"))
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    checks = F.array_compact(F.array(
        F.when(F.size(required) > 0, F.size(F.array_except(required, "found")) == 0),
        F.when(on("word_limit"), (F.col("word_count") > 0) & (F.col("word_count") <= F.col("word_limit"))),
        F.when(on("abstract_limit"), (F.col("abstract_words") > 0) & (F.col("abstract_words") <= F.col("abstract_limit"))),
        F.when(F.coalesce("keywords_required", F.lit(False)), F.col("n_keywords") > 0),
    ))
    rows = rows.withColumn("checks", checks)
    passed = F.size(F.filter("checks", lambda c: c))
    rows = rows.withColumn("formatting_score", F.when(F.size("checks") > 0, F.bround(100.0 * passed / F.size("checks"), 0).cast("int")))
    expected = F.lower(F.trim(F.coalesce("article_type", F.lit(""))))
    rows = rows.withColumn("article_match", F.when((F.col("own_type") != "") & (expected != ""), F.col("own_type").contains(expected) | expected.contains(F.col("own_type"))))
    parts = [(F.col("scope_score"), SCOPE), (F.col("formatting_score") / 100.0, FORMAT), (F.col("article_match").cast("int"), ARTICLE)]
    top = sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    bottom = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    rows = rows.withColumn("suitability", F.when((F.col("match_status") == "evaluated") & (bottom > 0), T.half_even(top / bottom)))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("suitability", F.lit(-1.0)).desc(), F.coalesce("scope_score", F.lit(-1.0)).desc(), "journal_id"))
    return rows.select("doc_id", "journal_id", "scope_score", "topics", "match_status", "formatting_score", "article_match", "suitability", (F.coalesce("suitability", F.lit(0.0)) >= SUITABLE).alias("suitable"), rank.alias("rank"))


def best(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1")
