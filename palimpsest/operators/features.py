"""Similarity features of passage pairs, TF-IDF, embeddings, and the weighted score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.arrow import aligned_blocks, nfkc, offset_tokens
from palimpsest.operators.blocks import against
from palimpsest.operators.graph import reliable

NAMES = ("exact_phrase_match", "word_overlap", "char_overlap", "tfidf_cosine", "semantic_cosine", "distinctive_phrase_ratio", "passage_length_ratio", "citation_context_indicator")
#: How the features add up, and from where on a pair is suspicious.
WEIGHTS = {"exact_phrase_match": 0.30, "word_overlap": 0.20, "char_overlap": 0.10, "tfidf_cosine": 0.25, "semantic_cosine": 0.10, "distinctive_phrase_ratio": 0.05}
SUSPICIOUS = 0.55


def grams(items: Column, low: int, high: int, chars: bool = False) -> Column:
    """The set of n-grams, ``low`` to ``high``, of a column of words, or of characters of a column of plain text."""
    return F.array_distinct(F.flatten(F.array(*[T.char_ngrams(items, n) if chars else T.ngrams(items, n) for n in range(low, high + 1)])))


def lexical(pairs: DataFrame, a: str = "source_text", b: str = "suspicious_text", normalise: bool = True) -> DataFrame:
    """``pairs`` with word_overlap (1-2-grams), char_overlap (3-5-grams), distinctive_phrase_ratio and passage_length_ratio.

    ``normalise``: compatibility forms are resolved first, in Arrow batches.  Each step is a
    projection of its own, so that nothing is computed anew for every n-gram.
    """
    rows = pairs.withColumns({"__a": nfkc(a) if normalise else T.text_of(F.col(a)), "__b": nfkc(b) if normalise else T.text_of(F.col(b))})
    rows = rows.withColumns({f"__w{c}": T.words(F.col(f"__{c}")) for c in "ab"} | {f"__c{c}": F.lower(T.squeeze(F.col(f"__{c}"))) for c in "ab"})
    rows = rows.withColumns({f"__gw{c}": grams(F.col(f"__w{c}"), 1, 2) for c in "ab"} | {f"__gc{c}": grams(F.col(f"__c{c}"), 3, 5, True) for c in "ab"})
    p, q, n, m = F.array_distinct("__wa"), F.array_distinct("__wb"), F.size("__wa"), F.size("__wb")
    both, all_ = F.size(F.array_intersect(p, q)), F.size(F.array_union(p, q))
    added = {
        "word_overlap": T.half_even(T.jaccard(F.col("__gwa"), F.col("__gwb"))),
        "char_overlap": T.half_even(T.jaccard(F.col("__gca"), F.col("__gcb"))),
        "distinctive_phrase_ratio": T.half_even((all_ - both) / F.greatest(all_, F.lit(1))),
        "passage_length_ratio": F.when((n > 0) & (m > 0), F.least(n, m) / F.greatest(n, m)).otherwise(0.0),
    }
    return rows.withColumns(added).drop(*[f"__{k}{c}" for k in ("", "w", "c", "gw", "gc") for c in "ab"])


def exact_phrases(pairs: DataFrame, a: str = "source_text", b: str = "suspicious_text", least: int = 4, threshold: float = 0.75) -> DataFrame:
    """``pairs`` with ``phrases``: aligned runs of ``least`` Unicode words that make up ``threshold`` of the shorter text.

    A phrase has both texts' character offsets, its text, score and number of words.  Equal
    stock phrases have none.
    """
    rows = pairs.withColumns({"__p": offset_tokens(a), "__q": offset_tokens(b)})
    rows = rows.withColumn("__m", aligned_blocks(F.transform("__p", lambda t: t["token"]), F.transform("__q", lambda t: t["token"])))
    short = F.least(F.size("__p"), F.size("__q"))
    plain = lambda c: T.strip_chars(F.lower(T.squeeze(nfkc(c))), " .:;")
    stock = (plain(a) == plain(b)) & plain(a).isin(*T.BOILERPLATE_STARTS)
    first, last = lambda c, i: F.element_at(F.col(c), i + 1)["start"], lambda c, i, n: F.element_at(F.col(c), i + n)["end"]

    def phrase(m: Column) -> Column:
        start, end = first("__p", m["a"]), last("__p", m["a"], m["size"])
        return F.struct(
            start.alias("source_start"), end.alias("source_end"), first("__q", m["b"]).alias("suspicious_start"), last("__q", m["b"], m["size"]).alias("suspicious_end"),
            F.substring(F.col(a), start + 1, end - start).alias("matched_text"), T.half_even(m["size"] / short).alias("score"), m["size"].alias("matched_tokens"),
        )

    long_enough = F.filter("__m", lambda m: (m["size"] >= least) & (m["size"] >= threshold * short))
    return rows.withColumn("phrases", F.when(stock, F.slice(F.transform(long_enough, phrase), 1, 0)).otherwise(F.transform(long_enough, phrase))).drop("__p", "__q", "__m")


def tfidf(docs: DataFrame, id_col: str, text_col: str, fitted_on: DataFrame | None = None, most: int | None = 100_000) -> DataFrame:
    """(id, term, weight): unit-length TF-IDF vectors of words and word pairs of two letters or more.

    Weights are tf * (ln((1 + N) / (1 + df)) + 1).  Documents' terms and frequencies come from
    ``fitted_on`` (default: ``docs``); of these the ``most`` frequent count (ties by term).
    """
    word = r"[\p{L}\p{N}_]{2,}"

    def terms(rows: DataFrame) -> DataFrame:
        tokens = F.regexp_extract_all(F.lower(T.squeeze(F.col(text_col))), F.lit(word), F.lit(0))
        both = rows.select(F.col(id_col).alias("id"), tokens.alias("w")).select("id", F.explode(F.concat("w", T.ngrams(F.col("w"), 2))).alias("term"))
        return both.groupBy("id", "term").agg(F.count("*").alias("tf"))

    base = fitted_on if fitted_on is not None else docs
    n = base.where(T.squeeze(F.col(text_col)) != "").agg(F.count("*").alias("n"))
    known = terms(base).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if most is not None:
        known = known.orderBy(F.col("total").desc(), "term").limit(most)
    idf = known.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = terms(docs).join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return weighed.select("id", "term", (F.col("weight") / norm).alias("weight"))


def tfidf_cosine(pairs: DataFrame, a_vectors: DataFrame, b_vectors: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with tfidf_cosine: 0 where they share no term."""
    left = pairs.select("a", "b").join(a_vectors.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa")), "a")
    both = left.join(b_vectors.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb")), ["b", "term"])
    dots = both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.join(dots, ["a", "b"], "left").withColumn("tfidf_cosine", T.half_even(F.coalesce("dot", F.lit(0.0)))).drop("dot")


def extracted(pairs: DataFrame, a: str = "source_text", b: str = "suspicious_text", fitted_on: DataFrame | None = None, least: int = 4, threshold: float = 0.75) -> DataFrame:
    """``pairs`` with all features that need no embedding model.

    The lexical block, exact_phrase_match (1 where a phrase of ``exact_phrases`` is found),
    tfidf_cosine (fitted on the distinct texts of the pairs, or on column ``text`` of
    ``fitted_on``) and citation_context_indicator (whether the suspicious text has a citation).
    ``pairs`` are computed once and kept, since every feature reads them; pairs of equal texts
    get theirs together.
    """
    keyed = reliable(pairs.withColumns({"__x": F.xxhash64(a, F.lit(0)), "__y": F.xxhash64(b, F.lit(0))}))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes take long here, so partitions must not be joined by their size
    alike = reliable(keyed.select("__x", "__y", a, b).dropDuplicates(["__x", "__y"]).repartition(tasks, "__x", "__y"))
    texts = alike.select(F.col("__x").alias("id"), F.col(a).alias("text")).unionAll(alike.select(F.col("__y").alias("id"), F.col(b).alias("text"))).dropDuplicates(["id"])
    vectors = tfidf(texts, "id", "text", fitted_on, most=None)
    cosine = tfidf_cosine(alike.select(F.col("__x").alias("a"), F.col("__y").alias("b")), vectors, vectors).withColumnsRenamed({"a": "__x", "b": "__y"})
    rows = exact_phrases(lexical(alike, a, b), a, b, least, threshold)
    rows = rows.withColumns({"exact_phrase_match": (F.size("phrases") > 0).cast("double"), "citation_context_indicator": T.has_citation(F.col(b)).cast("int")}).drop("phrases", a, b)
    return keyed.join(rows.join(cosine, ["__x", "__y"]), ["__x", "__y"]).drop("__x", "__y")


def chunks(value: Column, size: int = 1500, shared: int = 150) -> Column:
    """A text cut into pieces of ``size`` characters, each starting with the last ``shared`` ones of the piece before."""
    step = size - shared
    last = F.greatest(F.lit(0), F.ceil((F.length(value) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(value, k * step + 1, F.lit(size)))


def embedded(docs: DataFrame, id_col: str, text_col: str, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(id, vector): texts encoded piece by piece and pooled (see ``chunks`` and ``pooled``); ``encode`` gives a row for each text of a list.

    Null and blank texts have no vector.  ``encode`` runs in Arrow batches and is sent to the workers.
    """
    pieces = docs.where(T.squeeze(F.col(text_col)) != "").select(F.col(id_col).alias("id"), F.explode(chunks(F.col(text_col))).alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(encode(batch.column(1).to_pylist()), float) if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["id", "vector"])

    kind = pieces.schema["id"].dataType.simpleString()
    return pooled(pieces.mapInArrow(run, f"id {kind}, vector array<double>"), "id", "vector")


def counter_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token arrays' counts; 0 if either is empty."""
    count = lambda t, x: F.size(F.filter(x, lambda y: y == t)).cast("double")
    square = lambda x: F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, t: s + count(t, x) * count(t, x))
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, t: s + count(t, a) * count(t, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dot / (F.sqrt(square(a)) * F.sqrt(square(b))))


def weighted_score_of(names: tuple[str, ...]) -> Column:
    """The weighted sum of those features that a table has, between 0 and 1, to four digits."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in WEIGHTS.items() if c in names), F.lit(0.0))
    return T.half_even(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def weighted_score() -> Column:
    return weighted_score_of(NAMES)


def label(threshold: float = SUSPICIOUS) -> Column:
    return F.when(weighted_score() >= threshold, "suspicious").otherwise("clean")


def citation_bonus(text: Column, base: Column) -> Column:
    return F.when(T.has_citation(text), base + 0.1).otherwise(base)


def citation_contexts(value: Column, around: int = 80) -> Column:
    """Stripped text around each citation, bracketed ones first."""
    text = F.translate(T.text_of(value), T.MARK, " ")

    def of(pattern: str) -> Column:
        pieces = F.split(F.regexp_replace(text, f"(?U)({pattern})", f"{T.MARK}$1{T.MARK}"), T.MARK, -1)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), (i % 2 == 1).alias("inside")))
        around_ = lambda s, p: T.strip(F.substring(text, F.greatest(F.lit(0), s["at"] - around) + 1, s["at"] + F.length(p) + around - F.greatest(F.lit(0), s["at"] - around)))
        step = lambda s, x: F.struct((s["at"] + F.length(x["p"])).alias("at"), F.when(x["inside"], F.concat(s["out"], F.array(around_(s, x["p"])))).otherwise(s["out"]).alias("out"))
        return F.aggregate(numbered, zero, step, lambda s: s["out"])

    numeric, author = T.CITATION.split("|", 1)
    return F.concat(of(numeric.replace("(\\d", "(?:\\d")), of(author))


def unit(vector: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pooled(chunks: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): the mean of each id's chunk vectors, of length one."""
    each = chunks.select(F.col(id_col).alias("id"), F.posexplode(vector_col).alias("k", "x")).groupBy("id", "k").agg(F.avg("x").alias("x"))
    return each.groupBy("id").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"])).alias("vector"))


def _most_similar(queries: pa.Table, corpus: pa.Table) -> pa.Table:
    """For each query the most similar other row of ``corpus``, of equals the one with the smallest id."""
    matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    names, out = ["query_id", "corpus_id", "similarity"], []
    if queries.num_rows and corpus.num_rows:
        corpus = corpus.sort_by("id")
        ids, mine = corpus.column("id").to_numpy(), queries.column("id").to_numpy()
        product = matrix(queries) @ matrix(corpus).T
        product[mine[:, None] == ids] = -np.inf
        best = np.argmax(np.round(product, 12), axis=1)
        value = product[np.arange(len(mine)), best]
        out = [(q, i, v) for q, i, v in zip(mine.tolist(), ids[best].tolist(), value.tolist()) if v > -np.inf]
    columns = list(zip(*out)) if out else [[]] * 3
    return pa.table([pa.array(columns[0], queries.schema.field("id").type), pa.array(columns[1], corpus.schema.field("id").type), pa.array(columns[2], pa.float64())], names)


def best_match(queries: DataFrame, corpus: DataFrame, threshold: float = 0.82, block: int = 4096) -> DataFrame:
    """(query_id, corpus_id, similarity): the most similar corpus vector for each query, if it reaches ``threshold`` (ties: smallest id).

    Columns id (an integer) and vector, of length one, without nulls; a row is never its own
    answer.  Exact: chunks of queries meet blocks of the corpus, of about ``block`` vectors
    each, in one matrix product; a row for each query and block comes back.
    """
    kind = corpus.schema["id"].dataType.simpleString()
    slim = lambda rows: rows.select("id", "vector").where("id is not null and vector is not null")
    found = against(slim(queries), slim(corpus), lambda _: F.lit(1), block, _most_similar, f"query_id {queries.schema['id'].dataType.simpleString()}, corpus_id {kind}, similarity double")
    best = F.min(F.struct((-F.round("similarity", 12)).alias("order"), "corpus_id", "similarity")).alias("b")
    return found.groupBy("query_id").agg(best).select("query_id", "b.corpus_id", "b.similarity").where(F.col("similarity") >= threshold)
