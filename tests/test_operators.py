"""Operators on small cases with results worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import arrow
from palimpsest.functions import text as T
from palimpsest.operators import citations, compliance, dashboard, duplicates, evaluation, features, journals, overlap, quality, report, state, structure
from palimpsest.plans import documents as plans
from palimpsest.sources import files, sinks


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def value(spark, f, text):
    return one(spark, f(F.col("t")), t=text)


# text


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.words, "Don't re-use ÉTÉ 3D, O’Neil", ["don't", "re-use", "t", "3d", "o’neil"]),
        (T.alnum_words, "A-b C3", ["a", "b", "c3"]),
        (T.squeeze, " a \n\tb c ", "a b c"),
        (T.sentence_texts, "One. Two three! four? Five\n\nsix", ["One.", "Two three! four?", "Five", "six"]),
        (T.join_hyphens, "inter-\n national  text-", "international text-"),
        (T.quotes, 'He said "one two" and “three”.', ["one two", "three"]),
        (lambda c: T.windows(c, 4, 1), "abcdefghij", ["abcd", "defg", "ghij"]),
        (lambda c: T.windows(c, 4, 1), "  ", []),
        (lambda c: T.char_ngrams(c, 3), "abcd", ["abc", "bcd"]),
        (lambda c: T.char_ngrams(c, 3), "ab", []),
        (T.is_boilerplate, "  All rights   reserved. ", True),
        (T.drop_boilerplate_start, "Table of contents: one", "one"),
        (T.has_citation, "as in [3, 4-6].", True),
        (T.has_citation, "Smith et al. (2020a) say", True),
        (T.has_citation, "see (2020)", False),
        (T.fully_quoted, '"yes."', True),
        (T.without_controls, "a\x00b\ud83dc\x07".replace("\ud83d", ""), "abc"),
        (T.plain_doi, "https://doi.org/10.1234/AB.", "10.1234/ab"),
        (T.plain_doi, "12.1/x", None),
        (T.title_of_file, "my_file-name.txt", "My File Name"),
        (T.without_tags, "<p>a&amp;b</p><script>x</script><!-- c -->d", "a&b d"),
        (T.period_sentences, "One. two.. Three", ["one", "two", "three"]),
    ],
)
def test_text(spark, f, text, want):
    assert value(spark, f, text) == want


def test_segments_keep_offsets(spark):
    text = "  First one. Second “two”!  Third\nfourth "
    found = value(spark, lambda c: T.segments(c, T.SENTENCE_END), text)
    assert [s["text"] for s in found] == ["First one.", "Second “two”!", "Third", "fourth"]
    assert all(text[s["start"] : s["end"]] == s["text"] for s in found)


def test_quote_spans(spark):
    text = 'x "ab cd" y “e f”'
    assert [text[s["start"] : s["end"]] for s in value(spark, T.quote_spans, text)] == ["ab cd", "e f"]


def test_ngrams(spark):
    row = spark.createDataFrame([(["a", "b", "c"],)], ["w"])
    got = row.select(T.ngrams(F.col("w"), 2).alias("two"), T.ngrams(F.col("w"), 4).alias("four"), T.ngrams(F.col("w"), 0).alias("none"), T.shingles(F.col("w"), 5).alias("all")).first()
    assert (got["two"], got["four"], got["none"], got["all"]) == (["a b", "b c"], [], [], ["a b c"])


def test_arrow_functions(spark):
    assert value(spark, lambda c: arrow.nfkc(c), "ﬁnal ①") == "final 1"
    tokens = value(spark, lambda c: arrow.offset_tokens(c), "Die ﬁnale Straße")
    assert [(t["token"], t["start"], t["end"]) for t in tokens] == [("die", 0, 3), ("finale", 4, 9), ("strasse", 10, 16)]
    assert value(spark, lambda c: arrow.fingerprint(c), "A,  b!") == hashlib.sha256(b"a b").hexdigest()


# overlap

SENTENCE = "Deep models often overfit when the training data are small and the noise level is high"
SOURCES = [(1, SENTENCE + ". Another line about orchards."), (2, SENTENCE + ".")]


def scan(spark, text, sources=SOURCES, **more):
    paras = spark.createDataFrame([("d", k, p) for k, p in enumerate(text.split("\n"))], "doc_id string, paragraph_index int, text string")
    found = overlap.passages(paras, **more)
    corpus = overlap.corpus_sentences(spark.createDataFrame(sources, "item_id long, text string"))
    excluded = overlap.exclusions(found)
    matches = overlap.matches(overlap.alignments(found.where("kind = 'scored'"), corpus))
    return matches, overlap.document_report(matches, excluded).first(), overlap.source_summary(matches, excluded)


def test_exact_and_two_sources_count_words_once(spark):
    matches, report, by = scan(spark, SENTENCE + ".")
    assert [(m["method"], m["classification"]) for m in matches.collect()] == [("exact", "suspected_unattributed")] * 2
    assert report["matched_words"] == 16 and report["overall_similarity"] == 1.0 and report["match_count"] == 2
    assert [r["matched_words"] for r in by.collect()] == [16, 16]


def test_near_exact(spark):
    matches, report, _ = scan(spark, SENTENCE.replace("often", "rarely").replace("noise", "error").replace("high", "large") + ".", SOURCES[1:])
    assert [m["method"] for m in matches.collect()] == ["near_exact"] and report["matched_words"] == 13


def test_unrelated_boilerplate_and_empty(spark):
    assert scan(spark, "Bananas grow in orchards near the river and ripen late in a warm summer.")[1]["match_count"] == 0
    assert scan(spark, "All rights reserved.")[1]["boilerplate_passages"] == 1
    empty = scan(spark, "")[1]
    assert empty is None or (empty["overall_similarity"] is None and empty["score_status"] == "insufficient_content")


def test_quotation_with_citation_and_references(spark):
    text = f'"{SENTENCE}."'
    cited = spark.createDataFrame([("d", "paragraph:1")], "doc_id string, location string")
    matches, report, _ = scan(spark, text, SOURCES[1:], citations=cited)
    assert [m["classification"] for m in matches.collect()] == ["attributed_quotation"] and report["suspected_words"] == 0
    assert scan(spark, text, SOURCES[1:])[0].first()["classification"] == "quotation"
    parts = spark.createDataFrame([("d", 1, "References", "references", text)], "doc_id string, position int, heading string, type string, content string")
    assert scan(spark, text, SOURCES[1:], sections=parts)[1]["references_words"] == 16
    kinds = [(w["type"], w["severity"]) for w in overlap.warnings(matches).collect()]
    assert kinds == [("quotation_without_citation", "medium")] and overlap.warnings(matches, strict=True).count() == 0


def test_page_of(spark):
    spans = F.from_json(F.lit('[{"page":3,"start":0,"end":10},{"page":7,"start":12,"end":20}]'), "array<struct<page:int,start:int,end:int>>")
    assert [one(spark, overlap.page_of(spans, F.lit(x))) for x in (0, 9, 10, 12, 30)] == [3, 3, None, 7, None]


def test_source_lookup(spark):
    found = overlap.passages(spark.createDataFrame([("d", 0, "alpha beta gamma delta")], "doc_id string, paragraph_index int, text string"))
    rows = overlap.source_lookup(found, spark.createDataFrame([(1, "Alpha beta. gamma delta alpha."), (2, "alpha only")], "item_id long, text string")).orderBy("rank").collect()
    assert [(r["source_id"], r["source_sentence"], r["shared"]) for r in rows] == [(1, 1, 3), (1, 0, 2)]


# duplicates


def test_near_duplicates_and_groups(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (2, base), (3, base + " tail"), (4, "w1 w2 other things"), (5, "w1 w2 other things"), (6, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["near_duplicate_of"] for r in duplicates.near_duplicates(docs).collect()} == {1: 2, 2: 1, 3: 1, 4: 5, 5: 4}
    assert {r["doc_id"]: r["group_id"] for r in duplicates.near_groups(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6}
    assert {r["doc_id"]: r["duplicate_of"] for r in duplicates.exact_duplicates(docs).collect()} == {2: 1, 5: 4, 7: 6}


def test_leak_groups(spark):
    long_ = " ".join(f"word{k}" for k in range(30))
    rows = [("a", "b", "text one", "text two", 1, None), ("b", "c", "text three", "text four", 0, None), ("x", "y", long_, "other", 1, "g"), ("z", "w", long_ + " end", "more", 0, None), ("q", "r", "alone", "here", 1, "g"), ("s", "t", "far", "away", 0, None)]
    pairs = spark.createDataFrame(rows, "source_document_id string, suspicious_document_id string, source_text string, suspicious_text string, label int, group_id string")
    found = {r["source_document_id"]: r["leak_group"] for r in duplicates.pair_groups(pairs, arrow.fingerprint).collect()}
    assert found["a"] == found["b"] and found["x"] == found["z"] == found["q"] and len(set(found.values())) == 3


# features and evaluation


def test_features(spark):
    pairs = spark.createDataFrame([("a b c d", "a b c e")], "source_text string, suspicious_text string")
    row = features.lexical(pairs).first()
    assert row["word_overlap"] == 0.5556 and row["distinctive_phrase_ratio"] == 0.4 and row["passage_length_ratio"] == 1.0
    phrase = features.exact_phrases(pairs, least=3, threshold=0.6).first()["phrases"][0]
    assert (phrase["matched_text"], phrase["score"], phrase["suspicious_end"]) == ("a b c", 0.75, 5)
    assert features.exact_phrases(spark.createDataFrame([("All rights reserved", "all rights reserved.")], "source_text string, suspicious_text string"), least=3, threshold=0.5).first()["phrases"] == []
    scored = spark.createDataFrame([(1.0, 0.5, 0.5, 0.4, 0.0, 0.2, 1.0, 1)], list(features.NAMES)).select(features.weighted_score().alias("s"), features.label().alias("l")).first()
    assert scored["s"] == pytest.approx(0.56) and scored["l"] == "suspicious"
    arrays = spark.createDataFrame([(["a", "a", "b"], ["a", "c"])], "x array<string>, y array<string>")
    assert arrays.select(features.counter_cosine(F.col("x"), F.col("y")).alias("c")).first()["c"] == pytest.approx(2 / (5**0.5 * 2**0.5))
    assert value(spark, lambda c: features.citation_contexts(c, 4), "before [1] after Smith (2020) end") == ["ore [1] aft", "ter Smith (2020) end"]


def test_tfidf_cosine(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "blue fish"), (3, "green tree")], "id long, text string")
    vectors = features.tfidf(docs, "id", "text")
    assert vectors.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).where("abs(n - 1) > 1e-9").count() == 0
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "a long, b long")
    found = {(r["a"], r["b"]): r["tfidf_cosine"] for r in features.tfidf_cosine(pairs, vectors, vectors).collect()}
    assert found[(1, 3)] == 0.0 and found[(2, 2)] == 1.0 and 0.3 < found[(1, 2)] < 1


def test_best_match_blocks(spark):
    rows = [(k, [float(k % 5), 1.0, float(k % 3)]) for k in range(30)]
    vectors = spark.createDataFrame(rows, "id long, e array<double>").select("id", features.unit(F.col("e")).alias("vector"))
    whole, cut = (sorted(map(tuple, features.best_match(vectors.where("id < 5"), vectors.where("id >= 5"), block=b).select("query_id", "corpus_id").collect())) for b in (4096, 4))
    assert whole == cut and len(whole) == 5
    assert features.pooled(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, v array<double>"), "id", "v").first()["vector"] == pytest.approx([0.5**0.5] * 2)


def test_best_match_leaves_out_itself(spark):
    vectors = spark.createDataFrame([(k, [1.0, float(k % 4)]) for k in range(12)], "id long, e array<double>").select("id", features.unit(F.col("e")).alias("vector"))
    found = {r["query_id"]: r["corpus_id"] for r in features.best_match(vectors, vectors, block=5).collect()}
    assert found == {k: min(j for j in range(12) if j % 4 == k % 4 and j != k) for k in range(12)}
    assert features.best_match(vectors.limit(0), vectors).count() == 0 and features.best_match(vectors, vectors.limit(0)).count() == 0


def test_retrieval_in_blocks(spark):
    """Chunks and blocks of any size give what all pairs give."""
    import random

    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 12)))) for k in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(texts, "id long, text string")
    sets = {k: set((t or "").split()) for k, t in texts}
    want = []
    for q in range(0, 62, 7):
        near = sorted(((-len(sets[q] & s) / len(sets[q] | s), k) for k, s in sets.items() if k != q and sets[q] & s))[:4]
        want += [(q, k, -v, rank) for rank, (v, k) in enumerate(near, 1)]
    for size in (10, 1 << 20):
        found = evaluation.retrieval_ranks(docs.where("id % 7 = 0"), docs, 4, size).collect()
        assert sorted(map(tuple, found)) == sorted(want)


def test_precision_recall_in_ranges(spark):
    scored = spark.range(3000).select(((F.col("id") * 7919 % 1009) / 1009).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    rows = [tuple(r) for r in scored.collect()]
    for r in evaluation.precision_recall(scored).orderBy("threshold").collect()[::97]:
        above = [y for x, y in rows if x >= r["threshold"]]
        assert r["precision"] == pytest.approx(sum(above) / len(above)) and r["recall"] == pytest.approx(sum(above) / 1000)
    assert evaluation.precision_recall(scored.limit(0)).count() == 0


def test_missing_numbers(spark):
    """Gaps cost rows by the entries, not by the largest number."""
    raw = [(1, k, f"[{n}] Smith, J. Some title of a paper. Journal of Plants, 2021.") for k, n in enumerate(("2", "5", "2000000", "99999999999", "123456789012345678901234"), 1)]
    refs = citations.parse_references(spark.createDataFrame(raw, "doc_id long, position long, raw_text string"))
    none = citations.mentions(spark.createDataFrame([], "doc_id long, paragraph_index int, text string"))
    found = citations.issues(none, refs).where("type = 'missing_reference_number'")
    assert sorted(r["citation"] for r in found.collect()) == sorted(["[1]", "[3]", "[4]", "[6-1999999]", "[2000001-99999999998]"])


def test_semantic_and_classifier_matches(spark):
    """Passages that nothing matches yet are compared by vectors; candidates are scored in order, or a status says why not."""
    found = overlap.passages(overlap.paragraphs(spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog today.\nAn entirely different sentence about the growth of plants.\nToo short here.")], "doc_id long, text string")))
    corpus = overlap.corpus_sentences(spark.createDataFrame([(7, "The quick brown fox jumps over the lazy dog today."), (8, "The quick brown fox sleeps under the lazy cat today.")], "item_id long, text string"))
    lexical = overlap.matches(overlap.alignments(found, corpus))
    left = report.unmatched(found, lexical)
    assert [r["paragraph_index"] for r in left.collect()] == [1]
    vectors = left.withColumn("vector", F.array(F.lit(0.6), F.lit(0.8)))
    sources = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.6, 0.8]), (9, [0.6, 0.8])], "source_id long, vector array<double>")
    semantic = report.semantic_matches(vectors, sources)
    assert [(r["paragraph_index"], r["source_id"], r["similarity"], r["classification"]) for r in semantic.collect()] == [(1, 8, 1.0, "semantic_related")]
    external = spark.createDataFrame([(1, "x", 0.5)], "doc_id long, source_id string, similarity double")
    row = report.summary(lexical, semantic, external, overlap.exclusions(found)).first()
    assert (row["match_count"], row["lexical_match_count"], row["semantic_match_count"], row["external_match_count"], row["source_count"]) == (3, 1, 1, 1, 3)
    assert row["matched_words"] == 10 and row["suspected_unattributed_words"] == 10
    names = ("word_overlap", "char_overlap", "tfidf_cosine", "exact_phrase_match")
    assert report.classifier_scores(found, corpus, None, names) == (None, {"engine": "classifier", "candidate_pair_count": 2, "status": "unavailable", "detail": "no model is given"})
    pairs = spark.createDataFrame([(f"alpha beta gamma delta {k}", f"alpha beta gamma delta {k}" if k % 2 else f"one two three four {k}", k % 2) for k in range(20)], "source_text string, suspicious_text string, label int")
    model = evaluation.train(features.extracted(pairs), names)
    scores, status = report.classifier_scores(found, corpus, model, names)
    rows = scores.collect()
    assert status["status"] == "completed" and [r["source_id"] for r in rows] == [7, 8] and rows[0]["positive_score"] >= rows[1]["positive_score"]
    assert report.classifier_scores(found, corpus, model, ("semantic_cosine",))[1]["status"] == "failed"


def test_train_and_evaluate(spark):
    rows = spark.range(600).select((F.col("id") % 60).alias("leak_group"), (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 2) * 0.5 + F.rand(4) * 0.4).alias("word_overlap"), F.rand(5).alias("char_overlap"))
    model, limit, metrics = evaluation.evaluate(rows, ("word_overlap", "char_overlap"), attempts=50)
    found = {r["who"]: r for r in metrics.collect()}
    assert found["model"]["f1"] > 0.95 and 0 < limit < 1 and found["dummy"]["recall"] in (0.0, 1.0) and set(found) == {"model", "lexical", "dummy"}


def test_chunks_and_embedding(spark):
    text = "".join(chr(97 + k % 26) for k in range(40))
    cut = one(spark, features.chunks(F.col("t"), 15, 5), t=text)
    assert cut == [text[0:15], text[10:25], text[20:35], text[30:45]] and one(spark, features.chunks(F.col("t"), 15, 5), t="abc") == ["abc"]
    docs = spark.createDataFrame([(1, "a" * 1400 + "b" * 1400), (2, None), (3, "b")], "id long, text string")
    found = {r["id"]: r["vector"] for r in features.embedded(docs, "id", "text", lambda texts: [[t.count("a") + 0.0, t.count("b") + 0.0] for t in texts]).collect()}
    assert set(found) == {1, 3} and found[3] == [0.0, 1.0] and sum(x * x for x in found[1]) == pytest.approx(1.0)


def test_exclusions_of_documents_without_text(spark):
    docs = spark.createDataFrame([(1, "All rights reserved. One two three four."), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: (r["scored_words"], r["boilerplate_passages"]) for r in overlap.exclusions(overlap.passages(overlap.paragraphs(docs)), docs).collect()}
    assert rows == {1: (4, 1), 2: (0, 0), 3: (0, 0)}


def test_metrics(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.6, 0), (0.4, 1), (0.1, 0)], "score double, label int")
    row = evaluation.confusion(scored, 0.5).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["f1"]) == (1, 1, 1, 1, 0.5)
    assert evaluation.confusion(scored, 2.0).first()["precision"] == 0.0
    best = evaluation.best_threshold(scored).first()
    assert best["threshold"] == 0.4 and best["f1"] == 0.8
    ranks = evaluation.retrieval_ranks(spark.createDataFrame([(1, "a b c")], "id long, text string"), spark.createDataFrame([(7, "a b"), (8, "a b c"), (9, "z")], "id long, text string"))
    assert [r["corpus_id"] for r in ranks.orderBy("rank").collect()] == [8, 7]
    assert evaluation.recall_at(ranks, spark.createDataFrame([(1, 7)], "query_id long, corpus_id long"), (1, 2)).first()["recall_at_2"] == 1.0


def test_split_groups(spark):
    rows = spark.createDataFrame([(k % 20, k % 2) for k in range(400)], "g long, label int").withColumn("label", (F.rand(1) < 0.4).cast("int"))
    parts = evaluation.split_groups(rows, "g")
    counts = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sum(counts.values()) == 20 and counts["train"] in range(11, 16)
    assert sorted(map(str, parts.collect())) == sorted(map(str, evaluation.split_groups(rows, "g").collect()))
    with pytest.raises(Exception, match="both labels"):
        evaluation.split_groups(rows.withColumn("label", F.lit(1)), "g").collect()


def test_classifier(spark, tmp_path):
    rows = spark.createDataFrame([(float(k % 10), float(k), int(k % 10 > 4)) for k in range(200)], "a double, b double, label int")
    model = evaluation.train(rows, ("a", "b"))
    assert evaluation.predict(model, rows).where("predicted <> label").count() == 0
    meta = {k: "x" for k in sinks.METADATA}
    sinks.save_model(spark, model, meta, f"{tmp_path}/m")
    again, known = sinks.load_model(spark, f"{tmp_path}/m")
    assert known == meta and evaluation.predict(again, rows).where("predicted <> label").count() == 0
    with pytest.raises(ValueError, match="lacks"):
        sinks.save_model(spark, model, {}, f"{tmp_path}/n")


# citations


def test_citation_issues(spark):
    found = [(r["doc_id"], r["category"], r["citation"], r["detail"]) for r in plans.citation_issues(spark, "").collect()]
    of = lambda d, c: sorted((x, y) for i, k, x, y in found if (i, k) == (d, c))
    assert of(1, "duplicate_citation_numbers") == [("[1, 1]", "1")]
    assert of(1, "missing_references") == [("[3-4]", "3"), ("[3-4]", "4")]
    assert of(1, "author_year_mismatches") == [("Brown et al. (2021)", "2018, 2019")]
    assert of(1, "duplicate_reference_numbers") == [("2", None)] and of(1, "inconsistent_years") == [("title:sorting of pairs at scale", "2018, 2019")]
    assert of(1, "style_mismatches") == [("[1, 1]", None), ("[3-4]", None)]
    assert ("[1-999999999999999999999999]", None) in of(2, "numbering_issues") and ("[2]", "1") in of(2, "numbering_issues")
    assert of(2, "inconsistent_title_formatting") == [("1", None)] and of(2, "invalid_dois") == [("1", None)]
    assert ("2", None) in of(2, "malformed_references")


def test_citation_fixes(spark):
    rows = plans.citation_fixes(spark, "").where("doc_id = 1").collect()
    texts = {(r["kind"], r["position"]): r["text"] for r in rows}
    assert texts[("citation", 1)] == "[1]" and texts[("reference", 1)].startswith("[1] Smith") and texts[("reference", 1)].endswith("10.1234/abc.1")
    assert sum(r["kind"] == "reference" for r in rows) == 2


def test_reference_parse(spark):
    row = citations.parse_references(spark.createDataFrame([(1, 1, plans.ENTRIES[0][2])], "doc_id long, position long, raw_text string")).first()
    assert (row["id"], row["year"], row["doi"], row["title"]) == ("1", "2020", "10.1234/abc.1", "Overlap in long texts.")
    assert row["authors"][0].startswith("Smith, J")


# structure, quality, compliance, venues


def lines(spark, *texts):
    return spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "doc_id string, pos int, text string")


def test_sections(spark):
    rows = lines(spark, "before", "1. Introduction", "some text here.", "2.1 Methods", "more text.", "REFERENCES", "[1] A entry.", "[2] B entry.")
    found = structure.sections(rows).orderBy("position").collect()
    assert [(s["type"], s["level"], s["content"]) for s in found][:2] == [("introduction", 1, "some text here."), ("methodology", 2, "more text.")]
    assert structure.sections(lines(spark, "no heading here.", "none.")).first()["heading"] == "Body"
    assert structure.captions(lines(spark, "Figure 1. Old", "fig. 1: New", "Table 2: T"), "figure").collect()[0]["caption"] == "New"
    front = structure.front_matter(lines(spark, "A Study Of Things", "Ann Lee, Bo Kim", "University of X, Dept.", "Keywords: a, b"), structure.sections(lines(spark, "A Study Of Things"))).first()
    assert (front["title"], front["authors"], front["keywords"]) == ("A Study Of Things", ["Ann Lee", "Bo Kim"], ["a", "b"])
    objects = structure.objects_with_captions(spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, number int"), spark.createDataFrame([("d", 2, "c"), ("d", 3, "e")], "doc_id string, number int, caption string"))
    assert sorted((r["number"], r["caption"], r["has_object"]) for r in objects.collect()) == [(1, "", True), (2, "c", True), (3, "e", False)]
    assert structure.equation_numbers(lines(spark, "E = mc (3)", "no")).first()["number"] == "3"


def test_evidence_is_monotonic(spark):
    rows = {r["doc_id"]: r for r in quality.with_evidence(plans.manuscripts(spark)).collect()}
    assert rows["m1"]["methodology_score"] > rows["m2"]["methodology_score"] >= rows["m3"]["methodology_score"] == 0
    assert rows["m1"]["novelty_score"] == 100 and rows["m3"]["novelty_score"] == 0


def test_writing_and_improvements(spark):
    found = quality.writing_findings(plans.manuscripts(spark)).where("doc_id = 'm2'").collect()
    assert sorted(f["finding"] for f in found) == ["repeated", "vague_quantity"]
    numbers = [r["improvement_id"] for r in plans.improvement_list(spark, "").where("doc_id = 'm1'").collect()]
    assert sorted(numbers) == sorted(f"improvement-{k}" for k in range(1, len(numbers) + 1))


def test_replace_and_invented(spark):
    row = spark.createDataFrame([("One  TWO three one two", "one two", "1.5 [3]")], ["t", "o", "r"])
    got = row.select(quality.replace_first(F.col("t"), F.col("o"), F.col("r")).alias("x"), quality.invented(F.lit("has 2"), F.lit("has 2 and 3% [4]")).alias("y")).first()
    assert got["x"] == "1.5 [3] three one two" and "[4]" in got["y"] and not any(v == "2" for v in got["y"])
    assert [(r["kind"], r["index"]) for r in quality.locate(plans.manuscripts(spark), "crop  DISEASE on").collect()] == [("abstract", None)]


def test_compliance(spark):
    rules = {(r["doc_id"], r["journal_id"], r["rule_id"]): r["status"] for r in plans.compliance_rules(spark, "").collect()}
    assert rules[("m1", "crops", "structure.abstract")] == "passed" and rules[("m1", "crops", "structure.discussion")] == "failed"
    assert rules[("m1", "crops", "declaration.funding")] == "failed" and rules[("m2", "water", "length.word_limit")] == "passed"
    assert rules[("m1", "crops", "citations.missing_references")] == "failed" and rules[("m3", "crops", "length.page_limit")] == "not_applicable"
    for r in plans.compliance_score(spark, "").collect():
        mine = [v for k, v in rules.items() if k[:2] == (r["doc_id"], r["journal_id"])]
        assert r["passed"] == mine.count("passed") and r["overall_status"] == "failed"
    kinds = spark.createDataFrame([("Survey",), ("short-paper",), (None,), ("Conference Paper",)], ["t"]).select(compliance.article_type(F.col("t")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["review", "short_communication", "original_research", "conference_paper"]
    assert compliance.article_types(spark).count() == 4


def test_venues(spark):
    found = {(r["doc_id"], r["journal_id"]): r for r in plans.journal_ranking(spark, "").collect()}
    assert found[("m1", "crops")]["rank"] == 1 and found[("m2", "water")]["rank"] == 1
    assert found[("m3", "crops")]["suitability"] is None and found[("m3", "crops")]["match_status"] == "insufficient_content"
    with pytest.raises(ValueError, match="extend each other"):
        journals.resolve({"bases": {"a": {"extends": "b"}, "b": {"extends": "a"}}, "profiles": [{"journal_id": "x", "extends": "a"}]})
    with pytest.raises(ValueError, match="unknown"):
        journals.resolve({"profiles": [{"journal_id": "x", "extends": "nope"}]})
    assert journals.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_dashboard(spark):
    found = plans.prioritised_actions(spark, "").where("doc_id = 'm1'").orderBy("rank").collect()
    assert found[0]["priority"] == "CRITICAL" and [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len(found) <= 20
    shown = {(r["doc_id"], r["key"]): r["available"] for r in plans.dashboard_indicators(spark, "").collect()}
    assert len(shown) == 15 and shown[("m1", "readiness")] and not shown[("m1", "similarity")]
    assert plans.dimension_summary(spark, "").count() == 39
    rows = spark.createDataFrame([("d", "HIGH"), ("d", "LOW"), ("d", "HIGH")], "doc_id string, category string")
    assert tuple(dashboard.priority_counts(rows).first()) == ("d", 0, 2, 0, 1)
    documents = spark.createDataFrame([("d", "u", 1), ("e", "u", 2)], "doc_id string, user_id string, updated_at int")
    ready = spark.createDataFrame([("d", 71)], "doc_id string, overall_readiness int")
    got = dashboard.account_summary(documents, ready, rows).first()
    assert (got["manuscripts"], got["analysed"], got["readiness_average"], got["open_suggestions"], got["urgent_suggestions"], got["recent"]) == (2, 1, 71, 3, 2, "e")
    assert dashboard.searched(documents, " D ", "doc_id").count() == 1 and dashboard.searched(documents, "", "doc_id").count() == 2
    levels = spark.createDataFrame([("factual", "LOW"), ("rule", "HIGH"), ("rule", "LOW")], "e string, p string").select(dashboard.confidence(F.col("e"), F.col("p")).alias("c"))
    assert [r["c"] for r in levels.collect()] == ["high", "medium", "low"]
    swaps = F.array(F.struct(F.lit("[1]").alias("old"), F.lit("[9]").alias("new")), F.struct(F.lit("[1], [2]").alias("old"), F.lit("[7]").alias("new")))
    assert one(spark, citations.rewritten(F.lit("a [1], [2] b [1]"), swaps)) == "a [7] b [9]"
    assert dashboard.engine_status(spark, False, True, False).where("status = 'available'").count() == 2


# state, sources, sinks, streaming


def test_state(spark):
    log = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "x"), (2, 1, "b", None)], "k long, at long, v string, w string")
    assert sorted(tuple(r) for r in state.folded(log, ["k"], ["at"], ["v", "w"]).collect()) == [(1, "a", "x"), (2, "b", None)]
    assert state.as_of(log, ["k"], "at", F.lit(1)).where("k = 1").first()["v"] == "a"
    diff = state.version_diff(spark.createDataFrame([("a\nb\nc", "a\nx\ny\nc")], "o string, n string"), "o", "n").first()
    assert (diff["blocks"], diff["lines_added"], diff["lines_removed"]) == (1, 2, 1)
    comments = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "comment_id long, parent_id long")
    assert {r["comment_id"]: (r["root_id"], r["depth"]) for r in state.threads(comments).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0)}
    docs, users = spark.createDataFrame([("d", 1)], "document_id string, owner_id long"), spark.createDataFrame([(1, False), (9, True)], "user_id long, is_admin boolean")
    shared = spark.createDataFrame([("d", 2, "viewer", "accepted"), ("d", 3, "editor", "pending"), ("d", 1, "viewer", "accepted")], "document_id string, user_id long, role string, status string")
    assert {r["user_id"]: r["role"] for r in state.accessible(docs, shared, users).collect()} == {1: "owner", 2: "viewer", 9: "admin"}
    assert {r["user_id"] for r in state.accessible(docs, shared, users).where(state.may_see(F.lit("d"))).collect()} == {1, 2, 9} and {r["user_id"] for r in state.accessible(docs, shared, users).where(state.may_see(F.lit("e"))).collect()} == {9}
    log = spark.createDataFrame([(1, 10, None), (1, 11, 5), (2, 12, None)], "user_id long, note_id long, read_at long")
    assert sorted(tuple(r) for r in state.mark_read(log, "user_id", ["note_id"], F.lit(9)).collect()) == [(1, 10, 9), (2, 12, 9)]
    versions, wanted = spark.createDataFrame([("d", 1, "old"), ("d", 2, "new"), ("e", 1, "x")], "document_id string, version long, text string"), spark.createDataFrame([("d", 1)], "document_id string, version long")
    assert [tuple(r) for r in state.restored(versions, "document_id", "version", wanted).select("document_id", "version", "text").collect()] == [("d", 3, "old")]
    assert [r["item_id"] for r in state.numbered(spark.range(2), [], ["id"], "SUG-").collect()] == ["SUG-001", "SUG-002"]


def test_corpus_readers(spark, tmp_path):
    (tmp_path / "my_notes.txt").write_text("Some text.")
    (tmp_path / "more.json").write_text('{"sources": [{"id": "s1", "text": "One.", "year": 2020}]}')
    (tmp_path / "list.json").write_text('[{"id": "s1", "text": "Two.", "title": "T"}]')
    text, more, listed = files.text_corpus(spark, f"{tmp_path}/my_notes.txt"), files.json_corpus(spark, f"{tmp_path}/more.json"), files.json_corpus(spark, f"{tmp_path}/list.json")
    row = text.first()
    assert (row["id"], row["title"], row["source_type"]) == ("file-my_notes", "My Notes", "custom_corpus_file")
    assert more.first()["title"] == "s1" and files.combined(text, more).count() == 2
    info = files.corpus_info(files.combined(text, more)).first()
    assert info["sources"] == 2 and info["version"] != files.corpus_info(files.combined(text, listed)).first()["version"]
    with pytest.raises(Exception, match="two sources"):
        files.combined(more, listed).collect()
    (tmp_path / "empty.txt").write_text(" \n")
    with pytest.raises(Exception, match="must have"):
        files.text_corpus(spark, f"{tmp_path}/empty.txt").collect()


def test_labelled_pairs(spark, tmp_path):
    import csv
    import json

    row = {"source_document_id": "a", "suspicious_document_id": "b", "source_text": "One, two", "suspicious_text": "three\nfour", "label": 1}
    swapped = row | {"source_document_id": "b", "suspicious_document_id": "a", "source_text": "three four", "suspicious_text": "one two"}
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(r) for r in (row, swapped)))
    (tmp_path / "p.json").write_text(json.dumps({"data": [row]}))
    with (tmp_path / "p.csv").open("w", newline="", encoding="utf-8-sig") as out:
        writer = csv.DictWriter(out, row)
        writer.writeheader(), writer.writerow(row)
    for name in ("p.jsonl", "p.json", "p.csv"):
        found = files.valid_pairs(files.labelled_pairs(spark, f"{tmp_path}/{name}")).collect()
        assert len(found) == 1 and found[0]["label"] == 1
    for change, message in (({"label": 2}, "0 or 1"), ({"source_text": " "}, "two ids"), ({"label": 0}, "two labels")):
        (tmp_path / "bad.jsonl").write_text("\n".join(json.dumps(r) for r in (row, row | change)))
        with pytest.raises(Exception, match=message):
            files.valid_pairs(files.labelled_pairs(spark, f"{tmp_path}/bad.jsonl")).collect()
    with pytest.raises(ValueError, match="datasets are"):
        files.labelled_pairs(spark, "x.xml")


def test_docx_and_uploads(spark, tmp_path):
    import zipfile

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as out:
        out.writestr("word/document.xml", f'<w:document {space}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Intro</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Some </w:t><w:t>text</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    (tmp_path / "d.exe").write_bytes(b"x")
    uploads = spark.read.format("binaryFile").load(f"{tmp_path}/*")
    problems = {r["path"][-5:]: r["problem"] for r in files.admitted(uploads).collect()}
    assert problems["a.docx"[-5:]] is None and problems["c.pdf"] == "not a PDF" and problems["d.exe"] == "unsupported file type"
    rows = files.docx_paragraphs(uploads.where("path like '%docx'")).collect()
    assert sorted(((r["path"][-6:], r["style"], r["text"]) for r in rows), key=str) == [("a.docx", "Heading1", "Intro"), ("a.docx", None, "Some text"), ("b.docx", None, None)]


def test_ingest_status_and_external(spark):
    rows = spark.createDataFrame([("1", "u", "h1", "word " * 30, None), ("2", "u", "h2", "word " * 30, None), ("3", "u", "h3", "few", None), ("4", "u", "h4", None, "corrupt"), ("5", "u", "h5", "word " * 30, None)], "id string, user_id string, sha256 string, text string, problem string")
    known = spark.createDataFrame([("u", "h2", "0")], "user_id string, sha256 string, id string")
    near = spark.createDataFrame([("5", "1")], "id string, near_duplicate_of string")
    assert {r["id"]: r["status"] for r in files.ingest_status(rows, known, near).collect()} == {"1": "indexed", "2": "duplicate", "3": "needs_ocr", "4": "failed", "5": "duplicate"}
    found = files.external_results(spark.createDataFrame([("d", '{"results":[{"title":"T","score":0.4,"matchedWords":7}]}')], "doc_id string, payload string")).first()
    assert (found["source_id"], found["similarity"], found["matched_words"]) == ("external-1", 0.4, 7)
    base, extra = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string"), spark.createDataFrame([(1, "A", None, "new")], "k int, x string, y string, z string")
    assert tuple(files.enriched(base, extra, "k").first()) == (1, "A", "b")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, v int")
    sinks.append_snapshot(rows, f"{tmp_path}/s")
    sinks.append_snapshot(rows, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 4
    sinks.append_state(rows, f"{tmp_path}/l")
    sinks.append_state(rows.withColumn("v", F.col("v") + 10), f"{tmp_path}/l")
    assert {r["document_id"]: r["v"] for r in sinks.read_state(spark, f"{tmp_path}/l", ["document_id"]).collect()} == {"d1": 11, "d2": 12}
    sinks.write_reports(rows, f"{tmp_path}/r", "document_id")
    assert spark.read.json(f"{tmp_path}/r").count() == 2


def test_streaming_scan(spark, tmp_path):
    from palimpsest.streaming import scan as streaming

    rows = spark.createDataFrame([(1, SENTENCE + "."), (2, SENTENCE + "."), (3, "Nothing alike.")], "doc_id long, text string").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    corpus = overlap.corpus_sentences(spark.createDataFrame(SOURCES[1:], "item_id long, text string"))
    query = streaming.scan(streaming.arrivals(spark, f"{tmp_path}/in"), corpus, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.count() == 1 and found.first()["method"] == "exact"


# one pass over large inputs


def counted(spark, pairs, column):
    """``pairs``, and how often a value of ``column`` has been computed."""
    times = spark.sparkContext.accumulator(0)

    def seen(value):
        times.add(1)
        return value

    return pairs.withColumn(column, F.udf(seen)(column)), times


def test_aligned_in_blocks(spark):
    source = "The quick brown fox jumps over the lazy dog near the old river bank."
    lines = [source, f"Intro words stand here. {source} And more follows", f"No. boundary before {source}", "the the the the the the the the the the", "fox. dog. river. bank. The quick. Brown fox. jumps over.", "", source.upper() + "\x01" + source, "plain words about other things that never occur in any source at all", "The quick brown fox jumps over a lazy cat near the old stone bank."]
    paras = spark.createDataFrame([(1, k, line) for k, line in enumerate(lines)] + [(2, 0, None)], "doc_id long, paragraph_index int, text string")
    corpus = overlap.corpus_sentences(spark.createDataFrame([(1, source), (2, "Wholly different sentences are kept here so that there are several blocks."), (3, None)], "item_id long, text string"))
    slim = lambda rows: sorted(map(tuple, rows.select("doc_id", "paragraph_index", "sentence_index", "source_id", "matched", "ratio", "char_start").collect()))
    whole = slim(overlap.alignments(overlap.passages(paras).where("kind = 'scored'"), corpus))
    assert len(whole) >= 4
    assert whole == slim(overlap.aligned(paras, corpus)) == slim(overlap.aligned(paras, corpus, 4))
    kept = overlap.likely_paragraphs(paras, [r[0] for r in corpus.select("source_tokens").collect()])
    assert {r["paragraph_index"] for r in kept.collect()} == {r[1] for r in whole}


def test_features_compute_pairs_once(spark):
    pairs, times = counted(spark, spark.createDataFrame([("one two three four", "one two three five"), ("a b c d e", "a b c d f")], "source_text string, suspicious_text string"), "suspicious_text")
    assert features.extracted(pairs).count() == 2
    assert len(features.extracted(pairs).collect()) == 2 and times.value == 4


def test_features_of_equal_pairs_are_computed_once(spark, monkeypatch):
    times = spark.sparkContext.accumulator(0)

    def seen(value):
        times.add(1)
        return value

    lexical = features.lexical
    monkeypatch.setattr(features, "lexical", lambda pairs, a, b: lexical(pairs.withColumn(a, F.udf(seen)(a)), a, b))
    pairs = spark.createDataFrame([(k, "one two three four", "one two three five") for k in range(20)] + [(20, None, "other")], "k long, source_text string, suspicious_text string")
    rows = features.extracted(pairs).collect()
    assert len(rows) == 21 and {r["word_overlap"] for r in rows if r["k"] < 20} == {0.5556} and {r["source_text"] for r in rows if r["k"] == 20} == {None}
    assert times.value <= 6


def test_pair_groups_compute_pairs_once(spark):
    rows = [("a", "b", "text one", "text two"), ("b", "c", "text three", "text four"), ("x", "y", "alone", "here")]
    pairs, times = counted(spark, spark.createDataFrame(rows, "source_document_id string, suspicious_document_id string, source_text string, suspicious_text string"), "source_text")
    assert len({r["leak_group"] for r in duplicates.pair_groups(pairs, arrow.fingerprint).collect()}) == 2
    assert times.value == 3


def test_retrieval_copies_no_corpus(spark):
    docs = spark.createDataFrame([(k, f"w{k % 5} w{k % 3} x") for k in range(30)], "id long, text string")
    few, many = (evaluation.retrieval_ranks(docs.where("id % 10 = 0"), docs, 3, size) for size in (4, 1 << 21))
    assert "CoGroup" not in few._jdf.queryExecution().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 9
    assert evaluation.retrieval_ranks(docs.where("false"), docs).count() == 0 == evaluation.retrieval_ranks(docs, docs.where("false")).count()
