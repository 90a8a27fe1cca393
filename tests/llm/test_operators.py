"""The training-data operators against brute force, round trips, held-out rows, and awkward tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from palimpsest.llm import chat, decontaminate, linear, mixing, quality_rules, queries, simhash, token_counts, toxicity, url_filter, warc, weak_quality
from tests.oracle import SF, check

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SQL = queries.oracle_sql()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


#: Names that operators use for columns of their own, with and without marks, and a dotted one.
CLASH = (
    "id label fingerprint component_id text_ item window n n_words spans items hit_spans score kept page size target taken fp key host path node g o heads sketch none sid hash again group blocks t p q side "
    "__id __hash __n __null __size __n_words __spans __items __score __source __none __key __cut __epochs row votes posterior bytes held rule verdict found spelt a.b a`b"
).split()


def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names, bytes that aren't UTF-8."""
    rng = random.Random(3)
    long_ = " ".join(words(rng, 30_000))
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b c", "s"), (None, None, None), (2, None, "s"), (3, "", None), (4, " \n\t ", "t"), (5, long_, "t"), (6, "x" * 50_000, "t"), (7, "a b c", None), (9, " " * 2_000_000, "t")]
    bad = spark.range(1).select(F.lit(8).cast("long").alias("doc_id"), F.expr("cast(X'6120C328FF2062' as string)").alias("text"), F.lit("en").alias("lang"), F.lit("t").alias("source"), F.lit(7).cast("long").alias("n_chars"))
    docs = documents(spark, rows).unionByName(bad)
    return docs.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASH])


def same_columns(before, after):
    """``after`` has the columns of ``before``, and what clashes has kept its values."""
    assert after.columns == before.columns
    rows = after.toDF(*[f"c{k}" for k in range(len(after.columns))]).collect()
    return rows and all(list(r)[5:] == [f"clash {c}" for c in CLASH] for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    check(spark, queries.queries()[name], SQL[name])


# 1 --------------------------------------------------------------------------------------


def brute_hits(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for item, item_text in items:
            v = split(item_text)
            for s in range(max(1, len(v) - window + 1) if v else 0):
                part = v[s : s + window]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        found |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination(spark, block_bytes):
    rng = random.Random(1)
    items = [(k, " ".join(words(rng, rng.choice([1, 4, 9, 10, 25]), 30))) for k in range(12)] + [(None, "only here once"), (3, None), (4, ""), (0, "W1 w1,w1! É w2")]
    docs = []
    for i in range(60):
        text = words(rng, rng.randrange(60), 30)
        if i % 3 == 0:
            text += ["Only", "HERE", "once"] + (items[i % 12][1] or "").upper().split()
        docs.append((i, " ".join(text)))
    docs += [(60, None), (61, "w1-w1 w1\x00é w2"), (None, "w1 w1")]
    frame = documents(spark, [(i, t, "s") for i, t in docs])
    found = decontaminate.report(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in found), key=str) == brute_hits(docs, items)
    assert all(r["items_sha256"] == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() and r["contaminated"] == (r["n_hit"] > 0) for r in found)


def test_decontamination_keeps_clean(spark):
    rows = [(1, "one two three", "s"), (2, "nothing of it", "s"), (2, "nothing of it", "s"), (3, None, None)]
    kept = decontaminate.clean(documents(spark, rows), spark.createDataFrame([(1, "two three")], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 3] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_decontamination_awkward(spark):
    docs, items = awkward(spark), spark.createDataFrame([(1, "A b C", 1, 2), (2, None, 1, 2), (None, "", 1, 2)], "item_id long, text string, item long, window long").withColumnRenamed("item", "a.b")
    for options in ({}, {"block_bytes": 1}):
        found = {r["doc_id"]: r for r in decontaminate.report(docs, items, **options).where("doc_id is not null").collect()}
        assert found[1]["n_hit"] == 3 and found[1]["items"] == ["1"] and found[5]["n_words"] == 30_000 and found[9]["n_words"] == 0 and found[8]["n_words"] == 4 and found[2]["n_hit"] == 0
        kept = decontaminate.clean(docs, items, **options)
        assert same_columns(docs, kept) and sorted((r[0] for r in kept.select("doc_id").collect()), key=str) == sorted([2, 3, 4, 5, 6, 8, 9, None], key=str)
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count() and decontaminate.report(docs.limit(0), items).count() == 0


def test_decontamination_of_many_blocks(spark, monkeypatch):
    """A benchmark of 20 blocks: one pass to count, one for each block, and no text but the input's."""
    passes, marked = [], decontaminate._mark
    monkeypatch.setattr(decontaminate, "_mark", lambda docs, *rest: passes.append(docs.columns) or marked(docs, *rest))
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, 14, 50))) for k in range(60)]
    docs = [(k, " ".join(words(rng, 30, 50) + (items[k % 60][1].split()[2:13] if k % 2 else []) + (items[(k * 7) % 60][1].split() if k % 4 == 1 else []))) for k in range(80)]
    frame, bench = documents(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(" ".join(t.split()[i : i + 10])) + 64 for _, t in items for i in range(5))
    found = decontaminate.report(frame, bench, block_bytes=-(-size // 20)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in found), key=str) == brute_hits(docs, items)
    assert 15 < len(passes) <= 20 and all(len(c) == 1 for c in passes[1:])


# 2 --------------------------------------------------------------------------------------


def test_preference_format(spark):
    turn = "array<struct<role:string,text:string>>"
    u, a = lambda t: ("user", t), lambda t: ("assistant", t)
    rows = [("x", [u("hi"), a("yes"), u("and"), a("good")], [u("hi"), a("yes"), u("and"), a("bad"), u("?")]), ("same", [u("q"), a("r")], [u("q"), a("r")]), ("apart", [u("q")], [u("p")]), ("null", None, [a("only")])]
    found = {r["id"]: r for r in chat.format_pairs(spark.createDataFrame(rows, f"id string, chosen {turn}, rejected {turn}")).collect()}
    x = found["x"]
    assert x["prompt_turns"] == 3 and x["prompt"].endswith("<|user|>\nand<|end|>\n")
    assert [x["chosen_completion"][s["start"] : s["end"]] for s in x["chosen_mask"]] == ["good<|end|>\n"]
    assert [x["rejected_completion"][s["start"] : s["end"]] for s in x["rejected_mask"]] == ["bad<|end|>\n"]
    assert found["same"]["chosen_completion"] == "" and found["same"]["prompt_turns"] == 2
    assert found["apart"]["prompt"] == "" and found["apart"]["chosen_mask"] == []
    assert found["null"]["chosen_completion"] == "" and found["null"]["rejected_completion"] == "<|assistant|>\nonly<|end|>\n"


def test_conversations_awkward(spark):
    rows = [(0, 1, "assistant", "b"), (0, 0, "user", "a"), (0, 0, "user", "a"), (0, 2, "user", "later"), (1, 0, None, None), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, "user", "first"), (2, 0, "assistant", "y" * 200_000), (4, 0, "user", "no answer"), (5, 0, "assistant", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(c) for c in ("conv", "turns", "last", "prompt", "pair", "both", "TEXT", "a.b")])
    found = {r["conv"]: [tuple(t) for t in r["turns"]] for r in chat.conversations(frame).collect()}
    assert found == {0: [("user", "a"), ("assistant", "b"), ("user", "later")], 1: [("", ""), ("assistant", "")], 2: [("user", "first"), ("assistant", "y" * 200_000)], 4: [("user", "no answer")], 5: [("assistant", "z")]}
    swaps = {r["conv"]: r for r in chat.answer_swaps(frame).collect()}
    assert set(swaps) == {0, 1, 2, 4, 5} and [swaps[k]["rejected"] for k in (2, 4, 5)] == [None] * 3
    assert [tuple(t) for t in swaps[0]["rejected"]] == [("user", "a"), ("assistant", ""), ("user", "later")]
    assert [tuple(t) for t in swaps[1]["rejected"]] == [("", ""), ("assistant", "b")]
    formatted = {r["conv"]: r for r in chat.format_pairs(chat.answer_swaps(frame)).collect()}
    assert formatted[0]["chosen_completion"].endswith("later<|end|>\n") and formatted[4]["rejected_completion"] == "" and formatted[4]["prompt"] == ""
    assert chat.format_pairs(chat.answer_swaps(frame.limit(0))).count() == 0
    pairs = chat.answer_swaps(frame).select("*", *[F.lit(7).alias(c) for c in ("prompt", "chosen_mask", "keep.me", "CHOSEN")])
    assert [r["keep.me"] for r in chat.format_pairs(pairs).collect()] == [7] * 5 and chat.format_pairs(pairs).columns.count("prompt") == 1


def test_conversations_with_string_ids(spark):
    """Ids that aren't integers find neighbours too: each in one pair at most, and all but the odd ones."""
    rows = [(f"c {k}", t, role, f"{role} {k}") for k in range(41) for t, role in enumerate(("user", "assistant"))]
    found = {r["conv"]: r for r in chat.answer_swaps(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    other = {k: r["rejected"][-1]["text"].removeprefix("assistant ") for k, r in found.items() if r["rejected"]}
    assert len(found) == 41 and len(other) == 40 and all(other[f"c {v}"] == k.removeprefix("c ") and f"c {v}" != k for k, v in other.items())


# 3 --------------------------------------------------------------------------------------


def test_length_histogram(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(documents(spark, [(None, None, None), (1, "", "s"), (2, "z" * 20_000, "s")]))
    code = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.ranks(token_counts.VOCABULARY), special_tokens={})
    lengths = [len(code.encode_ordinary(r["text"] or "")) for r in docs.collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(docs)).cache()
    rows = {r["length"]: r for r in sums.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == {k: lengths.count(k) for k in lengths}
    for k in list(rows)[::7]:
        assert rows[k]["docs_from"] == sum(x >= k for x in lengths) and rows[k]["tokens_from"] == sum(x for x in lengths if x >= k)
        assert rows[k]["truncated_total"] == sum(min(x, k) for x in lengths)
    limits = [0, 1, 5, 100, 513, 10**6]
    assert {r["context_limit"]: (r["truncated_total"], r["docs_cut"]) for r in token_counts.at_limits(sums, limits).collect()} == {m: (sum(min(x, m) for x in lengths), sum(x > m for x in lengths)) for m in limits}
    assert {r["share"]: r["length"] for r in token_counts.quantiles(sums, [0.5, 0.9, 1.0]).collect()} == {q: sorted(lengths)[int(np.ceil(q * len(lengths) - 1e-9)) - 1] for q in (0.5, 0.9, 1.0)}
    assert token_counts.suffix_sums(token_counts.histogram(docs.limit(0))).count() == 0


def test_token_counts_awkward(spark):
    """Very long runs of one kind of character, bytes that aren't UTF-8, clashing names."""
    import tiktoken

    code = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.ranks(token_counts.VOCABULARY), special_tokens={})
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["word", " ", "  ", "\n", " \t", "12", "é", "!?", "'s", "\u00a0", "\x1c"]) for _ in range(rng.randrange(30)))
        import regex

        assert sum(len(code._encode_single_piece(m[0])) for m in regex.finditer(token_counts.PATTERN, text)) == len(code.encode_ordinary(text))
    docs = awkward(spark)
    rows = token_counts.histogram(docs).collect()
    assert sum(r["n_docs"] for r in rows) == docs.count()
    assert token_counts.n_tokens(code, "a" + " " * 2_000_000 + "b", token_counts.PATTERN) > 100


# 4 --------------------------------------------------------------------------------------


def test_toxicity(spark):
    found = toxicity.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).cache()
    assert found.count() == 1000 and found.where("score not between 0 and 1 or predicted <> int(score >= 0.3)").count() == 0
    assert {(r["doc_id"], r["held_out"]) for r in found.collect()} == {(i, zlib.crc32(str(i).encode()) % 4 == 2) for i in range(1000)}
    held = found.where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9


def test_toxicity_awkward(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 40) + (["vileword"] if i % 3 == 0 else [])), "s") for i in range(120)]
    docs = awkward(spark)
    docs = docs.unionByName(documents(spark, rows).select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASH]))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(None, 1, 1), (5, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.report(docs, labels).collect()
    assert len(found) == 132 and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in found if r["held_out"] and 10 <= r["doc_id"])
    assert toxicity.report(docs.limit(0), labels.limit(0)).count() == 0
    assert toxicity.report(docs, labels.where("toxic = 0")).where("predicted = 1").count() == 0
    clean = toxicity.clean(docs, labels)
    assert same_columns(docs, clean)
    assert sorted(r[0] for r in clean.select("doc_id").where("doc_id between 10 and 20").collect()) == [10, 11, 13, 14, 16, 17, 19, 20]


def test_toxicity_against_brute_force():
    """Features, ratios and scores as plain Python finds them, and coefficients at which the penalised loss has no slope."""
    rng = random.Random(8)
    values = [(" ".join(words(rng, 12, 40)) + (" Ugly  Thing" if i % 2 else "")).encode() for i in range(50)] + [b"", b"\xff\xc3("]
    label = np.array([i % 2 for i in range(50)] + [0, 1])

    def grams(text):
        t = f" {' '.join(text.decode('utf-8', 'replace').lower().split())} "
        return {t[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}

    bucket = lambda g: int(list(grams_of(g))[-1])

    def grams_of(g):
        total = 0
        for k, c in enumerate(g):
            total = ((total + ord(c) + 1) * 0x9E3779B97F4A7C15) % 2**64
            total ^= total >> 31
        return [((total * (0xC2B2AE3D27D4EB4F + 2 * len(g))) % 2**64) >> (64 - toxicity.BITS)]

    sets = [{bucket(g) for g in grams(v)} for v in values]
    present = toxicity.Present()
    assert [set(present(v).tolist()) for v in values] == sets and all(len(present(v)) == len(s) for v, s in zip(values, sets))
    known = sorted(set().union(*sets))
    n = {k: int((label == k).sum()) for k in (0, 1)}
    ratio = {b: np.log(((sum(b in s for s, y in zip(sets, label) if y) + 1) / (n[1] + 2)) / ((sum(b in s for s, y in zip(sets, label) if not y) + 1) / (n[0] + 2))) for b in known}
    found = toxicity.ratios([present(v) for v in values], label == 1)
    assert max(abs(found[b] - ratio[b]) for b in known) < 1e-9 and np.count_nonzero(found) <= len(known)
    weight, penalty = {0: 3.0, 1: 1.0}, 1e-2
    model = toxicity.trained(values, label, weight, penalty, 1000)
    coefficient = np.array([model.weight[b] / ratio[b] if abs(ratio[b]) > 1e-9 else 0.0 for b in known])
    table = np.array([[ratio[b] * (b in s) for b in known] for s in sets])
    chance = 1 / (1 + np.exp(-(table @ coefficient + model.intercept)))
    assert np.abs(model.scores(values, present) - chance).max() < 1e-4
    share = np.array([weight[int(y)] for y in label]) / sum(weight[int(y)] for y in label)
    slope = table.T @ (share * (chance - label)) + penalty * coefficient
    assert np.abs(slope).max() < 2e-3 and abs((share * (chance - label)).sum()) < 2e-3


def test_samples_are_bounded(spark):
    """An id with very many rows sends a bounded number of rows and bytes to one task."""
    from palimpsest.llm import sample

    docs = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 6000).cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(k, "other " * 50) for k in range(2, 40)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(1, 40)], "doc_id long, toxic int")
    known = sample.labelled(labels, "doc_id", "toxic")
    rows = sample.sampled_texts(docs, known, "doc_id", "text", 100, 5000).collect()
    for k in (0, 1):
        own = [r for r in rows if r["label"] == k]
        assert 0 < len(own) <= 100 and sum(len(r["text"]) for r in own) <= 5000
    stats = quality_rules.with_statistics(docs.select(F.col("doc_id").alias("id"), F.col("text")))
    assert quality_rules.fit(stats.drop("text"), sample.smallest(known, 100), sample=50) is not None


def test_logistic_separates(monkeypatch):
    table = linear.Sparse(np.array([1, 1, 0, 1, 1]), np.array([0, 0, 1, 1]), 2)
    w, b = linear.logistic(table, np.array([1.0, 1.0, 0.5, 0.0, 0.0]), np.ones(5), 1e-6)
    assert w[0] > 1 and w[1] < -1 and abs(b) < 1
    rng = np.random.default_rng(1)
    dense = rng.random((30, 7)) * (rng.random((30, 7)) < 0.3)
    row, column = np.nonzero(dense)
    for step in (5, 1 << 21):
        monkeypatch.setattr(linear, "STEP", step)
        some = linear.Sparse(np.bincount(row, minlength=30), column, 7, dense[row, column], np.arange(7.0))
        x, e = rng.random(7), rng.random(30)
        assert np.allclose(some.forward(x), dense @ (np.arange(7.0) * x)) and np.allclose(some.back(e), np.arange(7.0) * (dense.T @ e))


# 5 --------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7x?q#f", "https://example.net/de/81", "http://x.net/de/8", "ftp://example.net?x/de/8", "nothing", None, "http://notcom/en/", "a://b://c/d", "https://org/es/#", "http://example.com/en/8"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judged(frame, keep=("page_id",)).collect()}
    assert found == {
        0: ("a.example.com", "/en/7x", "example.com/en/7"), 1: ("example.net", "/de/81", "example.net/de/8"), 2: ("x.net", "/de/8", "net/de/"), 3: ("example.net", "", None), 4: ("", "", None),
        5: ("", "", None), 6: ("notcom", "/en/", None), 7: ("b:", "//c/d", None), 8: ("org", "/es/", "org/es/"), 9: ("example.com", "/en/8", "com/en/"),
    }


def test_url_models(spark):
    """Smoothed probabilities as a plain recursion finds them, and a sensible verdict on unseen hosts."""
    good, bad = ["www.garden.org/Plants7", "www.garden.org/trees"] * 3, ["cheap-pills.biz/buy", "cheap-pills.biz/é9"] * 3
    k_ = url_filter.ORDER
    grams = [(g, k) for k, texts in ((0, good), (1, bad)) for t in texts for s in [f"{url_filter.START * (k_ - 1)}{t}{url_filter.END}"] for g in [s[i : i + k_] for i in range(len(s) - k_ + 1)]]
    keys = sorted({g for g, _ in grams})
    table = spark.createDataFrame([(g, grams.count((g, 0)), grams.count((g, 1))) for g in keys], "gram string, allowed long, blocked long")
    found = {r["gram"]: r["ratio"] for r in url_filter.ratios(table).collect()}

    def chance(gram, k):
        own = [g[k_ - len(gram) :] for g, c in grams if c == k]
        n, all_, kinds = own.count(gram), sum(g[:-1] == gram[:-1] for g in own), len({g for g in own if g[:-1] == gram[:-1]})
        if len(gram) == 1:
            return (n + 1) / (len(own) + len({g[-1] for g in keys}))
        lower = chance(gram[1:], k)
        return lower if not all_ else (n + kinds * lower) / (all_ + kinds)

    for g in keys:
        assert found[g] == pytest.approx(np.log(chance(g, 0)) - np.log(chance(g, 1)))


def test_url_verdicts(spark, monkeypatch):
    rows = [(i, f"http://{h}/{p}{i}") for i in range(80) for h, p in (("green.net", "de/"), ("spam.com", "en/"))] + [(500, "http://green.org/fr/1"), (501, "http://spam.org/fr/2"), (502, None), (503, "http://spam.com/" + "en/" * 20_000), (503, "http://spam.com/" + "en/" * 20_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit("mine").alias(c) for c in ("host", "path", "found", "row", "gram", "at", "kept", "spelt", "URL", "a.b")])
    judged = url_filter.judged(frame, keep=("page_id", "host", "a.b"))
    rows = judged.collect()
    out = {r["page_id"]: r for r in rows}
    assert judged.columns == ["page_id", "a.b", "host", "path", "rule", "verdict", "score"] and len(rows) == 165
    assert out[500]["verdict"] == "allow" and out[501]["verdict"] == "block" and out[502]["verdict"] in ("allow", "block") and out[503]["rule"] == "com/en/" and out[500]["a.b"] == "mine"
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", 10)
    assert sorted(map(str, url_filter.judged(frame, keep=("page_id", "host", "a.b")).collect())) == sorted(map(str, rows))
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string"), keep=("page_id",)).count() == 0


# 6 --------------------------------------------------------------------------------------


def brute_print(text, width=4):
    w = (text if isinstance(text, bytes) else (text or "").encode()).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_masks_cover_every_pair():
    rng = random.Random(2)
    masks = [m & (2**64 - 1) for m in simhash.masks(4)]
    assert len(masks) == 31
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(not m & differ for m in masks)


@pytest.mark.parametrize("block", [3, 2048])
def test_simhash_links(spark, block, monkeypatch):
    """Random fingerprints with many near ones: components equal those of all pairs, with and without cut buckets."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = [c for c in centres]
    for c in centres:
        for _ in range(25):
            bits = rng.choice(64, rng.integers(1, 9), replace=False)
            prints.append(c ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)))
    prints = np.unique(np.array(prints, np.uint64))
    label = {int(p): int(p.view(np.int64)) for p in prints}
    changed = True
    while changed:
        changed = False
        for p in prints:
            near = prints[np.bitwise_count(prints ^ p) <= 4]
            low = min(label[int(x)] for x in near)
            if low < label[int(p)]:
                label[int(p)] = low
                changed = True
    frame = spark.createDataFrame([(int(p.view(np.int64)),) for p in prints], "fp long")
    found = {r["id"]: r["label"] for r in simhash.components(simhash.links(frame, block=block)).collect()}
    assert all(found.get(int(p.view(np.int64)), int(p.view(np.int64))) == label[int(p)] for p in prints)


def test_simhash_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(1) for c in ("id", "fingerprint", "component_id", "fp", "first")})
    docs = docs.select("*", F.lit(2).alias("a.b")).unionByName(awkward(spark).withColumn("doc_id", F.col("doc_id") + 1000).select("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    rows = [(r[0], bytes(r[1]) if r[1] is not None else b"") for r in docs.select("doc_id", F.col("text").cast("binary")).collect()]
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    want = sorted(((rows[k][0], f"{prints[k]:016x}", least[group[k]]) for k in range(len(rows))), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def variants(rng, n=400, most=30):
    """Text 0 and variants of it by changed words."""
    base = words(rng, 200, 10_000)
    rows = [(0, " ".join(base), "s")]
    for k in range(1, n):
        text = list(base)
        for at in rng.sample(range(200), rng.randrange(1, most)):
            text[at] = f"other{rng.randrange(10**6)}"
        rows.append((k, " ".join(text), "s"))
    return rows


def brute_groups(rows, least=0.8):
    """The smallest id of each component of texts whose five-word shingle sets have a Jaccard similarity of ``least`` or more."""
    number: dict[tuple, int] = {}
    cut = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t, *_ in rows)]
    sets = [frozenset(number.setdefault(x, len(number)) for x in own) for own in cut]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and least * len(x) <= len(sets[j]) <= len(x) / least and (1 + least) * len(x & sets[j]) >= least * (len(x) + len(sets[j])) - 1e-9:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return sorted(rows[g][0] for g in set(group))


@pytest.mark.parametrize("small", [False, True])
def test_keep_one_against_brute_force(spark, small, monkeypatch):
    """Every pair at 0.8 or more links and no other, whatever the fingerprints; ``small``: with buckets and clusters cut into many units."""
    if small:
        monkeypatch.setattr(simhash, "UNIT_TEXTS", 40)
        monkeypatch.setattr(simhash, "BROADCAST_TEXTS", 10)
        monkeypatch.setattr(simhash.links, "__defaults__", (4, 16))
        monkeypatch.setattr(simhash.bridges, "__defaults__", (16,))
    rng = random.Random(12)
    rows = variants(rng, 250) + [(1000 * k + i, t, "s") for k in range(1, 16) for i, t, _ in variants(rng, 12, 14)]
    rows += [(20_000 + k, " ".join(words(rng, rng.randrange(1, 12), 3)), "s") for k in range(80)] + [(30_000, "", "s"), (30_001, None, "s")]
    shared = words(rng, 60, 10_000)
    rows += [(40_000 + k, " ".join(words(rng, 120, 10_000) + shared), "s") for k in range(60)]
    kept = [r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect()]
    assert sorted(kept) == brute_groups(rows) and 100 < len(kept) < len(rows) - 50


def test_keep_one_recall_by_band(spark):
    """Of the pairs of real tables, none of 0.8 or more stays whole, in any band."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    assert kept == brute_groups(rows)


def test_shared_counts():
    """Values that few and that many sets hold."""
    rng = np.random.default_rng(3)
    sets = [np.unique(np.r_[rng.integers(0, 40, 30), rng.integers(0, 3000, 60)]).astype(np.uint64) for _ in range(70)] + [np.zeros(0, np.uint64)]
    found = simhash.shared_counts(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for j in range(71) for i in range(j))


def test_keep_one(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    assert same_columns(docs, kept)
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=str) == [1, 2, 5, 6, 8]
    assert simhash.keep_one(docs.limit(0)).count() == 0


# 7 --------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60))), s) for i in range(900) for s in [rng.choices(["a", "b", "c", "", None], [60, 25, 5, 5, 5])[0]]]
    frame = documents(spark, rows + [(5, "same text", "b"), (5, "same text", "b"), (None, None, "c"), (None, "", None)])
    found = mixing.mix(frame).collect()
    assert len(found) == 904 and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    by = {}
    for r in found:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    total = sum(s for s, _ in by)
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    assert all(abs(sum(taken) - target) <= 2 and target <= 2 * size for (size, target), taken in by.items())
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mix(documents(spark, [(1, None, None)])).first()["taken"] == 0


def test_mixed_documents(spark):
    docs = awkward(spark)
    rows = mixing.mixed_documents(docs)
    assert rows.columns == [*docs.columns, "taken_words"] and rows.where("taken_words <= 0").count() == 0
    assert same_columns(docs, rows.drop("taken_words"))
    again = mixing.mixed_documents(rows)
    assert again.columns == rows.columns and mixing.mixed_documents(docs.limit(0)).count() == 0
    assert rows.agg(F.sum("taken_words")).first()[0] == pytest.approx(mixing.mix(docs).agg(F.sum("taken")).first()[0])


# 8 --------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_quality_counts(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(["a b", "é ", "\n", " x y", "#*", "\u00a0", "\t", "1"]) for _ in range(rng.randrange(80))), "s") for i in range(150)] + [(200, None, None), (201, "", "s"), (202, "q r s q r s q", "s")]
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality_rules.with_statistics(documents(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: brute_counts(t) for i, t, _ in rows}


def test_quality_rules_learned(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    held = quality_rules.report(docs, even).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in held]) > 0.95
    from palimpsest.llm import sample

    stats = quality_rules.with_statistics(docs).drop("text")
    assert all(str(c) for rule in quality_rules.fit(stats.withColumnRenamed('doc_id', 'id'), sample.smallest(sample.labelled(even, 'doc_id', 'quality'), 1000)) for c in rule)
    kept = quality_rules.kept(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 1000


def brute_learn(rows, bad, precision=0.95, least=3, longest=4):
    """Sequential covering by trying every threshold in turn, in plain Python; what ``learn`` promises."""
    gain_of = lambda p, n, p0, n0: p * (np.log2((p + 1e-9) / (p + n)) - np.log2(p0 / (p0 + n0))) if p + n else -1.0
    holds = lambda c, r: r[c[0]] >= c[2] if c[1] else r[c[0]] < c[2]
    covered = lambda rule, r: all(holds(c, r) for c in rule)
    left, seeds, rules = set(range(len(rows))), {i for i in range(len(rows)) if bad[i]}, []
    for _ in range(200):
        grow = [i for i in sorted(left) if i % 4 < 2 and (i in seeds or not bad[i])]
        if not any(bad[i] for i in grow) or all(bad[i] for i in grow):
            return rules
        rule, inside = [], grow
        while len(rule) < longest and any(not bad[i] for i in inside):
            p0 = sum(bad[i] for i in inside)
            best = (1e-9, None)
            for name in quality_rules.RATIOS:
                values = sorted({rows[i][name] for i in inside})
                for above in (False, True):
                    for low, high in zip(values, values[1:]):
                        hit = [i for i in inside if (rows[i][name] >= high if above else rows[i][name] <= low)]
                        p = sum(bad[i] for i in hit)
                        gain = gain_of(p, len(hit) - p, p0, len(inside) - p0)
                        if gain > best[0]:
                            best = (gain, (name, above, float(f"{(low + high) / 2:.6g}")))
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [i for i in inside if holds(best[1], rows[i])]
        worth = []
        for k in range(1, len(rule) + 1):
            hit = [bad[i] for i in left if i % 4 == 2 and covered(rule[:k], rows[i])]
            worth.append(((2 * sum(hit) - len(hit)) / max(1, len(hit)), -k))
        if not worth:
            return rules
        rule = rule[: -max(worth)[1]]
        hit = [i for i in left if covered(rule, rows[i])]
        judge = [i for i in hit if i % 4 == 3]
        sure = lambda x: sum(bad[i] for i in x) >= precision * len(x)
        if sure(hit) and sure(judge) and sum(bad[i] for i in judge) >= least:
            rules.append(tuple(rule))
            left -= set(hit)
        else:
            seeds -= set(hit)
    return rules


@pytest.mark.parametrize("seed", range(4))
def test_quality_list_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = 160
    counts = {c: rng.integers(1, 12, n) for c in quality_rules.COUNTS}
    bad = ((counts["n_symbols"] / counts["n_words"] > 2) & (rng.random(n) < 0.97)) | ((counts["n_upper"] > 9) & (counts["n_marks"] < 4)) | (rng.random(n) < 0.03)
    table = quality_rules.ratios(counts)
    rows = [{k: float(v[i]) for k, v in table.items()} for i in range(n)]
    found = [tuple((c.ratio, c.above, c.threshold) for c in rule) for rule in quality_rules.learn(counts, bad)]
    assert found == brute_learn(rows, bad.tolist())


def test_quality_awkward(spark):
    docs, none = awkward(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality_rules.report(docs, none).collect()
    assert len(found) == 12 and all(r["kept"] == (not r["base_failed"]) for r in found)
    kept = quality_rules.kept(docs, none)
    assert same_columns(docs, kept) and [r[0] for r in kept.select("doc_id").collect()] == [5]
    assert quality_rules.report(docs.limit(0), none).count() == 0 and quality_rules.kept(docs.limit(0), none).count() == 0
    clash = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_words int, `a.b` string")
    assert quality_rules.with_statistics(clash).select("n_words", "`a.b`").first()[:] == (2, "x")


# 9 --------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"http://h/{i} x\r\nWARC-Type: evil", rng.choice(["same", "<p>é</p>\r\n\r\nWARC/1.1\r\n", f"page {i}", "", None, "y" * 300_000])) for i in range(80)] + [(None, None, "lonely"), (None, "u", "same"), (79, "again", "page 79")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.round_trip(frame, f"{tmp_path}/a").collect()
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = best[html or ""]
        revisit = first >= 0 and i != first
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    back = warc.read(spark, f"{tmp_path}/a/warc").where("type = 'response'").collect()
    assert {bytes(r["payload"]).decode() for r in back} == {h or "" for _, _, h in rows}
    assert warc.round_trip(frame.limit(0), f"{tmp_path}/b").count() == 0


def test_warc_awkward(spark, tmp_path, monkeypatch):
    """String ids come back as they were, long payloads in small batches, clashing names."""
    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    ids = [" a", "a\r\nX: y", "", "-", "%20", "é b", "c: d"]
    rows = [(k, "u", "p" * 1_500_000 if i == 0 else f"payload {i}") for i, k in enumerate(ids)] + [(" a", "u", "payload 3")]
    frame = spark.createDataFrame(rows, "page_id string, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("page", "payload", "digest", "kind", "HTML", "a.b")])
    found = {(r["page_id"], r["payload_bytes"]): r for r in warc.round_trip(frame, f"{tmp_path}/a").collect()}
    assert {k for k, _ in found} == set(ids) and (" a", 1_500_000) in found and len(found) == 8
    revisit = [r for r in found.values() if r["record_type"] == "revisit"]
    assert [(r["page_id"], r["refers_to"]) for r in revisit] == [(" a", "-")]
    back = warc.read(spark, f"{tmp_path}/a/warc").where("type = 'response'")
    assert sorted(len(r["payload"]) for r in back.collect())[-1] == 1_500_000 and "payload" not in warc.read(spark, f"{tmp_path}/a/warc", payloads=False).columns
    assert not list(tmp_path.rglob("*.draft"))


def test_warc_normaliser(spark, tmp_path):
    """One stream, many members and a cut file."""
    import io

    records = [warc.record(str(k), "u", b"z" * k * 1000, "response", None) for k in range(1, 6)]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    one = whole.compress(b"".join(records)) + whole.flush()
    members = b"".join(c.compress(r) + c.flush() for r in records for c in [zlib.compressobj(1, zlib.DEFLATED, 31)])
    for data in (one, members):
        assert [r for _, r in warc.records(warc.Inflated(io.BytesIO(data), 100))] == records
    with pytest.raises(EOFError):
        list(warc.records(warc.Inflated(io.BytesIO(one[:-20]), 100)))
    (tmp_path / "mono.warc.gz").write_bytes(one)
    warc.normalise(spark.createDataFrame([(f"{tmp_path}/mono.warc.gz",)], "path string"), f"{tmp_path}/out")
    found = warc.read(spark, f"{tmp_path}/out").collect()
    assert sorted(len(r["payload"]) for r in found) == [k * 1000 for k in range(1, 6)]


# 10 -------------------------------------------------------------------------------------


def test_weak_labels_estimate():
    """EM finds planted accuracies from votes alone."""
    rng = np.random.default_rng(9)
    good = rng.random(20_000) < 0.7
    sure, wins = [0.9, 0.8, 0.95, 0.7], []
    for a in sure:
        right, speaks = rng.random(len(good)) < a, rng.random(len(good)) < 0.6
        wins.append(np.where(speaks, np.where(right == good, 1, -1), 0))
    patterns, count = np.unique(np.column_stack(wins), axis=0, return_counts=True)
    trust = weak_quality.estimate(patterns.astype(float), count.astype(float))
    assert np.abs(trust.accuracy() - sure).max() < 0.05 and abs(trust.good - 0.7) < 0.06


def test_weak_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = weak_quality.report(docs)
    held = found.join(labels, "doc_id").collect()
    assert found.count() == 1000 and np.mean([r["kept"] == (r["quality"] == 1) for r in held]) > 0.9


def test_weak_labels_by_enumeration():
    """EM on three labellers as a plain loop over single texts finds it."""
    rng = np.random.default_rng(2)
    votes = rng.choice([-1, 0, 1], (300, 3), p=[0.3, 0.2, 0.5])
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    trust = weak_quality.estimate(patterns.astype(float), count.astype(float), 25)
    q = {tuple(v): 0.1 if (v < 0).any() else 0.9 for v in patterns}
    for _ in range(25):
        rate = {}
        for j in range(3):
            for cls in (0, 1):
                of = lambda v: q[v] if cls else 1 - q[v]  # noqa: B023, E731
                total = sum(of(tuple(v)) for v in votes)
                for vote in (-1, 0, 1):
                    rate[j, vote, cls] = (sum(of(tuple(v)) for v in votes if v[j] == vote) + 0.5) / (total + 1.5)
        good = sum(q[tuple(v)] for v in votes) / len(votes)
        new = {}
        for v in q:
            odds = np.log(good / (1 - good)) + sum(np.log(rate[j, x, 1] / rate[j, x, 0]) for j, x in enumerate(v) if x)
            new[v] = 1 / (1 + np.exp(-odds))
        done = max(abs(new[v] - q[v]) for v in q) < 1e-6
        q = new if not done else q
        if done:
            break
    assert np.abs(trust.posterior(patterns) - [new[tuple(v)] for v in patterns]).max() < 1e-6


def test_weak_labels_estimated_against_true(spark):
    """On labelled documents the estimated accuracies are near the true ones."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    marked = quality_rules.with_statistics(docs.select("doc_id", "text")).withColumn("votes", weak_quality.votes()).select("doc_id", "votes").cache()
    trust = weak_quality.learn_trust(marked)
    rows = marked.join(labels, "doc_id").collect()
    for k, (name, *_) in enumerate(weak_quality.LABELLERS):
        said = [(r["votes"][k] == "+") == (r["quality"] == 1) for r in rows if r["votes"][k] != "0"]
        print(name, len(said), np.mean(said), trust.accuracy()[k])
        assert len(said) < 50 or abs(np.mean(said) - trust.accuracy()[k]) < 0.15
    assert len({x[1] for x in weak_quality.LABELLERS}) == len(weak_quality.LABELLERS)


def test_weak_quality_awkward(spark):
    docs = awkward(spark)
    found = weak_quality.report(docs).collect()
    assert len(found) == 12 and all(0 <= r["score"] <= 1 and len(r["votes"]) == len(weak_quality.LABELLERS) for r in found)
    assert all(r["votes"] == "00000" for r in found if r["doc_id"] in (2, 3, 4, 6, 8, 9))
    assert weak_quality.report(docs.limit(0)).count() == 0


# pipeline -------------------------------------------------------------------------------


def test_pipeline(spark):
    """Each stage keeps columns and judges its own input as its operator does; the whole is what the stages make."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        before, after = {r["doc_id"] for r in docs.collect()}, [r["doc_id"] for r in out.collect()]
        assert set(after) <= before and len(after) == len(set(after))
        if name != "mixing":
            assert out.columns == columns
        if name == "near-duplicates":
            assert sorted(after) == brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert all(h == 0 for _, _, h, _ in brute_hits([(r["doc_id"], r["text"]) for r in out.collect()], items))
            assert all(h > 0 for _, _, h, _ in brute_hits([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in set(after)], items))
        docs = out
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, docs.collect()))


def test_stages_on_awkward_input(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns + ["taken_words"] * (name == "mixing") and (out.count() == 0 or same_columns(docs, out.drop("taken_words")))
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_registered():
    found = entry.queries()
    assert [len([n for n in found if n.startswith(f"op{k}_")]) for k in range(1, 11)] == [1] * 10 and "pipeline" in found
