"""Quality classifier from weak labels.

A handful of heuristics each call a text good or bad or say nothing.  They overlap,
so how often they agree tells how far each can be trusted: expectation-maximisation
over the counts of vote patterns estimates an accuracy for each labeller and the
share of good texts, with no true label: how often it votes either way on good and on
bad texts.  All documents are counted; there are
``3 ** len(LABELLERS)`` patterns at most, whatever the number of documents.

The posterior of a text's pattern is the target on which a linear scorer is trained,
on a bounded sample of texts (the smallest hashed ids).  It sees hashed character
trigrams and hashed levels of the text's statistics, so it also judges texts about
which every labeller is silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.linear import Sparse, logistic, sigmoid
from palimpsest.llm.quality_rules import COUNTS, RATIOS, ratios, with_statistics
from palimpsest.llm.shared import by_place, cut, picked, place, sent, texts

#: name, ratio, bad from this on, good below this (None: never calls good).  One labeller for each
#: statistic, so that no number is counted as evidence twice; the absence of shouted marks or of
#: copied lines says little, so those labellers only call bad.
LABELLERS = (
    ("symbols", "symbols_per_word", 0.25, 0.1),
    ("capitals", "upper_share", 0.5, 0.15),
    ("marks", "marks_per_word", 0.5, None),
    ("repetition", "repeat_share", 0.5, 0.2),
    ("copied_lines", "dup_lines_share", 0.5, None),
)
#: Texts that the scorer is trained on, at most.
SAMPLE = 5_000
BUCKETS = 1 << 16


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)).cast("double")


def votes() -> Column:
    """One character for each labeller: ``+`` good, ``-`` bad, ``0`` silent.  All are silent on texts of under 10 words."""
    said = []
    for _, name, bad, good in LABELLERS:
        vote = F.when(F.col("n_words") < 10, "0").when(ratio(name) >= bad, "-")
        vote = vote.when(ratio(name) < good, "+") if good is not None else vote
        said.append(vote.otherwise("0"))
    return F.concat(*said)


@dataclass(frozen=True)
class Trust:
    """What EM found: how often each labeller gives each vote (silent, good, bad) on good and on bad texts, and the share of good ones."""

    rates: np.ndarray
    good: float

    def weights(self) -> np.ndarray:
        """What each labeller's vote (silent, good, bad) adds to the log odds of being good; silence adds nothing."""
        added = np.log(self.rates[..., 1] / self.rates[..., 0])
        added[:, 0] = 0.0
        return added

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance of being good of each row of votes in {-1, 0, 1}."""
        added = self.weights()[np.arange(patterns.shape[1]), patterns.astype(int)]
        return sigmoid(added.sum(1) + np.log(self.good / (1 - self.good)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller's votes, the expected share that is right."""
        share = np.array([1 - self.good, self.good])
        right = self.rates[:, 1, 1] * share[1] + self.rates[:, -1, 0] * share[0]
        return right / np.maximum((self.rates[:, [1, -1], :] * share).sum((1, 2)), 1e-12)


def estimate(patterns: np.ndarray, count: np.ndarray, steps: int = 200) -> Trust:
    """EM over vote patterns and how many texts have them; it starts from texts that nobody calls bad being good."""
    q = np.where((patterns < 0).any(1), 0.1, 0.9)
    trust = None
    for _ in range(steps):
        share = np.column_stack([count * (1 - q), count * q])
        rates = np.stack([((patterns == v)[:, :, None] * share[:, None, :]).sum(0) + 0.5 for v in (0, 1, -1)], 1)
        trust = Trust(rates / (share.sum(0) + 1.5), float(np.clip(share[:, 1].sum() / max(count.sum(), 1e-9), 0.02, 0.98)))
        new = trust.posterior(patterns)
        if len(q) == 0 or np.abs(new - q).max() < 1e-6:
            break
        q = new
    return trust


def as_votes(patterns: list[str]) -> np.ndarray:
    return np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p] for p in patterns], float).reshape(-1, len(LABELLERS))


def learn_trust(marked: DataFrame) -> Trust:
    """From ``votes`` of all documents."""
    rows = marked.groupBy("votes").count().collect()
    return estimate(as_votes([r["votes"] for r in rows]), np.array([r["count"] for r in rows], float))


def posterior(trust: Trust) -> Column:
    """The posterior of a row's ``votes`` as an expression."""
    total = F.lit(float(np.log(trust.good / (1 - trust.good))))
    for k, (silent, good, bad) in enumerate(trust.weights().tolist()):
        vote = F.substring("votes", k + 1, 1)
        total = total + F.when(vote == "+", good).when(vote == "-", bad).otherwise(silent)
    return 1.0 / (1.0 + F.exp(-total))


def features(text: bytes, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value): character (byte) trigrams by relative frequency, and one for the level of each ratio; unit length each."""
    data = np.frombuffer(b" " + b" ".join(text.split()) + b" ", np.uint8).astype(np.uint64)
    level = ((np.arange(len(levels)) * 64 + np.minimum(np.floor(levels * 20), 63)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    if len(data) < 3:
        return level.astype(np.int64), np.full(len(level), 1 / np.sqrt(len(level)))
    gram = ((data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
    if len(gram) > 4096:
        count = np.bincount(gram.astype(np.int64), minlength=BUCKETS)
        bucket = np.flatnonzero(count)
        count = count[bucket]
    else:
        bucket, count = np.unique(gram.astype(np.int64), return_counts=True)
    share = np.sqrt(count / len(gram))
    return np.r_[bucket, level.astype(np.int64)], np.r_[share, np.full(len(level), 1 / np.sqrt(len(level)))]


def _levels(batch: pa.RecordBatch) -> np.ndarray:
    table = {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in COUNTS}
    return np.column_stack(list(ratios(table).values()))


def train(sample: DataFrame, penalty: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and intercept from ``sample`` (text, target, ``COUNTS``), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, bucket, value, target, n = [], [], [], [], 0
        for batch in batches:
            levels = _levels(batch)
            target.append(batch.column(1).to_numpy())
            for k, text in enumerate(texts(batch.column(0))):
                b, v = features(text, levels[k])
                length.append(len(b)), bucket.append(b.astype(np.int32)), value.append(v.astype(np.float32))
            n += batch.num_rows
        if n:
            w, b = logistic(Sparse(np.array(length), np.concatenate(bucket), BUCKETS, np.concatenate(value)), np.concatenate(target), np.ones(n), penalty, 100)
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()]), pa.array([b])], ["w", "b"])

    fitted = sample.select("text", "target", *COUNTS).repartition(1).mapInArrow(run, "w array<double>, b double").first()
    return (np.array(fitted["w"]), fitted["b"]) if fitted else (np.zeros(BUCKETS), 0.0)


def with_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The columns of ``by_place(docs)`` with votes, posterior and score (0 to 1) of each whole text; all rows stay.

    Null and empty texts and those of under 10 words have silent labellers, so their
    posterior is the share of good texts.  An empty table gives no rows.  Of columns with
    equal names the first is meant.
    """
    rows, text = by_place(docs), place(docs, text_col)
    slim = picked(docs, id=id_col, text=text_col)
    slim = cut(with_statistics(slim).select("id", F.xxhash64("text").alias("hash"), votes().alias("votes"), *COUNTS))
    trust = learn_trust(slim)
    some = slim.select(F.xxhash64("id").alias("o"), "id", "hash").distinct().orderBy("o", "id", "hash").limit(sample)
    texts_ = picked(docs, id=id_col, text=text_col).withColumn("hash", F.xxhash64("text"))
    chosen = texts_.join(F.broadcast(cut(some).select("id", "hash")), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    weights, intercept = train(with_statistics(chosen.select("text")).withColumn("votes", votes()).withColumn("target", posterior(trust)))

    known = sent(docs.sparkSession, (weights.astype(np.float32), intercept))
    counted = with_statistics(rows, text)
    at = rows.columns.index(text)
    schema = counted.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = known()
        for batch in batches:
            levels, scores = _levels(batch), []
            for k, text in enumerate(texts(batch.column(at))):
                bucket, value = features(text, levels[k])
                scores.append(float(weights[bucket] @ value) + intercept)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(np.array(scores)), pa.float64())], [*batch.schema.names, "score"])

    scored = counted.mapInArrow(run, schema).withColumn("votes", votes())
    return scored.select(*rows.columns, "votes", posterior(trust).alias("posterior"), "score")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """(id, votes, posterior, score, kept): one row for each row of ``docs``; kept is a score of ``threshold`` or more.

    Nulls, short texts and repeats are as in ``with_quality``; other columns don't matter.
    """
    scored = with_quality(picked(docs, id=id_col, text=text_col), "id", "text", **options)
    return scored.select(F.col("c0").alias(id_col), "votes", "posterior", "score", (F.col("score") >= threshold).alias("kept"))
