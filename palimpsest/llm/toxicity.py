"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

After Wang and Manning (2012): a feature is whether an n-gram of characters occurs
in the text, times the log ratio of its smoothed document counts in the toxic and
the other class; logistic regression weighs the scaled features.  N-grams run over
lower-cased text with runs of white space as one space, and over its ends.  They are
hashed to ``BUCKETS`` numbers.

The classifier is fitted on a bounded sample of the labelled rows: of each class at
most ``SAMPLE`` texts and ``SAMPLE_BYTES`` bytes of them, by hashed id, weighted back
to the classes' shares of all labels.  Every n-gram of the sample is a feature, and
every bucket has a place in the model, a vector of ``BUCKETS`` numbers.  Whole texts
are read, for fitting and for scoring.  Scoring is one pass over the documents without
a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.linear import Sparse, logistic, sigmoid
from palimpsest.llm.sample import labelled, sampled_texts
from palimpsest.llm.shared import by_place, decoded, picked, place, restored, sent, texts

ORDERS = (3, 4, 5, 6)
BITS = 20
BUCKETS = 1 << BITS
#: Labelled texts of each class that the classifier is fitted on, at most, and bytes of them.
SAMPLE, SAMPLE_BYTES = 2048, 4 << 20
#: Weight of the squared coefficients.
PENALTY = 1e-5
#: Gradient steps of a fit.
STEPS = 60


def points_of(text: bytes) -> np.ndarray:
    """Lower-cased code points, runs of white space as one space, and one at either end."""
    plain = f" {' '.join(decoded(text).lower().split())} "
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def grams(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of a text, order by order."""
    points = points_of(text)
    total = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(points) - n + 1
        if size <= 0:
            return
        total = (total[:size] + points[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(31)
        if n in ORDERS:
            yield ((total * np.uint64(0xC2B2AE3D27D4EB4F + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int32)


class Present:
    """The buckets that occur in a text, each once; holds a scratch vector, so make one for each task."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: bytes) -> np.ndarray:
        found = list(grams(text))
        bucket = np.concatenate(found) if found else np.zeros(0, np.int32)
        place = np.arange(len(bucket), dtype=np.int32)
        self.last[bucket] = place
        return bucket[self.last[bucket] == place]


@dataclass
class Model:
    """``weight`` of each bucket, naive Bayes ratio times coefficient, and an intercept."""

    weight: np.ndarray
    intercept: float

    def scores(self, values: list[bytes], present: Present) -> np.ndarray:
        return sigmoid(np.array([self.weight[present(v)].sum(dtype=float) for v in values]) + self.intercept)


def ratios(features: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The log of the smoothed shares of toxic and of other texts that have each bucket; 0 for buckets of no text."""
    count = np.zeros((2, BUCKETS), np.int32)
    for found, k in zip(features, toxic):
        count[int(k), found] += 1  # a text has each bucket once
    share = [(count[k] + 1.0) / (int((toxic == bool(k)).sum()) + 2.0) for k in (0, 1)]
    return np.where(count.any(0), np.log(share[1] / share[0]), 0.0)


def trained(values: list[bytes], label: np.ndarray, weight: dict[int, float], penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """A model from labelled texts, of which both classes have one; ``weight`` of a text by its label."""
    present = Present()
    features = [present(v) for v in values]
    ratio = ratios(features, label == 1)
    length, column = np.array([len(f) for f in features]), np.concatenate(features)
    del features
    known = np.flatnonzero(np.bincount(column, minlength=BUCKETS))
    number = np.zeros(BUCKETS, np.int32)
    number[known] = np.arange(len(known))
    w, b = logistic(Sparse(length, number[column], len(known), scale=ratio[known]), label.astype(float), np.where(label == 1, weight[1], weight[0]), penalty, steps)
    total = np.zeros(BUCKETS, np.float32)
    total[known] = w * ratio[known]
    return Model(total, b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from ``labels`` (1 toxic, 0 not; null ids and labels don't count) of ``docs``; with one class only it scores all alike."""
    known = labelled(labels, id_col, label_col)
    size = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rows = sampled_texts(docs, known, id_col, text_col, sample, sample_bytes)
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 6.0 if n.get(1) else -6.0)
    weight = {k: size[k] / n[k] for k in (0, 1)}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, label = [], []
        for batch in batches:
            values += texts(batch.column(0))
            label += batch.column(1).to_pylist()
        if values:
            model = trained(values, np.array(label), weight)
            yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.intercept])], ["w", "b"])

    ordered = rows.orderBy(F.xxhash64("id"), "id", "hash", "label").select("text", "label")
    fitted = ordered.coalesce(1).mapInArrow(train, "w binary, b double").first()
    return Model(np.frombuffer(fitted["w"], np.float32), fitted["b"])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic of each whole text; all rows and other columns stay."""
    rows, known = by_place(docs), sent(docs.sparkSession, model)
    at = docs.columns.index(text_col)
    schema = rows.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, present = known(), Present()
        for batch in batches:
            scores = model.scores(texts(batch.column(at)), present)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return rows.mapInArrow(run, schema).toDF(*docs.columns, out)


def held_out(id_col: str) -> Column:
    """Whether a row is kept from fitting: the CRC-32 of its id is 2 modulo 4.  A null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, score, predicted.

    Null texts score as empty ones, which have the intercept and few n-grams.  Bytes that
    aren't UTF-8 read as U+FFFD.  Repeated rows score alike and are returned as often as they
    come.  Other columns don't matter; of columns with equal names the first is meant.
    """
    model = fit(docs, taught(labels, id_col), id_col, text_col)
    scored = with_score(picked(docs, id=id_col, text=text_col), model)
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def taught(labels: DataFrame, id_col: str) -> DataFrame:
    """The labels that may be learned from."""
    return restored(by_place(labels).where(~held_out(place(labels, id_col))), labels)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with the columns of ``docs``, whatever their names."""
    model = fit(docs, taught(labels, id_col), id_col, text_col)
    return restored(with_score(by_place(docs), model, place(docs, text_col)).where(F.col("score") < threshold), docs)
