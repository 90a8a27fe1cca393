"""Quality rules: a decision list learned by sequential covering.

``statistics`` counts things in each text.  ``learn`` grows conjunctions of
thresholds on ratios of those counts, one after another, from texts labelled good
or bad: a rule gains conditions while they raise FOIL's information gain on half
of the rows, loses the last ones again where a quarter says so, and is kept if it is
precise on the last quarter, which neither saw; what it covers is set aside for the
next rule.  If it isn't precise, the bad rows that it covers seed no rule any more.  The
list is a handful of readable lines and is applied as one Spark ``CASE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.sample import labelled, smallest
from palimpsest.llm.shared import by_place, cut, decoded, picked, place, restored, texts

#: Labelled rows of each kind that rules are learned from, at most: those with the smallest hashed ids.
SAMPLE = 25_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_bytes")

#: What rules look at: ratios, so that a rule means the same for long and short texts.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more in the text."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= again
    return int(inside.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of a text; bytes that aren't UTF-8 count as U+FFFD."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = lambda drop: len(text) - len(text.translate(None, drop))
    upper, lower = without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"abcdefghijklmnopqrstuvwxyz")
    return (
        len(words), len(decoded(b"".join(words))), without(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words), len(set(words)),
        len(lines), upper, upper + lower, without(b"0123456789"), without(b"!?"), len(text),
    )


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS`` of each whole text as long columns, which replace columns of these names.  Null counts as empty."""
    rows, text = by_place(docs), place(docs, text_col)
    kept = [(f"c{k}", name) for k, name in enumerate(docs.columns) if name not in COUNTS]
    at = rows.columns.index(text)
    schema = rows.select("*", *[F.lit(0).cast("long").alias(n) for n in COUNTS]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([counts(t) for t in texts(batch.column(at))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, table.T.copy())], [*batch.schema.names, *COUNTS])

    return rows.mapInArrow(run, schema).select(*[c for c, _ in kept], *COUNTS).toDF(*[name for _, name in kept], *COUNTS)


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.ratio} {'>=' if self.above else '<'} {self.threshold:g}"

    def rows(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.ratio]
        return x >= self.threshold if self.above else x < self.threshold

    def column(self) -> Column:
        top, bottom = (F.col(c).cast("double") for c in RATIOS[self.ratio])
        x = top / F.greatest(bottom, F.lit(1.0))
        return x >= self.threshold if self.above else x < self.threshold


Rule = tuple[Condition, ...]


def ratios(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {name: table[a].astype(float) / np.maximum(table[b], 1) for name, (a, b) in RATIOS.items()}


def covers(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    return np.logical_and.reduce([np.ones(n, bool), *[c.rows(table) for c in rule]])


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and inside.sum() > (inside & bad).sum():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best: tuple[float, Condition | None] = (1e-9, None)
        for name, x in table.items():
            values, label = x[inside], bad[inside]
            order = np.argsort(values, kind="stable")
            values, label = values[order], label[order]
            edge = np.flatnonzero(values[1:] > values[:-1]) + 1
            if not len(edge):
                continue
            middle = (values[edge] + values[edge - 1]) / 2
            below = np.cumsum(label)[edge - 1]
            for above in (False, True):
                p = p0 - below if above else below
                n = (len(label) - edge if above else edge) - p
                gain = p * (np.log2((p + 1e-9) / (p + n)) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(name, above, float(f"{middle[k]:.6g}")))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].rows(table)
    return tuple(rule)


def learn(table: dict[str, np.ndarray], bad: np.ndarray, longest: int = 4, precision: float = 0.95, least: int = 3, tries: int = 200) -> list[Rule]:
    """Rules that reject, in order, from arrays of ``COUNTS`` and what is bad.  No bad row or no good row: no rule.

    Of four rows two are for growing, one for pruning and one for judging.  A rule is kept
    if at least ``precision`` of what it covers, and ``least`` rows, are bad in the judging
    quarter, and ``precision`` in all rows together.  ``tries``: rules that are grown, at most.
    """
    table, rules = ratios(table), []
    part = np.arange(len(bad)) % 4
    left, seeds = np.ones(len(bad), bool), bad.copy()
    for _ in range(tries):
        grow, prune, judge = left & (part < 2) & (seeds | ~bad), left & (part == 2), left & (part == 3)
        if not (grow & bad).any() or not (grow & ~bad).any():
            break
        pick = lambda mask: {k: v[mask] for k, v in table.items()}
        rule = _grow(pick(grow), bad[grow], longest)
        worth = []
        for k in range(1, len(rule) + 1):
            hit = covers(rule[:k], pick(prune), int(prune.sum()))
            p, n = (hit & bad[prune]).sum(), (hit & ~bad[prune]).sum()
            worth.append(((p - n) / max(1, p + n), -k))
        if not worth:
            break
        rule = rule[: -max(worth)[1]]
        hit = covers(rule, table, len(bad)) & left
        sure = lambda h: (h & bad).sum() >= precision * h.sum()
        if sure(hit) and sure(hit & judge) and (hit & judge & bad).sum() >= least:
            rules.append(rule)
            left &= ~hit
        else:
            seeds &= ~hit
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule rejects: one ``CASE`` with the rules in order."""
    decided = F.when(base_failed(), False)
    for rule in rules:
        fits = F.lit(True)
        for condition in rule:
            fits = fits & condition.column()
        decided = decided.when(fits, False)
    return decided.otherwise(True)


def fit(stats: DataFrame, known: DataFrame, sample: int = SAMPLE, **options) -> list[Rule]:
    """Rules from ``stats`` (id and ``COUNTS``) and ``known`` (id and label, see ``smallest``).

    Rows that agree in id and counts count once, and of each label ``sample`` rows are taken
    at most, by hashed id, however many rows an id has; they are a few numbers each and are
    collected.  Texts that fail the base rules are left out: the list never decides on them.
    """
    order = [F.xxhash64("id"), "id", *COUNTS]
    joined = stats.select("id", *COUNTS).where(~base_failed()).join(F.broadcast(known), "id").distinct()
    part = [joined.where(F.col("label") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    rows = part[0].unionAll(part[1]).select(F.xxhash64("id").alias("order"), "id", "label", *COUNTS).toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("order", "id", "label", *COUNTS)])
    table = {c: rows.column(c).to_numpy() for c in COUNTS}
    return learn(table, rows.column("label").to_numpy() == 0, **options)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """One row for each row of ``docs``: id, ``COUNTS``, base_failed and kept.

    Null and empty texts have no words and fail the base rules; repeated rows are returned
    as often as they come; without labels of both kinds only the base rules decide.  Other
    columns don't matter; of columns with equal names the first is meant.
    """
    stats = cut(with_statistics(picked(docs, id=id_col, text=text_col)).drop("text"))
    rules = fit(stats, cut(smallest(labelled(labels, id_col, label_col), SAMPLE)), **options)
    return stats.select(F.col("id").alias(id_col), *COUNTS, base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the learned list rejects, with the columns of ``docs``, whatever their names."""
    known = cut(smallest(labelled(labels, id_col, label_col), SAMPLE))
    some = picked(docs, id=id_col, text=text_col).join(F.broadcast(known.select("id").distinct()), "id", "left_semi")
    rules = fit(with_statistics(some).drop("text"), known, **options)
    return restored(with_statistics(by_place(docs), place(docs, text_col)).where(verdict(rules)), docs)
