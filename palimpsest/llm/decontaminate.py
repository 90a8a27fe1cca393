"""Benchmark decontamination by a prefix-filtered set join.

An item's words are cut into windows of ``window`` consecutive words; an item of
fewer is one window.  A window is contained in a document where the document has
the same words in the same order.  A window's set is its shingles of ``SHINGLE``
words.  For full containment the prefix that two sets must share is one element,
so each window is indexed under its rarest shingle alone, rarity being how often
shingles of its hashed bucket occur in all documents (ties: in fewer windows, then
the earlier one).  A document shingle that equals an indexed one gives a candidate
place; it survives if it leaves room for the whole window before the text's start
and end (positional and length bounds) and if every word of it agrees.

The documents are never shuffled: the index is sent to where they are.  It holds
at most about ``BLOCK_BYTES`` of window text; a larger benchmark is cut into
blocks by a hash of the window.  The documents are passed over once to count shingles
and once for each block; of blocks after the first only what was found in a text is
kept, under a digest of the text, and joined to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import BUCKETS, WORD_BYTES, bucket, by_place, chunks, cut, hashed_counts, picked, place, restored, sent, texts

SHINGLE = 3
#: Window text of one index, which is collected and sent to every executor.
BLOCK_BYTES = 32 << 20

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Index:
    """Windows of one block: their words as numbers, and the places of shingles in them."""

    def __init__(self, windows: list[bytes]):
        split = [w.split(b" ") for w in windows]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in split for w in x}), 1)}
        self.sizes = np.array([len(x) for x in split], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]].astype(np.int64)
        self.words = np.array([self.vocabulary[w] for x in split for w in x], np.int64)
        hashes = np.array([0, *map(xxhash.xxh64_intdigest, self.vocabulary)], np.uint64)[self.words]
        owner, offset, length, key, common = [], [], [], [], []
        for n in range(1, SHINGLE + 1):
            which = np.flatnonzero(np.minimum(self.sizes, SHINGLE) == n)
            if len(which):
                count = self.sizes[which] - n + 1
                own = np.repeat(which, count)
                at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                owner.append(own), offset.append(at), length.append(np.full(len(own), n))
                key.append(self.keys(self.words, n)[self.starts[own] + at])
                common.append(bucket(self.keys(hashes, n)[self.starts[own] + at]))
        self.owner, self.offset, self.length, key_of, self.common = (np.concatenate(x) for x in (owner, offset, length, key, common))
        self.keys_of_all, self.slot = np.unique(key_of, return_inverse=True)
        self.lengths = np.unique(self.length)

    @staticmethod
    def keys(words: np.ndarray, n: int) -> np.ndarray:
        """A key for the ``n`` words that start at each place (equal words give equal keys); shorter by n - 1."""
        size = len(words) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64)
        total = np.full(size, n, np.uint64)
        for i in range(n):
            total = (total ^ (words[i : i + size].astype(np.uint64) * _FACTORS[i])) * _FACTORS[(i + 1) % 3]
            total ^= total >> np.uint64(29)
        return total

    def found(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, number of the shingle's key) for each known shingle in ``words``, by shingle length."""
        for n in self.lengths:
            keys = self.keys(words, int(n))
            places = np.flatnonzero(words[: len(keys)])
            slots = np.searchsorted(self.keys_of_all, keys[places])
            slots[slots == len(self.keys_of_all)] = 0
            hit = self.keys_of_all[slots] == keys[places]
            yield places[hit], slots[hit]

    def choose_prefixes(self, occurrences: np.ndarray) -> None:
        """Keep for each window its rarest shingle, given how often each bucket occurs in the documents."""
        spread = np.bincount(self.slot, minlength=len(self.keys_of_all))
        order = np.lexsort((self.offset, spread[self.slot], occurrences[self.common], self.owner))
        first = order[np.unique(self.owner[order], return_index=True)[1]]
        first = first[np.argsort(self.slot[first], kind="stable")]
        self.posting_window, self.posting_offset = self.owner[first], self.offset[first]
        count = np.bincount(self.slot[first], minlength=len(self.keys_of_all))
        self.posting_end = np.cumsum(count)
        self.posting_start = self.posting_end - count
        del self.owner, self.offset, self.length, self.slot, self.common

    def occurrences(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of each window that ``words`` contains, by window size."""
        for places, slots in self.found(words):
            count = self.posting_end[slots] - self.posting_start[slots]
            which = np.repeat(self.posting_start[slots], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            window = self.posting_window[which]
            start = np.repeat(places, count) - self.posting_offset[which]
            room = (start >= 0) & (start + self.sizes[window] <= len(words))
            window, start = window[room], start[room]
            for size in np.unique(self.sizes[window]):
                own = self.sizes[window] == size
                w, s = window[own], start[own]
                same = np.ones(len(w), bool)
                for i in range(size):
                    same &= words[s + i] == self.words[self.starts[w] + i]
                yield w[same], s[same]


def numbered(vocabulary: dict[bytes, int], values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers (0: not in the vocabulary), a 0 after each text; and where each text starts."""
    split = [v.translate(WORD_BYTES).split() for v in values]
    ends = np.cumsum([len(x) + 1 for x in split])
    words = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    for start, x in zip(starts, split):
        words[start : start + len(x)] = np.fromiter(map(vocabulary.get, x, repeat(0)), np.int64, len(x))
    return words, np.r_[starts, words.size].astype(np.int64)


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, window): the distinct windows of each item, their words joined by spaces."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, cut_ = [], []
            for k, text in enumerate(texts(batch.column(1))):
                words = text.translate(WORD_BYTES).split()
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    item.append(k), cut_.append(b" ".join(words[i : i + window]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item, pa.int64())), pa.array(cut_, pa.binary())], ["item", "window"])

    return picked(items, item=id_col, text=text_col).mapInArrow(run, f"item {kind}, window binary").distinct()


def _count(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often shingles of each bucket occur in all documents."""

    def keys(text: bytes) -> Iterator[np.ndarray]:
        words = text.translate(WORD_BYTES).split()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        return (Index.keys(hashes, n) for n in range(1, SHINGLE + 1))

    return hashed_counts(docs.select(text_col), keys)


def _mark(docs: DataFrame, text_col: str, index: Index, items_of: list[list[str]]) -> DataFrame:
    """``docs`` with its words (``n``), the ``spans`` found (start, end alternating) and their ``items``."""
    known = sent(docs.sparkSession, (index, items_of))
    at, schema = docs.columns.index(text_col), docs.select("*", F.lit(0).cast("long").alias("n"), F.lit(None).cast("array<int>").alias("spans"), F.lit(None).cast("array<string>").alias("items")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, items_of = known()
        for batch in batches:
            values = texts(batch.column(at))
            n_words, spans, items = [], [], []
            for a, b in chunks(values):
                words, starts = numbered(index.vocabulary, values[a:b])
                step, seen = np.zeros(len(words) + 1, np.int64), []
                for window, start in index.occurrences(words):
                    np.add.at(step, start, 1)
                    np.add.at(step, start + index.sizes[window], -1)
                    seen.append(np.unique(np.column_stack([np.searchsorted(starts, start, "right") - 1, window]), axis=0))
                edges = np.flatnonzero(np.diff(np.r_[0, np.cumsum(step[:-1]) > 0, 0].astype(np.int8)))
                owner = np.searchsorted(starts, edges[::2], "right") - 1
                bounds = 2 * np.searchsorted(owner, np.arange(b - a + 1))
                found: dict[int, set[str]] = {}
                for d, w in np.concatenate(seen) if seen else []:
                    found.setdefault(int(d), set()).update(items_of[w])
                for d in range(b - a):
                    n_words.append(int(starts[d + 1] - starts[d]) - 1)
                    spans.append((edges[bounds[d] : bounds[d + 1]] - starts[d]).tolist())
                    items.append(sorted(found.get(d, ())))
            added = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "n", "spans", "items"])

    return docs.mapInArrow(run, schema)


def merged(spans: list[list[int]]) -> list[int]:
    """The union of lists of spans (start, end alternating)."""
    out: list[int] = []
    for s, e in sorted((int(x[i]), int(x[i + 1])) for x in spans for i in range(0, len(x), 2)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def united(spans: str) -> Column:
    """``merged`` of a column; null for null."""
    return F.pandas_udf(lambda rows: rows.map(lambda x: None if x is None else merged(x)), "array<int>")(spans)


def digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def with_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``by_place(docs)`` and, for each row, ``n`` (words), ``spans`` (of words inside any window found) and ``items`` (ids as strings).

    Nulls and texts without words have no words and no hits; long texts are read whole.  An
    item without words has no window.  An item with a null id marks words but is not listed.
    Repeated rows of either table change nothing but their own number.  Both tables may be
    empty.  Of columns with equal names the first is meant.
    """
    rows, text = by_place(docs), place(docs, text_col)
    windows = cut(windows_of(items, item_id, item_text, window))
    size = windows.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    common = _count(rows, text) if size else None
    marked, later = None, []
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).select("window", F.col("item").cast("string").alias("item")).toArrow()
        if not part.num_rows and block:
            continue
        groups = part.group_by("window").aggregate([("item", "list")]).sort_by("window") if part.num_rows else part
        if part.num_rows:
            index, items_of = Index(groups.column("window").to_pylist()), [[i for i in x if i is not None] for x in groups.column("item_list").to_pylist()]
        else:
            index, items_of = Index([b"\x00"]), [[]]
        index.choose_prefixes(common if common is not None else np.zeros(BUCKETS, np.int64))
        if not block:
            marked = _mark(rows, text, index, items_of)
        else:
            found = _mark(rows.select(text), text, index, items_of).where(F.size("spans") > 0)
            later.append(cut(found.select(digest(text).alias("text_digest"), "spans", "items").distinct()))
    if not later:
        return marked
    union = later[0]
    for more in later[1:]:
        union = union.unionAll(more)
    more = union.groupBy("text_digest").agg(F.collect_list("spans").alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
    none = F.array().cast("array<string>")
    both = {"items": F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", none)))), "spans": F.coalesce("joined_spans", "spans")}
    joined = marked.withColumn("text_digest", digest(text)).join(more, "text_digest", "left").withColumn("joined_spans", united(F.concat(F.array("spans"), "more_spans")))
    return joined.withColumns(both).select(*rows.columns, "n", "spans", "items")


def hit_words() -> Column:
    """The number of words inside spans."""
    return F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans and items behind them."""
    marked = with_hits(picked(docs, id=id_col, text=text_col), items, **options)
    return marked.select(
        F.col("c0").alias(id_col),
        F.col("n").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.col("spans").alias("hit_spans"),
        "items",
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with the columns of ``docs``, whatever their names."""
    return restored(with_hits(docs, items, text_col, **options).where(F.size("spans") == 0), docs)
