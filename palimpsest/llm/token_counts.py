"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Encoding is the one costly step and is done once for each text.  Each task sums up
the lengths that it meets, so what is shuffled is a row for each length and task.
With the documents and tokens of all lengths from L on, any context limit has its
answers at hand: texts cut at L give the tokens of shorter texts and L for each
other.  The suffix sums are taken in blocks of lengths, block sums first, so that no
task gets all lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import cut, decoded, picked, sent, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this byte-pair vocabulary's texts are split before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024


def ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def n_tokens(encoding, text: str, pattern: str) -> int:
    """The number of tokens of ``text``.

    The encoder's own splitter gives up on very long runs of one kind of character; then
    the text is split by the same pattern here and each piece is encoded whole.
    """
    try:
        return len(encoding.encode_to_numpy(text, disallowed_special=()))
    except ValueError:
        import regex

        return sum(len(encoding._encode_single_piece(piece[0])) for piece in regex.finditer(pattern, text))


def histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(length, n_docs): how many texts have each number of tokens.

    Null and empty texts have 0; repeated rows count each; an empty table gives no rows.
    Texts are encoded whole, however long.  Bytes that aren't UTF-8 count as U+FFFD.  Other
    columns don't matter; of columns with equal names the first is meant.
    """
    known = sent(docs.sparkSession, ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known(), special_tokens={})
        total: dict[int, int] = {}
        for batch in batches:
            for text in texts(batch.column(0)):
                n = n_tokens(encoding, decoded(text), pattern)
                total[n] = total.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["length", "n_docs"])

    return picked(docs, text=text_col).mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """``lengths`` (length, n_docs) with, for a context limit of each length: docs_from and tokens_from (texts of that length or more), docs_below, tokens_below, truncated_total (tokens if texts are cut at it) and quantile (share of texts of that length or less)."""
    lengths = cut(lengths.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("n_tokens", F.col("length") * F.col("n_docs")))
    blocks = lengths.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("block", zero(F.sum("block_docs").over(later)).alias("docs_later"), zero(F.sum("block_tokens").over(later)).alias("tokens_later"), F.sum("block_docs").over(everything).alias("docs"), F.sum("block_tokens").over(everything).alias("tokens"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc())
    rows = lengths.join(blocks, "block").withColumn("docs_from", F.sum("n_docs").over(inside) + F.col("docs_later")).withColumn("tokens_from", F.sum("n_tokens").over(inside) + F.col("tokens_later"))
    below = F.col("tokens") - F.col("tokens_from")
    return rows.select(
        "length", "n_docs", "n_tokens", "docs_from", "tokens_from", (F.col("docs") - F.col("docs_from")).alias("docs_below"), below.alias("tokens_below"),
        (below + F.col("length") * F.col("docs_from")).alias("truncated_total"), ((F.col("docs") - F.col("docs_from") + F.col("n_docs")) / F.col("docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_cut): for any limits, from ``suffix_sums``.

    The smallest length from the limit on says how many texts reach it and what the others hold.
    """
    wanted = F.explode(F.array(*[F.lit(x).cast("long") for x in sorted(set(limits))]))
    long_enough = F.when(F.col("length") >= F.col("context_limit"), F.struct("length", "docs_from", "tokens_below"))
    found = sums.withColumn("context_limit", wanted).groupBy("context_limit").agg(F.min(long_enough).alias("x"), F.sum("n_tokens").alias("tokens"), F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"))
    return found.select("context_limit", F.coalesce(F.col("x.tokens_below") + F.col("context_limit") * F.col("x.docs_from"), F.col("tokens")).alias("truncated_total"), "docs_cut")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of the texts don't exceed."""
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in sorted(set(shares))]))
    return sums.withColumn("share", wanted).where("quantile >= share").groupBy("share").agg(F.min("length").alias("length"))
