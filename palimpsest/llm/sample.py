"""A bounded sample of labelled rows, for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import cut, picked


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) of the labels that count: 0 or 1, of an id; each pair once."""
    rows = picked(labels, id=id_col, label=label_col).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    return rows.select("id", F.col("label").cast("int").alias("label")).distinct()


def smallest(known: DataFrame, rows: int) -> DataFrame:
    """Of each label in ``known`` (id, label) the ``rows`` rows with the smallest hashed ids."""
    part = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    return part[0].unionAll(part[1])


def sampled_texts(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, rows: int, size: int) -> DataFrame:
    """(id, label, hash, text): labelled texts of ``docs``, for each label at most ``rows`` and ``size`` bytes of them.

    Ids are taken by their hash, then their texts in that order.  A text that comes twice
    under an id counts once; an id may have many texts, so the bounds hold for what the join
    with ``docs`` gives, and are settled on keys and lengths before any text is fetched.  A
    text that would exceed the bytes is passed over, as are all after it.
    """
    texts = picked(docs, id=id_col, text=text_col).withColumn("hash", F.xxhash64("text"))
    ids = F.broadcast(cut(smallest(known, rows)))
    keys = texts.select("id", "hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(ids, "id").distinct()
    order = [F.xxhash64("id"), "id", "hash", "bytes"]
    few = [keys.where(F.col("label") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    held = F.sum(F.col("bytes").cast("long")).over(Window.partitionBy("label").orderBy(*order))
    chosen = cut(few[0].unionAll(few[1]).withColumn("held", held).where(F.col("held") <= size).select("id", "label", "hash"))
    found = texts.join(F.broadcast(chosen), ["id", "hash"]).dropDuplicates(["id", "label", "hash"])
    return cut(found.select("id", "label", "hash", "text"))
