"""Connected components by alternating star steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reliable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder (a temporary one in local mode, where none is set)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of ``edges`` (a, b): the smallest id that it is connected with.

    Each round hangs the larger neighbours of a vertex on its smallest neighbour, then the
    smaller ones; rounds grow with the logarithm of a component's size.
    """
    edges = reliable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while before != (0, None):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        hung = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = hung.groupBy("a").agg(F.min("b").alias("m"))
        pairs = hung.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = reliable(pairs.select("e.a", "e.b").where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
