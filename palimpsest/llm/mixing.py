"""Mixing sources to target weights by prefix sums over hash-random keys.

Every row has a key that is random and depends on nothing but the row (MD5 of id
and text), so a source sorted by key is in random order and a rerun finds the same
order.  A source's budget is a number of whole epochs and a rest; the rest is the
head of the sorted source.  Keys are cut into ``16**RANGE_DIGITS`` equal ranges.
Sums of the ranges, summed up over the ranges of a source, say where each range
starts; a running sum inside each range, sorted by key, then says where each row
ends.  A range is a fixed small share of its source, so a hot source is spread over
as many tasks as any number of sources.  What the mix needs to know after that is a
row for each source: epochs, the key where the rest ends, and the words left there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import SPACE_WORD, by_place, cut, picked, place

RANGE_DIGITS = 3
WEIGHTS = (3, 1, 2)
#: Sources whose plan is sent to all executors; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with __none and __source (never null), __size and __key."""
    return docs.withColumns(
        {
            "__none": F.col(source_col).isNull(),
            "__source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
            "__size": words(text_col),
            "__key": F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(F.col(text_col), F.lit("")))),
        }
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``sizes`` (__none, __source, source_size) with ``target``: min(most * size, level * weight) with the level that makes them add up to ``share`` of all.

    That level is where resharing the excess over ``most`` times a size ends.  Sorted by
    size over weight, the sources at their limit come first; the level follows from the
    sums over them.
    """
    order = Window.orderBy("__none", "__source")
    up = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    placed = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    levelled = placed.withColumn("level", level).withColumn("rank", F.row_number().over(up))
    free = F.min(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct("rank", "level"))).over(everything)
    target = F.least(F.col("limit").cast("double"), F.coalesce(free["level"] * F.col("weight"), F.col("limit").cast("double")))
    return levelled.select("__none", "__source", "source_size", target.alias("target"))


def plan(slim: DataFrame, **options) -> DataFrame:
    """A row for each source of ``slim`` (__none, __source, __size, __key): source_size, target, __epochs, __cut, __left, __there.

    A mix takes __epochs times every row, once more the rows with a key below __cut, and of
    the rows with that key, which hold __there words together, __left words.
    """
    source = ["__none", "__source"]
    ranged = slim.withColumn("__range", F.substring("__key", 1, RANGE_DIGITS))
    ranges = cut(ranged.groupBy(*source, "__range").agg(F.sum("__size").alias("words")))
    goal = targets(ranges.groupBy(*source).agg(F.sum("words").alias("source_size")), **options)
    budget = F.floor("target").cast("long")
    goal = cut(goal.withColumn("__epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)).withColumn("__rest", budget - F.col("__epochs") * F.col("source_size")))
    start = F.sum("words").over(Window.partitionBy(*source).orderBy("__range")) - F.col("words")
    base = ranges.withColumn("start", start).join(goal, source).select(*source, "__range", "start", "__rest")
    ends = F.sum("__size").over(Window.partitionBy(*source, "__range").orderBy("__key"))
    run = ranged.withColumn("end", ends).join(base, [*source, "__range"]).withColumn("end", F.col("end") + F.col("start"))
    reaches = (F.col("end") >= F.col("__rest")) & (F.col("__rest") > 0)
    ended = run.groupBy(*source).agg(
        F.min(F.when(reaches, F.struct("__key", "end"))).alias("at"),
        F.coalesce(F.max(F.when(F.col("end") < F.col("__rest"), F.col("end"))), F.lit(0)).alias("before"),
    )
    return cut(goal.join(ended, source).select(*source, "source_size", "target", "__epochs", F.col("at.__key").alias("__cut"), (F.col("__rest") - F.col("before")).alias("__left"), (F.col("at.end") - F.col("before")).alias("__there")))


def taken(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """``rows`` (with the columns of ``keyed``) with source_size, target and taken."""
    known = F.broadcast(plan_) if plan_.count() <= BROADCAST_SOURCES else plan_
    rest = F.when(F.col("__key") < F.col("__cut"), F.col("__size")).when(F.col("__key") == F.col("__cut"), F.expr("(__size * __left) div __there")).otherwise(0)
    return rows.join(known, ["__none", "__source"]).withColumn("taken", F.col("__epochs") * F.col("__size") + rest)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, size, source_size, target, taken): one row for each row of ``docs``.

    Size is the number of words of the text (null: 0).  Sources are ordered by code point,
    null last, and weigh ``weights`` in turn; they share ``share`` times all words, but none
    more than ``most`` times its own.  What a source takes adds up to its target, rounded
    down; the row where the rest ends gives only the words still missing, and equal rows
    there share those by halves, thirds and so on, rounded down.  Rows without words and
    sources without words take nothing.  An empty table gives no rows.  Other columns don't
    matter; of columns with equal names the first is meant.
    """
    rows = cut(keyed(picked(docs, id=id_col, text=text_col, source=source_col), "id", "text", "source").drop("text", "source"))
    mixed = taken(rows, plan(rows.drop("id"), **options))
    return mixed.select(F.col("id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out: str = "taken_words", **options) -> DataFrame:
    """The rows of ``docs`` of which the mix takes a word or more, with ``out``: how many, repeats counted.

    Texts are not shuffled: whether a row is in follows from its own key and its source's
    plan.  Columns keep their values whatever their names, but one named ``out`` is replaced.
    Nulls, repeats and empty texts are as in ``mix``.
    """
    rows = keyed(by_place(docs), place(docs, id_col), place(docs, text_col), place(docs, source_col))
    kept = [(f"c{k}", name) for k, name in enumerate(docs.columns) if name != out]
    chosen = taken(rows, plan(rows.select("__none", "__source", "__size", "__key"), **options)).where("taken > 0")
    return chosen.select(*[c for c, _ in kept], "taken").toDF(*[name for _, name in kept], out)
