"""What the training-data operators share: words, batches of text, cut lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte, so UTF-8 stays valid.
ASCII_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))

#: As above, and every ASCII byte but digits and letters becomes a space:
#: ``bytes.translate(WORD_BYTES).split()`` then yields the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in ASCII_LOWER)

#: The words ``[^\x20\x09-\x0D]+`` of a text, for Spark's regular expressions.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share; in local mode without one, a temporary folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gone(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store Spark has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sent(spark: SparkSession, value) -> Callable[[], object]:
    """``value`` broadcast, to be called for in a task; classes of this package travel with it."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(data.value)


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed by their place (c0, c1, ...), so that no name of it clashes with one of ours."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """What column ``name`` of ``df`` is called in ``by_place(df)``; of equal names the first."""
    return f"c{df.columns.index(name)}"


def texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8; null reads as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def decoded(text: bytes) -> str:
    """UTF-8 as characters; bytes that aren't UTF-8 read as U+FFFD."""
    return text.decode("utf-8", "replace")


def picked(df: DataFrame, **names: str) -> DataFrame:
    """Some columns of ``df``, each under a name of ours, whatever else ``df`` has."""
    return by_place(df).select(*[F.col(place(df, name)).alias(ours) for ours, name in names.items()])


def restored(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``by_place(like)`` in ``rows`` under the names of ``like``."""
    return rows.select(*by_place(like).columns).toDF(*like.columns)


#: Buckets of ``hashed_counts``; the counts are 4 MB.
BUCKETS = 1 << 20


def hashed_counts(column: DataFrame, keys: Callable[[bytes], Iterator[np.ndarray]]) -> np.ndarray:
    """How many keys of all texts (the one column) fall in each of ``BUCKETS`` buckets; ``keys``: of a text, as 64-bit numbers.

    A task sends its counts in 64 parts, which are added up apart; counts end at 2^31 - 1.
    """
    chunk = BUCKETS >> 6
    kinds = "chunk int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                for some in keys(text):
                    np.add.at(total, bucket(some), 1)
        if total.any():
            parts = [x.tobytes() for x in total.astype(np.int32).reshape(-1, chunk)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        most = np.iinfo(np.int32).max
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, most).astype(np.int32).tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    rows = column.mapInArrow(count, kinds).repartition("chunk").mapInArrow(add, kinds).toArrow()
    total = np.zeros((BUCKETS // chunk, chunk), np.int32)
    for k, counts in zip(*(rows.column(c).to_pylist() for c in ("chunk", "counts"))):
        total[k] = np.frombuffer(counts, np.int32)
    return total.ravel()


def bucket(keys: np.ndarray) -> np.ndarray:
    return (keys % np.uint64(BUCKETS)).astype(np.int64)


def chunks(values: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values of about ``limit`` bytes together, so that arrays made of them stay small."""
    start = size = 0
    for i, value in enumerate(values):
        size += len(value)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)
