"""Writers: appended snapshots, keyed state, JSON reports, model artefacts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.state import latest

METADATA = ("model_type", "features", "threshold", "trained_at", "train_rows", "validation_f1", "test_f1", "version")


#: Folders that rows are dealt out to by a hash, so that a key is found without reading all.
BUCKETS = 64


def bucket(key: str) -> Column:
    """The folder number of a key."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def append_snapshot(rows: DataFrame, path: str, by: str = "document_id") -> None:
    """Add rows to a history that is never changed, with the time they were added; a file for each of ``BUCKETS`` folders at most, however many keys there are."""
    rows.withColumn("created_at", F.current_timestamp()).withColumn("bucket", bucket(by)).repartition(BUCKETS, "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def append_state(rows: DataFrame, path: str) -> None:
    """Add rows to a change log; ``read_state`` folds it."""
    rows.withColumn("updated_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key of a change log."""
    return latest(spark.read.parquet(path), keys, ["updated_at"])


def write_reports(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """A JSON line for each row, in ``BUCKETS`` folders by a hash of the key."""
    rows.select(bucket(key).alias("bucket"), F.to_json(F.struct("*")).alias("value")).repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").text(path)


def save_model(spark: SparkSession, model: PipelineModel, metadata: dict, path: str) -> None:
    """A model and what is known of it; all of ``METADATA`` is required."""
    if lacking := [k for k in METADATA if k not in metadata]:
        raise ValueError(f"a model's metadata lacks {', '.join(lacking)}")
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([{k: str(metadata[k]) for k in METADATA}]).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    metadata = spark.read.json(f"{path}/metadata").first().asDict()
    if lacking := [k for k in METADATA if metadata.get(k) is None]:
        raise ValueError(f"a model's metadata lacks {', '.join(lacking)}")
    return PipelineModel.load(f"{path}/model"), metadata
