"""Review tag upserts from a stream: the last write per record wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrove.operators import tags
from lexigrove.sources.tables import exists

TAG_SCHEMA = "record_no bigint, tag string, saved_at timestamp_ntz, event_id bigint"
BATCHES_BEFORE_FOLDING = 20


def upsert(spark: SparkSession, inbox: str, store: str, checkpoint: str, files_per_batch: int = 100,
           fold_after: int = BATCHES_BEFORE_FOLDING) -> None:
    """Appends the newest write per record of each batch under ``store/new/batch=<n>``.

    A repeated batch overwrites only its own folder, so retries change nothing,
    and the cost of a batch does not depend on what is stored already. No state
    grows inside the stream. Removals are kept as empty tags, so an older write
    can never bring a tag back. When more than ``fold_after`` batches came since
    the last folding, they are folded.
    """
    def add(batch: DataFrame, number: int) -> None:
        tags.latest(batch.select(tags.TAG_COLUMNS)).write.mode("overwrite").parquet(f"{store}/new/batch={number}")

    query = (
        spark.readStream.schema(TAG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
        .writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if len(_batches(spark, store)) > fold_after:
        fold(spark, store)


def _folded(spark: SparkSession, store: str) -> int:
    """The last batch that is part of a finished folding; -1 without one."""
    if not exists(spark, f"{store}/folded"):
        return -1
    rows = spark.read.schema(TAG_SCHEMA + ", upto bigint").parquet(f"{store}/folded")
    last = rows.agg(F.max("upto")).first()[0]
    return -1 if last is None else last


def _batches(spark: SparkSession, store: str) -> list[int]:
    """Batches that came after the last folding; foldings keep them few."""
    rows = spark.read.schema(TAG_SCHEMA + ", batch bigint").parquet(f"{store}/new")
    return sorted(r["batch"] for r in rows.filter(F.col("batch") > _folded(spark, store)).select("batch").distinct().collect())


def _writes(spark: SparkSession, store: str) -> DataFrame:
    """The last folding and the batches after it; older folders are not opened."""
    upto = _folded(spark, store)
    new = spark.read.schema(TAG_SCHEMA + ", batch bigint").parquet(f"{store}/new").filter(F.col("batch") > upto)
    if upto < 0:
        return new.select(tags.TAG_COLUMNS)
    old = spark.read.schema(TAG_SCHEMA + ", upto bigint").parquet(f"{store}/folded").filter(F.col("upto") == upto)
    return old.select(tags.TAG_COLUMNS).unionByName(new.select(tags.TAG_COLUMNS))


def current(spark: SparkSession, store: str) -> DataFrame:
    """Live tags: the newest write per record."""
    return tags.live(_writes(spark, store))


def fold(spark: SparkSession, store: str) -> None:
    """Folds everything up to the newest batch into ``store/folded/upto=<n>``; removals stay.

    The folder is new and appears when it is complete, so a crash leaves the old
    folding in use. Folders that a later folding covers may be deleted at any time.
    """
    batches = _batches(spark, store)
    if batches:
        tags.latest(_writes(spark, store)).write.mode("overwrite").parquet(f"{store}/folded/upto={batches[-1]}")
