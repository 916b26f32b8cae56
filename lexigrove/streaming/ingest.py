"""Incremental ingest: new source files are joined, audited and committed once, also after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrove.operators import audits, joins


def ingest(spark: SparkSession, inbox: str, schema, annotations: DataFrame, target: str, checkpoint: str,
           files_per_batch: int = 1000) -> None:
    """Processes everything new in ``inbox`` (texts by corpus, source and id) and stops.

    Every batch attaches the annotations of its records and must keep its row
    counts; then it is written as ``target/batch=<n>/source=<s>``. The file log in
    ``checkpoint`` remembers what was read. A batch that is repeated after a crash
    between its write and its commit has the same number and files and replaces
    only its own folder, so nothing is added twice.
    """
    def add(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            notes = annotations.join(rows.select(*joins.RECORD_KEY).distinct(), joins.RECORD_KEY, "left_semi")
            if not audits.repeated(notes, joins.RECORD_KEY).isEmpty():
                raise ValueError("Duplicate annotation ids")
            joined = joins.attach_annotations(rows, notes)
            if not audits.rows_preserved(rows, joined).isEmpty():
                raise ValueError("The join changed a row count")
            joined.write.mode("overwrite").partitionBy("source").parquet(f"{target}/batch={number}")
        finally:
            rows.unpersist()

    rows = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true").parquet(inbox)
    )
    query = (
        rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


def committed(spark: SparkSession, target: str) -> DataFrame:
    """Rows per batch and source."""
    return spark.read.parquet(target).groupBy("batch", "source").agg(F.count("*").alias("records"))
