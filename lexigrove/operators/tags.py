"""Review tags: the last write per record wins, an empty tag removes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TAG_COLUMNS = ["record_no", "tag", "saved_at", "event_id"]


def latest(writes: DataFrame) -> DataFrame:
    """One pass with partial aggregation; no per-record sort."""
    newest = writes.groupBy("record_no").agg(
        F.max(F.struct("saved_at", "event_id", "tag")).alias("last"))
    return newest.select("record_no", "last.tag", "last.saved_at", "last.event_id")


def live(writes: DataFrame) -> DataFrame:
    return latest(writes).filter(F.col("tag") != "")


def export(tags: DataFrame, records: DataFrame, version: str) -> DataFrame:
    """Tag rows with the identity of the record and without its text."""
    return tags.join(records.select("record_no", "id", "source"), "record_no").select(
        "record_no", "id", "source", F.lit(version).alias("version"), "tag", "saved_at")
