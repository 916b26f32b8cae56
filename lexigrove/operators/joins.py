"""Joins between texts, annotations, search hits and sidecar tables.

Only keys of one record are joined, so no key repeats and no join can explode.
Sizes are left to Spark: a side below its broadcast threshold is broadcast,
anything else is shuffled, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrove.functions.text import identity_hash

RECORD_KEY = ["corpus", "source", "id"]


def attach_annotations(texts: DataFrame, annotations: DataFrame) -> DataFrame:
    """Texts keep every row; records without annotations get NULL labels."""
    return texts.join(annotations, RECORD_KEY, "left")


def attach_if_identical(texts: DataFrame, annotations: DataFrame, fields: list[str]) -> DataFrame:
    """Annotations attach only where position, source and id digest agree."""
    side = annotations.select(
        "source", F.col("row_index").alias("source_row"), F.col("id_hash"),
        *[F.col(f).alias(f"_{f}") for f in fields],
    )
    joined = texts.join(side, ["source", "source_row"], "left")
    matched = F.coalesce(F.col("id_hash") == identity_hash(F.col("id")), F.lit(False))
    return joined.select(
        *texts.columns, matched.alias("matched"),
        *[F.when(matched, F.col(f"_{f}")).alias(f) for f in fields],
    )


def positional_mismatches(texts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows of two equally ordered tables whose ids differ or that lack a partner."""
    left = texts.select("source", "source_row", F.col("id").alias("text_id"))
    right = metadata.select("source", "source_row", F.col("id").alias("metadata_id"))
    return left.join(right, ["source", "source_row"], "full").filter(
        ~F.col("text_id").eqNullSafe(F.col("metadata_id")))


def enrich_by_key(hits: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Hits found by ``(source, id)``; hits without a record are dropped."""
    return hits.join(records.select("source", "id", *columns), ["source", "id"])


def topic_points(records: DataFrame, points: DataFrame, assignments: DataFrame) -> DataFrame:
    return records.join(points, "record_no").join(assignments, "record_no")


def uncovered(left: DataFrame, right: DataFrame, key: str = "record_no") -> DataFrame:
    """Keys on one side only, with the side that has them."""
    a = left.select(key, F.lit(True).alias("in_left"))
    b = right.select(key, F.lit(True).alias("in_right"))
    both = a.join(b, key, "full").filter(F.col("in_left").isNull() | F.col("in_right").isNull())
    return both.select(key, F.when(F.col("in_left"), "left").otherwise("right").alias("only_in"))


def domain_of(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources.select("source", "domain", "name"), "source", "left")
