"""Exact statistics of a selection.

Every statistic is a partial aggregate followed by a tiny final one, so a
dominant source or label costs nothing extra. ``cube`` computes the common
summary in one scan; all other figures can be read from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexigrove import fixed
from lexigrove.functions.labels import label_array
from lexigrove.session import settle


def _records_tokens() -> list[Column]:
    return [
        F.count("*").alias("records"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"),
    ]


def totals(records: DataFrame) -> DataFrame:
    """Records, tokens, sources, annotated. Sources are counted from the
    per-source partial sums, which avoids a second distinct shuffle; rows
    without a source count as records but are no source."""
    per_source = records.groupBy("source").agg(*_records_tokens(), F.count("content_quality").alias("annotated"))
    return per_source.agg(
        F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("records"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.count("source").alias("sources"),
        F.coalesce(F.sum("annotated"), F.lit(0)).cast("long").alias("annotated"),
    )


def by_domain(records: DataFrame) -> DataFrame:
    return records.groupBy(F.col("domain").alias("name")).agg(*_records_tokens())


def by_source(records: DataFrame) -> DataFrame:
    return records.groupBy(F.col("source").alias("name"), "domain").agg(*_records_tokens())


def length_bin(tokens: Column, edges: Sequence[int]) -> Column:
    """Index of the bin; the last one also takes NULL and everything longer."""
    bin_no = F.lit(len(edges) - 2)
    for index in range(len(edges) - 2, -1, -1):
        bin_no = F.when(tokens < edges[index + 1], index).otherwise(bin_no)
    return bin_no


def bins(spark, edges: Sequence[int]) -> DataFrame:
    bounds = F.array(*[F.lit(e).cast("long") for e in edges])
    return spark.range(len(edges) - 1).select(
        F.col("id").cast("int").alias("bin"),
        F.get(bounds, F.col("id").cast("int")).alias("min"),
        (F.get(bounds, (F.col("id") + 1).cast("int")) - 1).alias("max"),
    )


def length_histogram(records: DataFrame, edges: Sequence[int] = fixed.LENGTH_EDGES) -> DataFrame:
    """All bins, the empty ones with 0."""
    counted = records.groupBy(length_bin(F.col("token_count"), edges).alias("bin")).agg(
        F.count("*").alias("records"))
    return (
        bins(records.sparkSession, edges).join(counted, "bin", "left")
        .select("bin", "min", "max", F.coalesce("records", F.lit(0)).alias("records"))
    )


def shown_histogram(histogram: DataFrame) -> DataFrame:
    """Without the empty bins at the end; the first bin is always shown."""
    histogram = settle(histogram)
    last = histogram.agg(F.coalesce(F.max(F.when(F.col("records") > 0, F.col("bin"))), F.lit(0)))
    return histogram.filter(F.col("bin") <= last.scalar())


def token_range(histogram: DataFrame, first_bin: int, last_bin: int) -> tuple[int, int]:
    """Inclusive token bounds of a span of bins."""
    row = histogram.agg(
        F.min(F.when(F.col("bin") == first_bin, F.col("min"))).alias("low"),
        F.max(F.when(F.col("bin") == last_bin, F.col("max"))).alias("high"),
    ).first()
    return row["low"], row["high"]


def annotation_distribution(records: DataFrame, field: str) -> DataFrame:
    """Records per label (each label once per record) with the missing ones,
    and in every row the number of records that have any label."""
    if field not in fixed.SELECTION_FIELDS:
        raise ValueError("Unknown annotation field")
    # Few distinct label combinations exist, so they are counted first and the
    # lists are opened on the summary, not on the records.
    combos = settle(records.groupBy(F.array_sort(label_array(field)).alias("labels")).agg(F.count("*").alias("n")))
    counted = combos.select(F.explode("labels").alias("name"), "n").groupBy("name").agg(F.sum("n").alias("records"))
    # A record without a label is in exactly one combination, the sentinel alone.
    labelled = F.get("labels", F.lit(0)) != fixed.MISSING
    covered = combos.agg(F.coalesce(F.sum(F.when(labelled, F.col("n"))), F.lit(0)))
    return counted.withColumn("covered", covered.scalar())


def present_fields(records: DataFrame, fields: Sequence[str] = fixed.SELECTION_FIELDS) -> list[str]:
    return [f for f in fields if f in records.columns]


def profile(records: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Records and tokens per combination of labels: one scan, one narrow shuffle.

    Labels come from short fixed lists, so few combinations occur and every
    label statistic can be read from this summary.
    """
    combos = [F.array_sort(label_array(f)).alias(f) for f in present_fields(records)]
    return records.select(*extra, "token_count", *combos).groupBy(*extra, *present_fields(records)).agg(*_records_tokens())


def opened(summary: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """A profile as ``field, value, records``, the missing label included."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("labels")) for f in present_fields(summary)])
    long = summary.select(*extra, "records", F.explode(pairs).alias("p")).select(
        *extra, "records", F.col("p.field").alias("field"), F.explode("p.labels").alias("value"))
    return long.groupBy(*extra, "field", "value").agg(F.sum("records").alias("records"))


def all_distributions(records: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Records per field and label, each label once per record."""
    return opened(profile(records, extra), extra)


def annotation_values(records: DataFrame) -> DataFrame:
    """Sorted published values per field."""
    found = all_distributions(records).filter(F.col("value") != fixed.MISSING)
    return found.groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("values"))


def cube(records: DataFrame, field: str = "content_quality", edges: Sequence[int] = fixed.LENGTH_EDGES) -> DataFrame:
    """One scan for everything a statistics view shows."""
    return records.groupBy(
        "source", "domain", length_bin(F.col("token_count"), edges).alias("bin"),
        label_array(field).alias("labels"),
    ).agg(*_records_tokens(), F.count("content_quality").alias("annotated"))


def published_fallback(catalog_sources: DataFrame, field: str, filters: dict | None = None) -> DataFrame:
    """Distribution from published counts alone: no record is read.

    Legal only for source/domain choices; an intersection with labels or
    lengths needs the records and is refused here.
    """
    if filters:
        raise ValueError("published counts cannot answer a selection by labels or lengths")
    counts = F.col("annotation_distributions")[field]
    labels = catalog_sources.select(F.explode(counts).alias("name", "records"))
    known = F.aggregate(F.coalesce(F.map_values(counts), F.array().cast("array<bigint>")),
                        F.lit(0).cast("long"), lambda s, x: s + x)
    rest = catalog_sources.filter(F.col("annotation_distributions").isNotNull()).select(
        F.lit(fixed.MISSING).alias("name"), (F.col("records") - known).alias("records"))
    return labels.unionByName(rest).groupBy("name").agg(F.sum("records").alias("records")).filter("records > 0")


def top_composition(groups: DataFrame, measure: str, count: int) -> DataFrame:
    return groups.orderBy(F.col(measure).desc(), F.col("name").asc()).limit(count)


def quality_order(distribution: DataFrame) -> DataFrame:
    """Ordinal position of quality labels; anything else comes last."""
    order = F.array(*[F.lit(q) for q in fixed.QUALITY_LABELS])
    place = F.array_position(order, F.col("name"))
    return distribution.withColumn("place", F.when(place > 0, place - 1).otherwise(99).cast("long"))
