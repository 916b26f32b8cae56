"""Catalog tables: published statistics per corpus, source and domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrove import fixed
from lexigrove.functions.labels import source_name
from lexigrove.operators import stats

SOURCE_KEY = ["corpus", "source", "domain"]


def catalog_sources(records: DataFrame, unpublished: list[str]) -> DataFrame:
    """Per source: records, tokens, annotated, quality counts and one map of
    label counts per field. A corpus without published annotations has NULL
    there, which is not the same as zero."""
    summary = stats.profile(records, SOURCE_KEY)
    labelled = F.get("content_quality", F.lit(0)) != fixed.MISSING
    base = summary.groupBy(*SOURCE_KEY).agg(
        F.sum("records").alias("records"), F.sum("tokens").alias("tokens"),
        F.coalesce(F.sum(F.when(labelled, F.col("records"))), F.lit(0)).alias("annotated"),
    )
    counts = stats.opened(summary, SOURCE_KEY).filter(F.col("value") != fixed.MISSING)
    per_field = counts.groupBy(*SOURCE_KEY, "field").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "records")))).alias("labels"))
    maps = per_field.groupBy(*SOURCE_KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.map_entries("labels").alias("e")))))
        .alias("m"))
    maps = maps.select(*SOURCE_KEY, F.transform_values("m", lambda _, e: F.map_from_entries(e)).alias("m"))
    published = ~F.col("corpus").isin(unpublished) if unpublished else F.lit(True)
    # A published field without any label still has an (empty) map.
    empty = F.map_from_entries(F.array(*[
        F.struct(F.lit(f), F.map_from_entries(F.array().cast("array<struct<value:string,records:bigint>>")))
        for f in stats.present_fields(records)
    ]))
    full = F.map_zip_with(empty, F.col("m"), lambda _, e, m: F.coalesce(m, e))
    return base.join(maps, SOURCE_KEY, "left").select(
        *SOURCE_KEY, "records", "tokens",
        F.when(published, F.col("annotated")).alias("annotated"),
        F.when(published, F.coalesce(full, empty)).alias("annotation_distributions"),
    ).withColumn("quality", F.col("annotation_distributions")["content_quality"]).withColumn(
        "name", source_name(F.col("source")))


def domain_rollup(sources: DataFrame) -> DataFrame:
    return sources.groupBy("corpus", F.col("domain").alias("name")).agg(
        F.sum("records").alias("records"), F.sum("tokens").alias("tokens"), F.count("*").alias("sources"))


def corpus_totals(sources: DataFrame) -> DataFrame:
    return sources.groupBy("corpus").agg(
        F.sum("records").alias("records"), F.sum("tokens").alias("tokens"),
        F.count("*").alias("sources"), F.sum("annotated").alias("annotated"))


def grand_totals(sources: DataFrame) -> DataFrame:
    """One row per corpus and one over all of them."""
    return sources.rollup("corpus").agg(
        F.sum("records").alias("records"), F.sum("tokens").alias("tokens"),
        F.count("*").alias("sources"),
    ).withColumn("corpus", F.coalesce("corpus", F.lit("all")))


def flatten_labels(sources: DataFrame) -> DataFrame:
    """Nested maps → one row per source, field and label."""
    fields = sources.select(*SOURCE_KEY, F.explode("annotation_distributions").alias("field", "labels"))
    return fields.select(*SOURCE_KEY, "field", F.explode("labels").alias("value", "records"))


def label_dictionary(sources: DataFrame) -> DataFrame:
    """Published values with a small code per field; code 0 stands for missing."""
    from pyspark.sql import Window as W

    values = flatten_labels(sources).select("field", "value").distinct()
    return values.withColumn("code", F.row_number().over(W.partitionBy("field").orderBy("value")).cast("long"))


def encode_labels(records: DataFrame, dictionary: DataFrame, fields: list[str]) -> DataFrame:
    """Label → code by a small dictionary; a missing label becomes 0."""
    coded = records
    for field in fields:
        codes = dictionary.filter(F.col("field") == field).select(
            F.col("value").alias(field), F.col("code").alias(f"{field}_code"))
        coded = coded.join(codes, field, "left").withColumn(
            f"{field}_code", F.coalesce(f"{field}_code", F.lit(0).cast("long")))
    return coded


def as_datasets(sources: DataFrame) -> DataFrame:
    """Nested catalog rows, one per corpus, ready for a JSON file."""
    nested = sources.groupBy("corpus").agg(
        F.sum("records").alias("records"), F.sum("tokens").alias("tokens"),
        F.sum("annotated").alias("annotated"),
        F.array_sort(F.collect_list(F.struct(
            F.col("source").alias("id"), "name", "domain", "records", "tokens", "annotated",
        ))).alias("sources"),
    )
    domains = domain_rollup(sources).groupBy("corpus").agg(
        F.array_sort(F.collect_list(F.struct("name", "records", "tokens", "sources"))).alias("domains"))
    return nested.join(domains, "corpus").withColumnRenamed("corpus", "id")
