"""Comparison of corpora on catalog tables; no record is read here."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrove.operators.catalog import flatten_labels


def domain_share(domains: DataFrame, measure: str, domain: str = "") -> DataFrame:
    """Amount and share per corpus and domain.

    The denominator is always the whole corpus, also when one domain is chosen.
    ``of_max`` scales against the largest corpus amount that is shown.
    """
    whole = domains.groupBy("corpus").agg(F.sum(measure).alias("whole"))
    shown = domains.filter(F.col("name") == domain) if domain else domains
    largest = shown.groupBy("corpus").agg(F.sum(measure).alias("a")).agg(
        F.greatest(F.lit(1), F.max("a"))).scalar()
    return shown.join(whole, "corpus").select(
        "corpus", F.col("name").alias("domain"), F.col(measure).alias("amount"),
        F.round(F.col(measure) / F.col("whole"), 6).alias("share"),
        F.round(F.col(measure) / largest, 6).alias("of_max"),
    )


def domain_matrix(domains: DataFrame, measure: str, corpora: list[str]) -> DataFrame:
    """Domain × corpus; NULL where a corpus has no source in the domain."""
    return domains.groupBy(F.col("name").alias("domain")).pivot("corpus", corpora).agg(F.sum(measure))


def annotation_share(sources: DataFrame, field: str, domain: str = "") -> DataFrame:
    """Records per label and corpus, plus those without a published label.

    Shares are of all records of the scope. A corpus with no known label at all
    is marked as not published.
    """
    scope = sources.filter(F.col("domain") == domain) if domain else sources
    whole = scope.groupBy("corpus").agg(F.sum("records").alias("total"))
    labels = flatten_labels(scope).filter(F.col("field") == field).groupBy("corpus", "value").agg(
        F.sum("records").alias("records"))
    known = labels.groupBy("corpus").agg(F.sum("records").alias("known"))
    scoped = whole.join(known, "corpus", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    rest = scoped.select(
        "corpus", F.lit("unreported").alias("value"), (F.col("total") - F.col("known")).alias("records"))
    return labels.unionByName(rest).join(scoped, "corpus").select(
        "corpus", "value", "records",
        F.when(F.col("total") == 0, 0.0).otherwise(F.round(F.col("records") / F.col("total"), 6)).alias("share"),
        (F.col("known") > 0).alias("published"),
    )


def categories(sources: DataFrame, field: str) -> DataFrame:
    return (
        sources.select(F.explode(F.map_keys(F.col("annotation_distributions")[field])).alias("value")).distinct()
    )
