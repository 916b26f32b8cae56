"""The catalog file and the publisher's domain table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrove.functions.labels import source_name

CATALOG_SCHEMA = """
    id string, records bigint, tokens bigint, annotated bigint,
    sources array<struct<id:string,name:string,domain:string,records:bigint,tokens:bigint,annotated:bigint>>,
    domains array<struct<name:string,records:bigint,tokens:bigint,sources:bigint>>
"""
SOURCE_ID = r"^[A-Za-z0-9_-]+$"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Nested catalog rows, one per corpus."""
    return spark.read.schema(CATALOG_SCHEMA).json(path)


def sources_of(datasets: DataFrame) -> DataFrame:
    opened = datasets.select(F.col("id").alias("corpus"), F.explode("sources").alias("s"))
    return opened.select(
        "corpus", F.col("s.id").alias("source"), "s.name", "s.domain", "s.records", "s.tokens", "s.annotated")


def domain_table(lines: DataFrame) -> DataFrame:
    """``| domain | [source](url), … | n |`` lines → (domain, source).

    Header, ruler and total lines are left out; other text never starts with a bar.
    """
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.filter(F.col("value").startswith("|")).select(cells.alias("c"))
    rows = rows.filter(
        (F.size("c") == 3) & (F.get("c", F.lit(0)) != "Domain") & ~F.get("c", F.lit(0)).rlike(r"^(:|-|\*\*)"))
    return rows.select(
        F.get("c", F.lit(0)).alias("domain"),
        F.explode(F.regexp_extract_all(F.get("c", F.lit(1)), F.lit(r"\[([^\]]+)\]"), F.lit(1))).alias("source"),
    )


def mapping_faults(mapping: DataFrame) -> DataFrame:
    """Sources listed more than once or with an unexpected id."""
    counted = mapping.groupBy("source").agg(F.count("*").alias("listed"))
    return counted.filter((F.col("listed") > 1) | ~F.col("source").rlike(SOURCE_ID))


def card_defaults(sources: DataFrame, cards: DataFrame, headers: DataFrame) -> DataFrame:
    """Name, domain and licence: card row first, then header, then the default."""
    # --- fixed values: defaults of an undocumented source ---
    return (
        sources.select("source").distinct()
        .join(cards.select("source", F.col("domain").alias("c_domain"), F.col("license").alias("c_license")), "source", "left")
        .join(headers.select("source", F.col("pretty_name"), F.col("domain").alias("h_domain"),
                             F.col("license").alias("h_license")), "source", "left")
        .select(
            "source",
            F.coalesce("pretty_name", source_name(F.col("source"))).alias("name"),
            F.coalesce("c_domain", "h_domain", F.lit("Other")).alias("domain"),
            F.coalesce("c_license", "h_license", F.lit("See source")).alias("license"),
        )
    )
