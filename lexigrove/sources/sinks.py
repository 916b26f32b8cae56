"""Writers, build state and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS_PER_FILE = 1_000_000


def write_partitioned(df: DataFrame, path: str, keys: list[str], spread: Column | None = None,
                      order: str | None = None, arranged: bool = False) -> None:
    """ZSTD Parquet under one folder per key.

    Rows are first grouped by key *and* ``spread`` (for instance a record
    range), so a dominant source is written by many tasks and a small one
    still gives a single file. Without ``spread`` Spark balances the groups by
    size: it splits big ones and joins small ones. ``arranged`` rows are grouped
    already and not moved again. ``order`` sorts inside each file, so that row
    groups and pages can be skipped by it.
    """
    if spread is not None:
        df = df.repartition(*keys, spread)
    elif not arranged:
        df = df.hint("rebalance", *keys)
    if order is not None:
        df = df.sortWithinPartitions(*keys, order)
    (df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE)
       .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def replace_source(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rewrites only the sources present in ``df``; running it again changes nothing."""
    write_partitioned(df, path, keys)


def pending(declared: DataFrame, committed: DataFrame) -> DataFrame:
    """Declared sources not committed yet, the smallest first."""
    return declared.join(committed.select("source"), "source", "left_anti").orderBy("tokens", "source")


def commit(spark: SparkSession, state_path: str, sources: DataFrame) -> None:
    sources.select("source").distinct().write.mode("append").parquet(state_path)


def fingerprint(df: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Order-free content digest: row count and the sum of 32-bit row digests."""
    part = F.conv(F.substring(F.sha2(content, 256), 1, 8), 16, 10).cast("long")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(part).alias("digest"))


def compare_fingerprints(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Missing, extra, different and doubly named entries; nothing means equal."""
    def single(side: DataFrame, prefix: str) -> DataFrame:
        return side.groupBy(*keys).agg(
            F.count("*").alias(f"{prefix}_n"), F.max("rows").alias(f"{prefix}_rows"),
            F.max("digest").alias(f"{prefix}_digest"))

    both = single(expected, "e").join(single(present, "p"), keys, "full")
    verdict = (
        F.when((F.col("e_n") > 1) | (F.col("p_n") > 1), "duplicate")
        .when(F.col("p_n").isNull(), "missing")
        .when(F.col("e_n").isNull(), "extra")
        .when((F.col("e_rows") != F.col("p_rows")) | (F.col("e_digest") != F.col("p_digest")), "differs")
    )
    return both.select(*keys, verdict.alias("status")).filter("status is not null")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
