"""Build and publication of a corpus snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexigrove.operators import audits, joins, numbering
from lexigrove.sources import sinks, tables

MANIFEST_SCHEMA = "artefact string, status string, revision string, records bigint, fingerprint string, folder string"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    if not tables.exists(spark, path):
        return spark.createDataFrame([], "source string")
    return spark.read.schema("source string").parquet(path)


def ingest_pending(spark: SparkSession, declared: DataFrame, texts: DataFrame, annotations: DataFrame,
                   target: str, state: str) -> list[str]:
    """Joins and writes the sources that are not committed yet; safe to run again.

    All pending sources go through one job. Each source replaces its own folder
    and is committed after its rows are written, so a lost run repeats only
    what was not committed.
    """
    todo = sinks.pending(declared, read_state(spark, state))
    names = [r["source"] for r in todo.select("source").collect()]  # catalog-sized
    if not names:
        return []
    wanted = F.col("source").isin(names)
    faults = audits.repeated(annotations.filter(wanted), joins.RECORD_KEY)
    if not faults.isEmpty():
        raise ValueError("Duplicate annotation ids")
    joined = joins.attach_annotations(texts.filter(wanted), annotations.filter(wanted))
    # Nothing of the live sources is replaced before the join has passed its audit.
    if not audits.rows_preserved(texts.filter(wanted), joined).isEmpty():
        raise ValueError("The join changed a row count")
    sinks.replace_source(joined, target, ["corpus", "source"])
    sinks.commit(spark, state, todo)
    return names


def assemble(parts: list[DataFrame]) -> DataFrame:
    """Union by name, then dense numbers in source order."""
    return numbering.dense_numbers(tables.union_by_name(parts), "source", "doc_id")


def content(df: DataFrame) -> Column:
    """All columns of a row as one text, whatever their order."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def publish(spark: SparkSession, path: str, snapshot: DataFrame, checks: dict[str, DataFrame],
            write: Callable[[DataFrame, str], None], revision: str = "v1") -> DataFrame:
    """Writes a new version of the data and, last, the manifest that names it.

    Nothing is written before every audit passed. The new folder is read back;
    its row count and content digest by source must be those of the snapshot. A
    manifest is a file of its own and never changed: until the new one is there,
    readers see the old version, whose folder stays as it is.
    """
    results = audits.verdict(checks)
    failed = results.filter(F.col("faults") > 0).orderBy("check").limit(len(checks)).collect()
    if failed:
        raise ValueError("Audits failed: " + ", ".join(f"{r['check']} ({r['faults']})" for r in failed))
    folder = f"{path}-data-{uuid.uuid4().hex}"
    write(snapshot, folder)
    stored = spark.read.schema(snapshot.schema).parquet(folder)
    wanted, got = (sinks.fingerprint(df, ["source"], content(df)) for df in (snapshot, stored))
    if not (wanted.exceptAll(got).isEmpty() and got.exceptAll(wanted).isEmpty()):
        raise ValueError("the written data differ from the snapshot")
    row = describe(stored, "records", "ready", revision).withColumn("folder", F.lit(folder))
    publish_manifest(spark, path, row)
    return manifest(spark, path)


def publish_manifest(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Writes the next manifest as one new file; two writers cannot both make the same version."""
    last = versions(spark, path)
    number = (last[-1] if last else 0) + 1
    rows.select(*_manifest_columns(rows)).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={number}")
    return number


def _manifest_columns(rows: DataFrame) -> list[Column]:
    return [F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n)
            for n in ("artefact", "status", "revision", "records", "fingerprint", "folder")]


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all finished manifests; they are few."""
    if not tables.exists(spark, path):
        return []
    rows = spark.read.schema(MANIFEST_SCHEMA + ", version int").parquet(path)
    return sorted(r["version"] for r in rows.select("version").distinct().collect())


def manifest(spark: SparkSession, path: str, revision: str | None = None) -> DataFrame:
    """The newest manifest, or the newest one of a revision."""
    rows = spark.read.schema(MANIFEST_SCHEMA + ", version int").parquet(path)
    if revision is not None:
        rows = rows.filter(F.col("revision") == revision)
    newest = rows.agg(F.max("version").alias("v")).first()["v"]
    if newest is None:
        raise LookupError(f"nothing is published as {revision!r}")
    return rows.filter(F.col("version") == newest).drop("version")


def published(spark: SparkSession, path: str, revision: str | None = None) -> DataFrame:
    """The data of the newest version, or of a revision."""
    return spark.read.parquet(manifest(spark, path, revision).filter("artefact = 'records'").first()["folder"])


def describe(df: DataFrame, artefact: str, status: str, revision: str = "v1") -> DataFrame:
    """Manifest row: row count and order-free digest of the whole content."""
    return _described(sinks.fingerprint(df, [], content(df)), artefact, status, revision)


def covered(df: DataFrame, artefact: str, status: str = "ready", revision: str = "v1") -> DataFrame:
    """Manifest row of a table derived from the records: which records it covers."""
    numbers = df.select("record_no").distinct()
    return _described(sinks.fingerprint(numbers, [], F.col("record_no").cast("string")), artefact, status, revision)


def _described(digest: DataFrame, artefact: str, status: str, revision: str) -> DataFrame:
    return digest.select(
        F.lit(artefact).alias("artefact"), F.lit(status).alias("status"), F.lit(revision).alias("revision"),
        F.col("rows").alias("records"), F.col("digest").cast("string").alias("fingerprint"))
