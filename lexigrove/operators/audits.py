"""Data quality checks. Each returns the offending rows, so empty means passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lexigrove import fixed
from lexigrove.functions import vectors as vec
from lexigrove.operators.catalog import SOURCE_KEY, corpus_totals, flatten_labels
from lexigrove.operators.joins import uncovered
from lexigrove.operators.stats import all_distributions


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("times")).filter(F.col("times") > 1)


def rows_preserved(texts: DataFrame, joined: DataFrame) -> DataFrame:
    """Sources whose joined row count differs from the text count."""
    a = texts.groupBy("source").agg(F.count("*").alias("texts"))
    b = joined.groupBy("source").agg(F.count("*").alias("joined"))
    return a.join(b, "source", "full").filter(~F.col("texts").eqNullSafe(F.col("joined")))


def counts_vs_published(records: DataFrame, published: DataFrame) -> DataFrame:
    """Per source: counts that differ from the catalog, with the token difference."""
    actual = records.groupBy(*SOURCE_KEY).agg(
        F.count("*").alias("a_records"), F.sum("token_count").alias("a_tokens"),
        F.count("content_quality").alias("a_annotated"))
    both = actual.join(published.select(*SOURCE_KEY, "records", "tokens", "annotated"), SOURCE_KEY, "full")
    differs = (
        ~F.col("a_records").eqNullSafe(F.col("records"))
        | ~F.col("a_tokens").eqNullSafe(F.col("tokens"))
        | (F.col("annotated").isNotNull() & ~F.col("a_annotated").eqNullSafe(F.col("annotated")))
    )
    return both.filter(differs).select(
        *SOURCE_KEY,
        F.coalesce("a_records", F.lit(0)).alias("actual_records"),
        F.coalesce("records", F.lit(0)).alias("published_records"),
        (F.coalesce("a_tokens", F.lit(0)) - F.coalesce("tokens", F.lit(0))).alias("token_difference"))


def distribution_vs_published(records: DataFrame, published: DataFrame) -> DataFrame:
    """Label counts that differ from the catalog, where the catalog has any."""
    known = published.filter(F.col("annotation_distributions").isNotNull()).select(*SOURCE_KEY)
    actual = (
        all_distributions(records, SOURCE_KEY).filter(F.col("value") != fixed.MISSING)
        .join(known, SOURCE_KEY, "left_semi").withColumnRenamed("records", "actual"))
    stated = flatten_labels(published).withColumnRenamed("records", "published")
    return actual.join(stated, [*SOURCE_KEY, "field", "value"], "full").filter(
        ~F.col("actual").eqNullSafe(F.col("published"))
    ).withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("published", F.coalesce("published", F.lit(0)))


def sources_vs_root(published: DataFrame, root: DataFrame) -> DataFrame:
    """Corpora whose sources do not add up to the stated corpus totals."""
    summed = corpus_totals(published).select("corpus", F.col("records").alias("s_records"), F.col("tokens").alias("s_tokens"))
    return root.select("corpus", "records", "tokens").join(summed, "corpus", "full").filter(
        ~F.col("records").eqNullSafe(F.col("s_records")) | ~F.col("tokens").eqNullSafe(F.col("s_tokens"))
    ).select(
        "corpus", (F.coalesce("s_records", F.lit(0)) - F.coalesce("records", F.lit(0))).alias("record_difference"),
        (F.coalesce("s_tokens", F.lit(0)) - F.coalesce("tokens", F.lit(0))).alias("token_difference"))


def published_bounds(published: DataFrame) -> DataFrame:
    """Negative counts, more annotated records than records, more labels of a
    single-label field than records."""
    plain = published.filter((F.col("records") < 0) | (F.col("tokens") < 0) | (F.col("annotated") < 0)).select(
        *SOURCE_KEY, F.lit("negative").alias("fault"))
    annotated = published.filter(F.col("annotated") > F.col("records")).select(
        *SOURCE_KEY, F.lit("annotated").alias("fault"))
    labels = flatten_labels(published).filter(~F.col("field").isin(fixed.MULTI_LABEL_FIELDS))
    summed = labels.groupBy(*SOURCE_KEY, "field").agg(
        F.sum("records").alias("n"), F.min("records").alias("least"))
    bad = summed.join(published.select(*SOURCE_KEY, "records"), SOURCE_KEY).filter(
        (F.col("n") > F.col("records")) | (F.col("least") < 0)).select(*SOURCE_KEY, F.col("field").alias("fault"))
    return plain.unionByName(annotated).unionByName(bad)


def quality_taxonomy(published: DataFrame) -> DataFrame:
    """Quality labels outside the agreed list."""
    labels = flatten_labels(published).filter(F.col("field") == "content_quality")
    return labels.filter(~F.col("value").isin(fixed.QUALITY_LABELS)).select("corpus", "source", "value", "records")


def several_domains(published: DataFrame) -> DataFrame:
    """Sources listed in more than one domain or with an unexpected id."""
    per = published.groupBy("source").agg(F.countDistinct("domain").alias("domains"))
    return per.filter((F.col("domains") > 1) | ~F.col("source").rlike(r"^[A-Za-z0-9_-]+$"))


def annotated_note(published: DataFrame, root: DataFrame) -> DataFrame:
    """How the stated corpus coverage relates to its sources' coverage."""
    per = published.groupBy("corpus").agg(
        F.count("*").alias("sources"), F.count("annotated").alias("known"), F.sum("annotated").alias("sum"))
    note = (
        F.when(F.col("stated").isNull(), "none published")
        .when(F.col("known") < F.col("sources"), "some unknown")
        .when(F.col("sum") != F.col("stated"), "differs")
        .otherwise("equal")
    )
    return per.join(root.select("corpus", F.col("annotated").alias("stated")), "corpus").select("corpus", note.alias("note"))


def vector_coverage(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records without a vector, vectors without a record, repeated, or not finite."""
    sides = uncovered(records, vectors).select(
        "record_no", F.when(F.col("only_in") == "left", "no vector").otherwise("no record").alias("fault"))
    twice = repeated(vectors.select("record_no"), ["record_no"]).select("record_no", F.lit("repeated").alias("fault"))
    broken = vectors.filter(~vec.is_finite(F.col("vec"))).select("record_no", F.lit("not finite").alias("fault"))
    return sides.unionByName(twice).unionByName(broken)


def usable_vectors(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records, vectors and usable vectors per source."""
    all_records = records.groupBy("source").agg(F.count("*").alias("records"))
    counted = vectors.groupBy("source").agg(
        F.count("*").alias("vectors"), F.count(F.when(vec.is_usable(F.col("vec")), 1)).alias("usable"))
    return all_records.join(counted, "source", "left").select(
        "source", "records", F.coalesce("vectors", F.lit(0)).alias("vectors"),
        F.coalesce("usable", F.lit(0)).alias("usable"))


def index_coverage(index: DataFrame, records: DataFrame) -> DataFrame:
    """Sources whose indexed records differ from the records that hold a word."""
    wordy = records.filter(F.col("token_count") > 0).select("record_no", "source")
    indexed = index.select("record_no").distinct()
    return wordy.join(indexed.withColumn("indexed", F.lit(1)), "record_no", "left").groupBy("source").agg(
        F.count("*").alias("expected"), F.count("indexed").alias("indexed"))


def boundary_numbers(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """First and last number of every source must be its span's borders."""
    edges = records.groupBy("source").agg(F.min("record_no").alias("first"), F.max("record_no").alias("last"))
    return edges.join(offsets.select("source", "offset", "records"), "source", "full").filter(
        ~F.col("first").eqNullSafe(F.col("offset"))
        | ~F.col("last").eqNullSafe(F.col("offset") + F.col("records") - 1)
    ).select("source", "first", "last")


def snapshot_differences(manifests: DataFrame) -> DataFrame:
    """``artefact, status, revision, records, fingerprint`` rows that disagree."""
    agreed = manifests.agg(
        F.countDistinct("revision").alias("revisions"), F.countDistinct("records").alias("counts"),
        F.countDistinct("fingerprint").alias("fingerprints"),
        F.count(F.when(F.col("status") != "ready", 1)).alias("unready"))
    return agreed.select(
        (F.col("revisions") == 1).alias("same_revision"), (F.col("counts") == 1).alias("same_count"),
        (F.col("fingerprints") == 1).alias("same_content"), (F.col("unready") == 0).alias("all_ready"))


def staleness(index: DataFrame, expected: DataFrame) -> DataFrame:
    """``ready``, ``stale`` or ``unavailable`` per expected artefact."""
    found = index.select("artefact", F.struct("status", "revision", "records", "fingerprint").alias("i"))
    state = (
        F.when(F.col("i").isNull(), "unavailable")
        .when((F.col("i.status") == "ready") & (F.col("i.revision") == F.col("revision"))
              & (F.col("i.records") == F.col("records")) & (F.col("i.fingerprint") == F.col("fingerprint")), "ready")
        .otherwise("stale")
    )
    return expected.join(found, "artefact", "left").select("artefact", state.alias("state"))


def token_counts(records: DataFrame) -> DataFrame:
    """Counts that are absent or outside 0..2^32."""
    bad = F.col("token_count").isNull() | (F.col("token_count") < 0) | (F.col("token_count") >= 2 ** 32)
    return records.filter(bad).select("record_no", "token_count")


def publication_gate(records: DataFrame, published: DataFrame, field: str, value: str) -> DataFrame:
    """Per corpus: do totals and one filtered count agree with the catalog?"""
    actual = records.groupBy("corpus").agg(
        F.count("*").alias("a_records"), F.sum("token_count").alias("a_tokens"),
        F.count(F.when(F.col(field) == value, 1)).alias("a_value"))
    label = F.coalesce(F.col("annotation_distributions")[field][value], F.lit(0))
    stated = published.groupBy("corpus").agg(
        F.sum("records").alias("records"), F.sum("tokens").alias("tokens"), F.sum(label).alias("value"))
    return actual.join(stated, "corpus", "full").select(
        "corpus",
        F.coalesce(F.col("a_records") == F.col("records"), F.lit(False)).alias("records_agree"),
        F.coalesce(F.col("a_tokens") == F.col("tokens"), F.lit(False)).alias("tokens_agree"),
        F.coalesce(F.col("a_value") == F.col("value"), F.lit(False)).alias("filtered_agree"))


def topic_faults(records: DataFrame, assignments: DataFrame, vectors: DataFrame, topics: list[int]) -> DataFrame:
    """Vectors without assignment, repeated or unknown topics, similarity out of
    range, zero vectors with a topic."""
    missing = uncovered(vectors, assignments).select("record_no", F.lit("coverage").alias("fault"))
    twice = repeated(assignments.select("record_no"), ["record_no"]).select("record_no", F.lit("repeated").alias("fault"))
    unknown = assignments.filter(~F.col("topic_id").isin([-1, *topics])).select("record_no", F.lit("topic").alias("fault"))
    range_ = assignments.filter(
        F.isnan("topic_similarity") | (F.abs("topic_similarity") > 1.001)).select(
        "record_no", F.lit("similarity").alias("fault"))
    zero = vectors.filter(~vec.is_usable(F.col("vec"))).select("record_no").join(
        assignments.filter(F.col("topic_id") != -1), "record_no", "left_semi").select(
        "record_no", F.lit("zero vector").alias("fault"))
    orphan = assignments.join(records.select("record_no"), "record_no", "left_anti").select(
        "record_no", F.lit("no record").alias("fault"))
    return reduce(DataFrame.unionByName, [missing, twice, unknown, range_, zero, orphan])


def verdict(checks: dict[str, DataFrame]) -> DataFrame:
    """Number of offending rows per check, as one small table."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("faults")).select(F.lit(name).alias("check"), "faults")
        for name, df in checks.items()
    ])
