"""Corpus tables derived from the given test tables, built once per session.

A service reads prepared tables, so the derived tables are written to the
shared folder on first use and read back with column pruning, pushed filters
and partition pruning. Nothing passes through the driver.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexigrove import fixed
from lexigrove.functions import text as text_fn, vectors as vec
from lexigrove.functions.labels import source_name
from lexigrove.operators import catalog, encoding, keyword, numbering, topics
from lexigrove.session import scratch, settle
from lexigrove.sources.sinks import write_partitioned

# --- fixed values: the derived corpus view -----------------------------------
DOMAINS = ["News", "Books", "Legal", "Web", "Conversation", "Other"]
UNPUBLISHED = ["fr"]
VERSION = "v1"

RECORD_SCHEMA = """
    record_no bigint, source_row bigint, doc_id bigint, id string, domain string,
    token_count bigint, text string, content_quality string, content_safety string,
    pii_presence string, content_length string, content_type array<string>,
    corpus string, source string, span bigint
"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def marked(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the labels some of them have."""
    marks = spark.read.parquet(f"{folder}/labels.parquet").withColumn("marked", F.lit(True))
    return documents(spark, folder).join(marks, "doc_id", "left")


def described(joined: DataFrame, *numbers: str) -> DataFrame:
    """Marked documents as corpus records, with the given number columns."""
    labelled = F.col("marked") & ~F.col("lang").isin(UNPUBLISHED)

    def when_labelled(value: Column) -> Column:
        return F.when(labelled, value)

    names = F.array(*[F.lit(d) for d in DOMAINS])
    return joined.withColumn("token_count", F.size(text_fn.words(F.col("text"))).cast("long")).select(
        *numbers, F.col("lang").alias("corpus"), "source", "text", "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.get(names, F.substring("source", 4, 9).cast("int") % len(DOMAINS)).alias("domain"),
        "token_count",
        when_labelled(F.when(F.col("quality") == 1, "good").otherwise("poor")).alias("content_quality"),
        when_labelled(F.when(F.col("toxic") == 1, "harmful").otherwise("safe")).alias("content_safety"),
        when_labelled(F.when(F.col("text").rlike(text_fn.EMAIL), "contains_pii").otherwise("no_pii"))
        .alias("pii_presence"),
        when_labelled(F.when(F.col("token_count") < 50, "minimal").when(F.col("token_count") < 500, "moderate")
                      .otherwise("substantial")).alias("content_length"),
        when_labelled(F.concat(
            F.when(F.col("quality") == 1, F.array(F.lit("prose"), F.lit("prose"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("toxic") == 1, F.array(F.lit("opinion"))).otherwise(F.array().cast("array<string>")),
        )).alias("content_type"),
    )


class Workspace:
    """Lazily built tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def records(self) -> DataFrame:
        """Numbered records, one folder per corpus, source and span of numbers."""
        path = scratch(self.spark, "records")
        # One shuffle by (source, range) numbers the rows and is also the layout of
        # the files: a dominant source is many ranges, hence many tasks and files,
        # each sorted by record number for page pruning.
        # Words are counted after that shuffle, where the rows are spread evenly.
        numbered = numbering.dense_numbers(marked(self.spark, self.folder), "source", "doc_id")
        write_partitioned(
            described(numbered, "record_no", "source_row").withColumn("span", numbering.span_of(F.col("record_no"))),
            path, ["corpus", "source", "span"], order="record_no", arranged=True)
        return self.spark.read.schema(RECORD_SCHEMA).parquet(path)

    @cached_property
    def postings(self) -> DataFrame:
        path = scratch(self.spark, "postings")
        keyword.write_postings(self.records, path)
        return keyword.read_postings(self.spark, path)

    @cached_property
    def term_stats(self) -> DataFrame:
        """Totals per term: of the stored postings where a query has them, else counted
        inside the records, so that a vocabulary alone sorts and stores no positions."""
        path = scratch(self.spark, "term-stats")
        counted = self.postings if "postings" in self.__dict__ else keyword.term_counts(self.records)
        keyword.write_term_stats(counted, path)
        return keyword.read_term_stats(self.spark, path)

    @cached_property
    def collection(self) -> dict:
        """Number of records and mean length."""
        return keyword.collection(self.records)

    @cached_property
    def sources(self) -> DataFrame:
        """Catalog rows per corpus and source (catalog-sized)."""
        return settle(catalog.catalog_sources(self.records, UNPUBLISHED))

    @cached_property
    def source_table(self) -> DataFrame:
        """Records and offset per source over all corpora."""
        counts = self.sources.groupBy("source", "domain").agg(
            F.sum("records").alias("records"), F.sum("tokens").alias("tokens"))
        return settle(numbering.source_offsets(counts).withColumn("name", source_name(F.col("source"))))

    @cached_property
    def vectors(self) -> DataFrame:
        """Vectors of records; some records have none."""
        e = self.spark.read.parquet(f"{self.folder}/embeddings.parquet")
        keys = self.records.select("doc_id", "record_no", "corpus", "source")
        joined = keys.join(e, F.col("doc_id") == F.col("vec_id"))
        rows = joined.select(
            "record_no", F.col("label").cast("long").alias("label"),
            vec.doubles(F.col("embedding")).alias("vec"), "corpus", "source", numbering.span_of(F.col("record_no")).alias("span"))
        path = scratch(self.spark, "vectors")
        write_partitioned(
            rows, path, ["corpus", "source", "span"], F.floor(F.col("record_no") / numbering.RANGE_WIDTH), "record_no")
        return self.spark.read.schema(rows.schema).parquet(path)

    @cached_property
    def raw_vocabulary(self) -> DataFrame:
        """Every word of the corpus with an unweighted vector: ranks take the given vectors in turn."""
        ranked = numbering.ordered(self.term_stats.select("term", "cf"), F.desc("cf"), F.asc("term"))
        e = self.spark.read.parquet(f"{self.folder}/embeddings.parquet").select("vec_id", "embedding")
        given = numbering.ordered(e, "vec_id", name="turn")
        count = max(e.count(), 1)
        return ranked.join(given, F.col("place") % count == F.col("turn")).select(
            F.col("term").alias("word"), (F.col("place") + 1).alias("rank"), vec.doubles(F.col("embedding")).alias("raw"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self._stored(encoding.weighted_vocabulary(self.raw_vocabulary), "vocabulary")

    @cached_property
    def labelled(self) -> DataFrame:
        """The balanced sample with its cluster labels."""
        return self._stored(topics.fit_sample(self.vectors).withColumn("topic_id", F.col("label")), "labelled")

    @cached_property
    def topic_centers(self) -> DataFrame:
        return settle(topics.centroids(self.labelled, encoding.dimensions(self.vectors)))

    @cached_property
    def assignments(self) -> DataFrame:
        return self._stored(topics.assign_records(self.records, self.vectors, self.topic_centers), "assignments")

    @cached_property
    def points(self) -> DataFrame:
        return self.labelled.select(
            "record_no", F.round(F.get("vec", F.lit(0)), 4).alias("x"), F.round(F.get("vec", F.lit(1)), 4).alias("y"))

    @cached_property
    def sample_texts(self) -> DataFrame:
        return self.records.select("record_no", "text").join(self.labelled.select("record_no"), "record_no", "left_semi")

    @cached_property
    def topic_terms(self) -> DataFrame:
        return self._stored(topics.sample_terms(self.sample_texts), "topic-terms")

    @cached_property
    def topic_vocabulary(self) -> DataFrame:
        return settle(topics.term_selection(self.topic_terms, self.labelled.count(), self.vocabulary))

    @cached_property
    def topic_keywords(self) -> DataFrame:
        kept = self.topic_terms.join(self.topic_vocabulary.select("term"), "term", "left_semi")
        return settle(topics.keywords(kept, self.labelled))

    @cached_property
    def encoded(self) -> DataFrame:
        """Document vectors of whole texts, in folders like the records. Built from
        texts, not from postings: there a record's words lie together."""
        keys = self.records.select("record_no", "corpus", "source", "span", "text")
        rows = encoding.encode_documents(keys, self.vocabulary, keep=["corpus", "source", "span"])
        path = scratch(self.spark, "encoded")
        # Rows come from a join when the vocabulary is over its bound: each task would write into every folder.
        write_partitioned(rows, path, ["corpus", "source", "span"], order="record_no")
        return self.spark.read.schema(rows.schema).parquet(path)

    @cached_property
    def index(self):
        from lexigrove.plans.search import build_index

        return build_index(self.vectors, scratch(self.spark, "cells"), records=self.records)

    @cached_property
    def encoded_index(self):
        """The index over document vectors, which semantic searches use."""
        from lexigrove.plans.search import build_index

        return build_index(self.encoded, scratch(self.spark, "encoded-cells"), records=self.records)

    @cached_property
    def fitted(self):
        from lexigrove.plans.topic_model import build

        return build(self.records, self.vectors, self.vocabulary, clusters=32, min_cluster=10)

    @cached_property
    def tag_writes(self) -> DataFrame:
        """Review tag writes; the event kind that stands for removal is empty."""
        events = self.spark.read.parquet(f"{self.folder}/events.parquet")
        total = self.records.count()
        return events.select(
            (F.col("event_id") % total).alias("record_no"),
            F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("tag"),
            F.col("ts").alias("saved_at"), "event_id")


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder)
    return _OPEN[key]
