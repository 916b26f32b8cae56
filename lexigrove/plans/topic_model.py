"""The whole topic job: sample, fit, reduce, assign everything, name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lexigrove import fixed
from lexigrove.operators import encoding, topics
from lexigrove.session import checkpointed, settle


@dataclass
class TopicModel:
    labelled: DataFrame
    centroids: DataFrame
    assignments: DataFrame
    points: DataFrame
    keywords: DataFrame


def sample_texts(records: DataFrame, labelled: DataFrame) -> DataFrame:
    """Texts of the sample. A checkpoint has no known size; settled keys have one, so a small sample does not shuffle all texts."""
    return records.join(settle(labelled.select("record_no")), "record_no", "left_semi").select("record_no", "text")


def build(records: DataFrame, vectors: DataFrame, vocabulary: DataFrame, clusters: int = 64,
          per_source: int = fixed.TOPIC_SAMPLE_PER_SOURCE, most: int = fixed.TOPIC_MAX,
          min_cluster: int = fixed.TOPIC_MIN_CLUSTER) -> TopicModel:
    """Texts are read for the sample only; every vector is assigned."""
    size = encoding.dimensions(vectors)
    sample = checkpointed(topics.fit_sample(vectors, per_source))
    labelled = topics.fit(sample, clusters, min(5, size), min_cluster)
    labelled = checkpointed(topics.reduce_topics(labelled, size, most))
    centers = topics.centroids(labelled, size)
    texts = sample_texts(records, labelled)
    terms = checkpointed(topics.sample_terms(texts))
    vocab = topics.term_selection(terms, labelled.count(), vocabulary)
    kept = terms.join(vocab.select("term"), "term", "left_semi")
    return TopicModel(
        labelled, centers, topics.assign_all(vectors, centers), topics.map_points(sample),
        topics.keywords(kept, labelled))
