"""Topics: balanced sample, fit, centroids, assignment of every record, keywords."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from lexigrove import fixed
from lexigrove.functions import text as text_fn, vectors as vec
from lexigrove.operators import numbering, selection, similarity
from lexigrove.session import checkpointed, local_table, settle


def fit_sample(vectors: DataFrame, per_source: int = fixed.TOPIC_SAMPLE_PER_SOURCE,
               seed: int = fixed.SEED) -> DataFrame:
    """A source-balanced sample of usable vectors. Only keys are ranked; the
    vectors are joined to the chosen keys afterwards."""
    usable = vectors.filter(vec.is_usable(F.col("vec")))
    keys = numbering.sample_per_group(usable.select("record_no", "source"), "source", "record_no", per_source, seed)
    return usable.join(keys.select("record_no"), "record_no", "left_semi")


def term_selection(terms: DataFrame, texts: int, known: DataFrame, min_df: int = fixed.TOPIC_MIN_DF,
                   max_share: float = fixed.TOPIC_MAX_DF_SHARE, size: int | None = None) -> DataFrame:
    """Terms neither rare nor everywhere and known to the encoder; with ``size`` only the most frequent ones."""
    totals = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    kept = totals.filter((F.col("df") >= min_df) & (F.col("df") <= max_share * texts))
    frequent = kept if size is None else kept.orderBy(F.desc("cf"), F.asc("term")).limit(size)
    return frequent.join(known.select(F.col("word").alias("term")), "term", "left_semi")


def sample_terms(texts: DataFrame, stop_words: Sequence[str] = fixed.TOPIC_STOP_WORDS) -> DataFrame:
    """``record_no, text`` → term counts per record, on the excerpt the fit reads."""
    tokens = texts.select(
        "record_no", text_fn.topic_terms(text_fn.excerpt(F.col("text")), stop_words).alias("w"))
    return tokens.select("record_no", F.explode(text_fn.term_counts(F.col("w"))).alias("t")).select(
        "record_no", "t.term", "t.tf")


def fit(sample: DataFrame, topics: int = 64, components: int = 5, min_cluster: int = fixed.TOPIC_MIN_CLUSTER,
        seed: int = fixed.SEED) -> DataFrame:
    """Clusters of the sample in a reduced space; small clusters are noise (-1)."""
    features = sample.withColumn("features", array_to_vector(vec.normalised(F.col("vec"))))
    reduced = PCA(k=components, inputCol="features", outputCol="low").fit(features).transform(features)
    model = KMeans(k=topics, seed=seed, maxIter=30, featuresCol="low", predictionCol="cluster").fit(reduced)
    labelled = model.transform(reduced).select(*sample.columns, F.col("cluster").cast("long").alias("cluster"))
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    big = settle(sizes.filter(F.col("n") >= min_cluster).select("cluster"))
    return labelled.join(big.withColumn("topic_id", F.col("cluster")), "cluster", "left").withColumn(
        "topic_id", F.coalesce("topic_id", F.lit(-1).cast("long"))).drop("cluster")


def centroids(labelled: DataFrame, size: int, label: str = "topic_id") -> DataFrame:
    """Mean vector per topic without noise, unit length."""
    means = labelled.filter(F.col(label) >= 0).groupBy(label).agg(*[
        F.avg(F.get("vec", F.lit(i))).alias(f"d{i}") for i in range(size)
    ])
    return means.select(label, vec.normalised(F.array(*[f"d{i}" for i in range(size)])).alias("vec"))


def reduce_topics(labelled: DataFrame, size: int, most: int = fixed.TOPIC_MAX) -> DataFrame:
    """Merges the closest pair of topics until at most ``most`` remain.

    The number of fitted clusters is fixed beforehand, so the pair table stays small.
    """
    ids, rows = similarity.small_table(centroids(labelled, size), "topic_id")
    sizes = {r["topic_id"]: r["n"] for r in
             labelled.groupBy("topic_id").agg(F.count("*").alias("n")).collect()}
    members = {t: [t] for t in ids}
    sums = {t: np.asarray(v) * sizes[t] for t, v in zip(ids, rows)}
    while len(members) > most:
        keys = sorted(members)
        unit = np.stack([sums[k] / max(np.linalg.norm(sums[k]), 1e-12) for k in keys])
        close = unit @ unit.T
        np.fill_diagonal(close, -np.inf)
        a, b = divmod(int(close.argmax()), len(keys))
        keep, gone = keys[min(a, b)], keys[max(a, b)]
        members[keep] += members.pop(gone)
        sums[keep] = sums[keep] + sums.pop(gone)
    pairs = [(old, new) for new, olds in members.items() for old in olds]
    if not pairs:
        return labelled
    names = local_table(labelled.sparkSession, pairs, "topic_id bigint, merged bigint")
    return labelled.join(names, "topic_id", "left").withColumn(
        "topic_id", F.coalesce("merged", "topic_id")).drop("merged")


def assign_all(vectors: DataFrame, topic_centroids: DataFrame) -> DataFrame:
    """Every record to its best topic; zero vectors keep topic -1."""
    assigned = similarity.assign(vectors, topic_centroids, "topic_id")
    return assigned.select("record_no", "topic_id", F.col("similarity").alias("topic_similarity"))


def assign_records(records: DataFrame, vectors: DataFrame, topic_centroids: DataFrame) -> DataFrame:
    """One assignment per record; records without a vector get topic -1 too."""
    found = assign_all(vectors, topic_centroids)
    return records.select("record_no").join(found, "record_no", "left").select(
        "record_no", F.coalesce("topic_id", F.lit(-1).cast("long")).alias("topic_id"),
        F.coalesce("topic_similarity", F.lit(0.0)).alias("topic_similarity"))


def keywords(terms: DataFrame, labels: DataFrame, count: int = fixed.TOPIC_KEYWORDS) -> DataFrame:
    """c-TF-IDF (Grootendorst 2022) keywords per topic.

    ``terms`` is ``record_no, term, tf`` of the sample, ``labels`` its topics.
    Class-term counts are summed before anything else, so the rest works on a
    table of topics × vocabulary.
    """
    classes = terms.join(labels.select("record_no", "topic_id"), "record_no").groupBy("topic_id", "term").agg(
        F.sum("tf").alias("tf"))
    classes = checkpointed(classes)
    overall = classes.groupBy("term").agg(F.sum("tf").alias("all_tf"))
    lengths = classes.groupBy("topic_id").agg(F.sum("tf").alias("size"))
    mean = lengths.agg(F.avg("size")).scalar()
    scored = (
        classes.filter(F.col("topic_id") >= 0).join(overall, "term").join(lengths, "topic_id")
        .select("topic_id", F.col("term").alias("word"), F.round(
            F.col("tf") / F.col("size") * F.log(1 + mean / F.col("all_tf")), 5).alias("score"))
    )
    rank = F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("score"), F.asc("word")))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= count)


def names(topic_keywords: DataFrame) -> DataFrame:
    """Name and keyword list per topic."""
    listed = topic_keywords.groupBy("topic_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    words = F.transform("w", lambda s: s["word"])
    return listed.select(
        "topic_id", F.array_join(F.slice(words, 1, 3), " · ").alias("name"), words.alias("keywords"))


def manifest(labelled: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per topic: sample members and assigned records (noise and unassigned under -1)."""
    fitted = labelled.groupBy("topic_id").agg(F.count("*").alias("fit_records"))
    whole = assignments.groupBy("topic_id").agg(F.count("*").alias("records"))
    return fitted.join(whole, "topic_id", "full").select(
        "topic_id", F.coalesce("fit_records", F.lit(0)).alias("fit_records"),
        F.coalesce("records", F.lit(0)).alias("records"))


def map_points(sample: DataFrame) -> DataFrame:
    """Two coordinates per sampled record."""
    features = sample.select("record_no", array_to_vector(vec.normalised(F.col("vec"))).alias("features"))
    placed = PCA(k=2, inputCol="features", outputCol="xy").fit(features).transform(features)
    xy = vector_to_array("xy")
    return placed.select(
        "record_no", F.round(F.get(xy, F.lit(0)), 4).alias("x"), F.round(F.get(xy, F.lit(1)), 4).alias("y"))


def distribution(records: DataFrame, assignments: DataFrame, filters: dict) -> DataFrame:
    """Records and tokens per topic under all filters but the topic filter, with their total."""
    base = selection.select(records, selection.without_topic(filters)).select("record_no", "token_count")
    groups = base.join(assignments, "record_no").groupBy("topic_id").agg(
        F.count("*").alias("records"), F.sum("token_count").alias("tokens"))
    groups = settle(groups)
    return groups.withColumn("base_records", groups.agg(F.sum("records")).scalar())


def view_points(records: DataFrame, points: DataFrame, assignments: DataFrame, filters: dict) -> DataFrame:
    """Map points that match every filter. The small point table leads the join."""
    chosen = selection.select(records, filters, assignments).select(
        "record_no", "source", "domain", "content_quality", "pii_presence")
    return points.join(chosen, "record_no").join(assignments.select("record_no", "topic_id"), "record_no")


def selected_count(records: DataFrame, assignments: DataFrame, filters: dict) -> DataFrame:
    return selection.select(records, filters, assignments).agg(F.count("*").alias("selected"))


def grouped_points(points: DataFrame, colour: str) -> DataFrame:
    """Points with the name of their colour group, the missing ones under their own.

    The points stay rows: no group is collected into one value.
    """
    key = F.coalesce(F.nullif(F.col(colour).cast("string"), F.lit("")), F.lit(fixed.MISSING))
    return points.select(key.alias("name"), "record_no", "x", "y")


def label_positions(points: DataFrame, least: int = fixed.TOPIC_LABEL_MIN_POINTS) -> DataFrame:
    """Upper median of both axes for topics with enough points.

    The median of the descending order is the element at ``n // 2`` of the
    ascending one. The aggregate counts equal values before the shuffle.
    """
    return points.filter(F.col("topic_id") >= 0).groupBy("topic_id").agg(
        F.count("*").alias("points"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x DESC)").alias("x"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY y DESC)").alias("y"),
    ).filter(F.col("points") >= least)
