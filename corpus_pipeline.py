"""A corpus from raw documents to a mixed training set, stage by stage.

Every stage takes the documents its predecessor kept; all but the last return
the columns of ``documents``.

Edge cases, for every stage: null and empty texts are kept as they are (they
have no words, lines or toxic parts); repeated rows are judged alike, and the
near-duplicate stage leaves one of them; a null doc_id counts as an id of its
own; a very long text is one row like others; an empty table stays empty;
further columns come through unchanged, also if they are named like a helper.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexigrove.llm import decontamination, jaccard_join, line_spread, mixing, toxicity  # noqa: E402
from lexigrove.llm.shared import remainder, table, unused, written  # noqa: E402

# Scores come from a trained model, so SQL cannot state the rows.
ORACLE_SQL = None

# --- fixed values: near copies of a corpus, looser than those of op10 ---
NEAR_WORDS = 5
NEAR_PERCENT = 80


def beside(docs: DataFrame, stage, *taken: str) -> DataFrame:
    """Runs a stage that adds columns named ``taken``; columns of the user with such names are set aside meanwhile."""
    clashing = [c for c in docs.columns if c.lower() in taken]
    aside = dict(zip(clashing, unused([*docs.columns, *taken], *clashing)))
    back = {v: k for k, v in aside.items()}
    done = stage(docs.withColumnsRenamed(aside))
    return done.select(*[F.col(aside.get(c, c)).alias(back.get(aside.get(c, c), c)) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))

    def stage(rows: DataFrame) -> DataFrame:
        scores, _ = toxicity.toxicity(rows, table(spark, sf_dir, "labels"), held_out)
        return scores.filter(F.col("score") < toxicity.THRESHOLD)

    return beside(docs, stage, "score")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def stage(rows: DataFrame) -> DataFrame:
        kept = line_spread.without_boilerplate(rows).withColumn("text", F.col("kept"))
        return kept.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType))

    return beside(docs, stage, "n_lines", "n_removed", "kept")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("n-gram jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
