"""Line deduplication by the number of distinct sites a line occurs on.

A HyperLogLog sketch of sites per line hash, merged by aggregation, estimates
the spread. Lines whose estimate lies near the threshold get exact distinct
counts. Lines on ``min_sites`` sites or more are boilerplate and are removed
from every document; without a given number it is half of the corpus's sites,
``LEAST_SITES`` at least.

A line is a part between newlines, compared without spaces at its ends; blank
lines are never boilerplate. Line hashes have 128 bits.

Edge cases: a null source is no site; a null text stays null with no lines, an
empty text has one blank line; repeated rows give the same result for each; a
document of boilerplate only keeps its row with the lines that are left; a very long text
is split inside its row; an empty table gives an empty result. Columns of the
documents stay, save those named like the results (n_lines, n_removed, kept).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexigrove.llm.shared import unused

SITE_SHARE = 2
LEAST_SITES = 3
SKETCH_LOG_SIZE = 12
# Relative width of the zone around the threshold that is counted exactly; the
# sketches' standard error is 1.6 %, so this is far outside their noise.
NEAR = 0.25


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_keys(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: document, place, site and line hash."""
    return (docs.select(*_document_key(), "source", F.posexplode(lines(F.col("text"))).alias("place", "line"))
            .withColumn("line", F.trim("line")).filter("line <> ''")
            .select("id", "version", "place", "source", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))


def _document_key() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("version")]


def threshold(docs: DataFrame) -> int:
    """Half of the named sites of all documents, but not fewer than ``LEAST_SITES``."""
    sites = docs.agg(F.countDistinct("source").alias("n")).first()["n"]
    return max(LEAST_SITES, -(-sites // SITE_SHARE))


def boilerplate(keys: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` sites."""
    spread = keys.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", SKETCH_LOG_SIZE)).alias("about"))
    clear = spread.filter(F.col("about") > min_sites * (1 + NEAR)).select("h1", "h2")
    near = spread.filter(F.col("about").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("h1", "h2")
    exact = (keys.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "source").distinct()
             .groupBy("h1", "h2").agg(F.count("source").alias("sites")).filter(F.col("sites") >= min_sites).select("h1", "h2"))
    return clear.unionByName(exact)


def without_boilerplate(docs: DataFrame, min_sites: int | None = None) -> DataFrame:
    """The documents with ``n_lines``, ``n_removed`` and the text that is left as ``kept``."""
    min_sites = threshold(docs) if min_sites is None else min_sites
    keys = _line_keys(docs)
    found = keys.drop("source").join(boilerplate(keys, min_sites), ["h1", "h2"])
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "kept")]
    *key, gone = unused(docs.columns, "_id", "_version", "_places")
    places = found.groupBy("id", "version").agg(F.collect_set("place").alias(gone)).withColumnsRenamed(dict(zip(("id", "version"), key)))
    return (docs.select(*own, *[c.alias(n) for c, n in zip(_document_key(), key)])
            .join(places, key, "left").select(*own, *_counted(F.col("text"), F.col(gone))))


def _counted(text: Column, places: Column) -> list[Column]:
    left = F.filter(lines(text), lambda line, place: ~F.array_contains(places, place))
    return [F.when(text.isNull(), 0).otherwise(F.size(lines(text))).cast("long").alias("n_lines"),
            F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_removed"),
            F.when(places.isNull(), text).otherwise(F.array_join(left, "\n")).alias("kept")]
