"""Keyword search on a postings table.

``postings(term, record_no, tf, dl, positions)`` is written in folders by term hash, so a
query opens only the folders of its own words; inside a folder the rows are
spread by record range, so a very common word is still read by many tasks.
Scores follow BM25 (Robertson and Zaragoza 2009) with exact lengths.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexigrove import fixed
from lexigrove.functions import text as text_fn
from lexigrove.operators import browse
from lexigrove.operators.numbering import RANGE_WIDTH
from lexigrove.session import local_table

TERM_FOLDERS = 64
POSTING_SCHEMA = "term string, record_no bigint, tf bigint, dl bigint, positions array<int>, folder int"
SCORE_DIGITS = 6


def term_folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_FOLDERS)).cast("int")


def postings(records: DataFrame) -> DataFrame:
    """Inverted index rows. Words are counted inside each record, so building
    them moves nothing between tasks. The length is taken before the words are
    spread: otherwise every row would carry its record's whole word list."""
    tokens = records.select("record_no", text_fn.words(F.col("text")).alias("tokens"))
    sized = tokens.select("record_no", F.size("tokens").cast("long").alias("dl"), "tokens")
    placed = sized.select("record_no", "dl", F.explode(text_fn.term_positions(F.col("tokens"))).alias("t"))
    return placed.select(
        "t.term", "record_no", F.size("t.positions").cast("long").alias("tf"), "dl", "t.positions")


def term_counts(records: DataFrame) -> DataFrame:
    """The postings without lengths and positions, for totals that need no index."""
    tokens = records.select("record_no", text_fn.words(F.col("text")).alias("tokens"))
    return tokens.select("record_no", F.explode(text_fn.term_counts(F.col("tokens"))).alias("t")).select(
        "t.term", "record_no", "t.tf")


def write_postings(records: DataFrame, path: str) -> None:
    # Files of one source and span differ much in size; texts dealt out by number
    # make tasks of like length, and more of them where there are more texts.
    texts = records.select("record_no", "text").repartition("record_no")
    # A frequency is the size of its positions, so it is not moved with them.
    (
        postings(texts).select("term", "record_no", "dl", "positions", term_folder(F.col("term")).alias("folder"))
        .repartition("folder", F.floor(F.col("record_no") / RANGE_WIDTH))
        .sortWithinPartitions("folder", "term", "record_no")
        .select("term", "record_no", F.size("positions").cast("long").alias("tf"), "dl", "positions", "folder")
        .write.option("compression", "zstd").partitionBy("folder").parquet(path)
    )


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTING_SCHEMA).parquet(path)


def for_terms(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Postings of some words; names the folders so that others are not opened."""
    wanted = index.filter(F.col("term").isin(list(terms)))
    if "folder" not in index.columns:
        return wanted
    spark = index.sparkSession
    folders = local_table(spark, [(t,) for t in terms], "term string").select(term_folder(F.col("term")).alias("f"))
    return wanted.filter(F.col("folder").isin(sorted({r["f"] for r in folders.collect()})))


def term_totals(index: DataFrame) -> DataFrame:
    """Document and collection frequency per term; partial sums before the shuffle."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def write_term_stats(index: DataFrame, path: str) -> None:
    """Term totals in the same folders as the postings."""
    (
        term_totals(index).withColumn("folder", term_folder(F.col("term")))
        .repartition("folder").sortWithinPartitions("folder", "term")
        .write.option("compression", "zstd").partitionBy("folder").parquet(path)
    )


def read_term_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, df bigint, cf bigint, folder int").parquet(path)


def collection(records: DataFrame) -> dict:
    """Number of records and mean length, from one metadata column."""
    return records.agg(F.count("*").alias("n"), F.avg("token_count").alias("avg_dl")).first().asDict()


def bm25(index: DataFrame, term_stats: DataFrame, size: dict, terms: Sequence[str],
         allowed: DataFrame | None = None, require_all: bool = False) -> DataFrame:
    """Scores of every record with at least one (or every) query word.

    A metadata filter (``allowed``) decides which records may match. It changes
    no score: frequencies and lengths are those of the whole collection. Both
    come from stored tables; only the postings of the query words are read.
    """
    hits = for_terms(index, terms)
    frequencies = {r["term"]: r["df"] for r in for_terms(term_stats, terms).select("term", "df").collect()}
    if not frequencies:
        return index.select("record_no", F.lit(0.0).alias("score")).limit(0)
    weight = F.lit(0.0)
    for term, df in frequencies.items():
        idf = F.log(F.lit(1.0) + (F.lit(float(size["n"])) - df + 0.5) / (df + 0.5))
        weight = F.when(F.col("term") == term, idf).otherwise(weight)
    k1, b = fixed.BM25_K1, fixed.BM25_B
    saturation = F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(size["avg_dl"])))
    if allowed is not None:
        hits = hits.join(allowed.select("record_no"), "record_no", "left_semi")
    scored = hits.groupBy("record_no").agg(
        F.round(F.sum(weight * saturation), SCORE_DIGITS).alias("score"),
        F.count("*").alias("matched"))
    if require_all:
        scored = scored.filter(F.col("matched") == len(set(terms)))
    return scored.select("record_no", "score")


def best(scored: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Score descending, record number ascending; each task keeps a heap."""
    return scored.orderBy(F.desc("score"), F.asc("record_no")).offset(offset).limit(limit)


def search_page(scored: DataFrame, offset: int, limit: int = fixed.PAGE_SIZE) -> DataFrame:
    """One page of hits with the exact total and paging state in each row."""
    rows = ranked(best(scored, offset + limit)).filter(F.col("rank") > offset)
    count = scored.agg(F.count("*").alias("total")).scalar()
    return rows.withColumn("total", count).select(
        "rank", "record_no", "score", "total",
        (F.least(F.lit(offset + limit), F.col("total")) < F.col("total")).alias("has_more"),
        F.least(F.lit(offset + limit), F.col("total")).cast("long").alias("next_offset"),
    )


def ranked(top: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1. Only for a bounded result such as a page or top list."""
    order = W.orderBy(F.desc("score"), F.asc("record_no"))
    return top.withColumn("rank", F.row_number().over(order).cast("long"))


def with_snippets(top: DataFrame, records: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Hits with an extract of their texts, read after the ranking is final."""
    return browse.enrich(top, records, ["source", "id", "text"]).select(
        "record_no", "source", "id", "score",
        text_fn.preview_snippet(F.col("text"), terms).alias("preview"))


@dataclass
class Asked:
    """A query's single words and its quoted phrases."""

    words: list[str]
    phrases: list[list[str]]

    @property
    def terms(self) -> list[str]:
        return list(dict.fromkeys([*self.words, *(t for p in self.phrases for t in p)]))


def parse(text: str) -> Asked:
    """Words and phrases in double quotes; a phrase of one word is a word."""
    parts = text.split('"')
    if len(parts) % 2 == 0:
        raise ValueError("a quoted phrase has no end")
    rows = local_table(SparkSession.active(), [(i, p) for i, p in enumerate(parts)], "i int, q string").select(
        "i", text_fn.words(F.col("q")).alias("w")).collect()
    found = [list(r["w"]) for r in sorted(rows, key=lambda r: r["i"])]
    words = [w for i, part in enumerate(found) for w in part if i % 2 == 0 or len(part) == 1]
    return Asked(list(dict.fromkeys(words)), [p for i, p in enumerate(found) if i % 2 and len(p) > 1])


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: (p - by).cast("int"))


def _places(asked: Asked, phrase: Sequence[str]) -> Column:
    """Starts of a phrase in one record from its words' position columns: shifted lists, intersected."""
    at = [F.col(f"at{asked.terms.index(t)}") for t in phrase]
    starts = at[0]
    for k, positions in enumerate(at[1:], 1):
        starts = F.array_intersect(starts, _shifted(positions, k))
    return F.coalesce(F.size(starts), F.lit(0))


def _gathered(index: DataFrame, asked: Asked, allowed: DataFrame | None) -> DataFrame:
    """One row per record with any asked word: its length, frequencies and the positions of words in phrases.

    The row is as wide as the query; nothing is exploded and only one group by record is needed.
    """
    hits = for_terms(index, asked.terms)
    if allowed is not None:
        hits = hits.join(allowed.select("record_no"), "record_no", "left_semi")
    inside = {t for p in asked.phrases for t in p}
    return hits.groupBy("record_no").agg(
        F.max("dl").alias("dl"),
        *[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(asked.terms)],
        *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"at{i}") for i, t in enumerate(asked.terms) if t in inside])


def phrase(index: DataFrame, terms: Sequence[str], allowed: DataFrame | None = None) -> DataFrame:
    """Records that contain the words next to each other, with the number of places, from the index alone."""
    asked = Asked([], [list(terms)])
    return _gathered(index, asked, allowed).select("record_no", _places(asked, terms).cast("long").alias("places")).filter("places > 0")


def scores(index: DataFrame, term_stats: DataFrame, size: dict, asked: Asked,
           allowed: DataFrame | None = None, require_all: bool = False) -> DataFrame:
    """BM25 over words and phrases.

    A phrase counts as one word that occurs at its places and weighs what its
    words weigh together. A filter decides which records may match and changes
    no score. With ``require_all`` every word and phrase must occur.
    """
    if not asked.phrases:
        return bm25(index, term_stats, size, asked.words, allowed, require_all)
    frequencies = {r["term"]: r["df"] for r in for_terms(term_stats, asked.terms).select("term", "df").collect()}

    def idf(term: str) -> float:
        df = frequencies.get(term, 0)
        return math.log(1 + (size["n"] - df + 0.5) / (df + 0.5))

    k1, b = fixed.BM25_K1, fixed.BM25_B
    rows = _gathered(index, asked, allowed).select("record_no", "dl", F.array(
        *[F.struct(F.coalesce(f"tf{i}", F.lit(0)).cast("double").alias("tf"), F.lit(idf(t)).alias("w"))
          for i, t in enumerate(asked.terms) if t in asked.words],
        *[F.struct(_places(asked, p).cast("double").alias("tf"), F.lit(sum(map(idf, p))).alias("w")) for p in asked.phrases]).alias("parts"))
    length = k1 * (1 - b + b * F.col("dl") / F.lit(size["avg_dl"]))
    score = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["w"] * p["tf"] * (k1 + 1) / (p["tf"] + length))
    met = F.forall if require_all else F.exists
    return rows.filter(met("parts", lambda p: p["tf"] > 0)).select("record_no", F.round(score, SCORE_DIGITS).alias("score"))


def document_stats(index: DataFrame, size: dict) -> DataFrame:
    """Per term: df, cf, idf over the whole collection."""
    n = F.lit(float(size["n"]))
    return term_totals(index).select(
        "term", "df", "cf",
        F.round(F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)), SCORE_DIGITS).alias("idf"))
