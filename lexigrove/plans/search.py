"""Search jobs: exact and index-backed semantic search, hybrid ranking, pages."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lexigrove import fixed
from lexigrove.functions import text as text_fn
from lexigrove.operators import browse, encoding, keyword, selection, similarity
from lexigrove.session import settle

# Vectors to fit the cells on, and the share of sampled vectors that must find themselves through the index.
SAMPLE_SIZE = 160_000
LEAST_RECALL = 0.9


@dataclass
class VectorIndex:
    """Tables of the partitioned index and whether they match the corpus.

    ``centroids``: cell, vec and the smallest cosine of a member; ``cells``: the
    coded vectors, one folder per cell; ``zones``: rows per cell, source and domain.
    """

    centroids: DataFrame
    cells: DataFrame
    low: list[float]
    high: list[float]
    zones: DataFrame | None = None
    ready: bool = True


@dataclass
class Found:
    """Best records, the cells opened for them and the cells there are."""

    rows: DataFrame
    opened: int
    cells: int


def check_query(text: str, most: int = 250) -> str:
    if not 2 <= len(text) <= most:
        raise ValueError("Invalid query length")
    return text


def build_index(vectors: DataFrame, path: str, sample_size: int = SAMPLE_SIZE, cells: int | None = None,
                records: DataFrame | None = None, least_recall: float = LEAST_RECALL) -> VectorIndex:
    """Train on a sample, assign and code every usable vector, write by cell, test by self-retrieval.

    ``records`` (record_no, domain) adds the zone map by source and domain. An
    index whose sampled vectors do not find themselves is refused.
    """
    spark = vectors.sparkSession
    total = similarity.compared(vectors).first()["compared"]
    sample = settle(similarity.training_sample(vectors, sample_size))
    wanted = cells or similarity.cell_count(total)
    centroids = similarity.train_cells(sample, similarity.fit_cell_count(wanted, min(sample_size, total)))
    size = encoding.dimensions(vectors)
    low, high = similarity.dimension_bounds(vectors, size)
    similarity.write_cells(similarity.quantize(similarity.assign(vectors, centroids), low, high), path)
    stored = similarity.read_cells(spark, path)
    # Only cells with members are probed.
    reach = stored.groupBy("cell").agg(F.min("similarity").alias("least"))
    zones = None
    if records is not None:
        placed = stored.select("cell", "source", "record_no").join(records.select("record_no", "domain"), "record_no")
        zones = settle(placed.groupBy("cell", "source", "domain").agg(F.count("*").alias("records")))
    index = VectorIndex(settle(centroids.join(reach, "cell")), stored, low, high, zones)
    row = similarity.self_retrieval(vectors, index).first()
    if row["queries"] and row["recall"] < least_recall:
        raise ValueError(f"the index finds only {row['recall']:.0%} of sampled vectors again")
    return index


def cells_of(index: VectorIndex, condition: Column) -> list[int]:
    """Cells with records in the sources and domains that a condition allows."""
    if index.zones is None:
        raise ValueError("this index has no zone map")
    return sorted(r["cell"] for r in index.zones.filter(condition).select("cell").distinct().collect())


def index_candidates(index: VectorIndex, query: list[float], allowed: DataFrame | None, probes: int | None = None,
                     limit: int = fixed.IVF_CANDIDATES, cells: list[int] | None = None) -> DataFrame:
    """Best coded scores in the ``probes`` nearest cells (all by default) or in those of ``cells`` among them."""
    score = similarity.decoder(query, index.low, index.high)(F.col("code"))
    chosen = similarity.probed(query, similarity.small_table(index.centroids), probes)
    if cells is not None:
        chosen = [c for c in chosen if c in set(cells)]
    return similarity.candidates(index.cells, score, chosen, allowed, limit)


def bounded_candidates(index: VectorIndex, vectors: DataFrame, query: list[float], allowed: DataFrame | None = None,
                       limit: int = fixed.RERANK_CANDIDATES, digits: int = similarity.SCORE_DIGITS,
                       cells: list[int] | None = None, first_probes: int = 8) -> Found:
    """The exact best records, opening cells only while one of them may still hold one.

    A cell's members lie within an angle of its centroid, so its best possible
    cosine is known. Cells are opened from the best bound on, in growing rounds,
    until the last place's score, less the loss of the codes, beats the bounds of
    all cells left. Everything within that loss of the last place is scored from
    the original vectors.
    """
    unit = np.asarray(query, dtype=np.float64) / max(float(np.linalg.norm(query)), 1e-12)
    order, bounds = similarity.cell_bounds(unit, index.centroids, cells)
    score = similarity.decoder(unit, index.low, index.high)(F.col("code"))
    loss = similarity.code_loss(unit, index.low, index.high) + 10.0 ** -min(digits, 6)
    best: list[float] = []
    opened, step = 0, first_probes
    least = -2.0

    def scored(some: list[int]) -> DataFrame:
        return similarity.allowed_only(index.cells.filter(F.col("cell").isin(some)), allowed).select("record_no", score.alias("score"))

    while opened < len(order):
        part = order[opened:opened + step]
        best = sorted(best + [r["score"] for r in similarity.top(scored(part), limit).collect()], reverse=True)[:limit]
        opened, step = opened + len(part), 2 * step
        if len(best) == limit:
            least = best[-1] - loss
            if opened < len(order) and bounds[opened] < least:
                break
    close = scored(order[:opened]).filter(F.col("score") >= least - loss)
    return Found(similarity.rescored(close, vectors, query, limit, digits), opened, len(order))


def check_method(method: str, index: VectorIndex | None) -> str:
    """The caller chooses: all vectors (``exact``) or the cells of a current index (``index``)."""
    if method not in ("exact", "index"):
        raise ValueError(f"there is no search method {method!r}")
    if method == "index" and (index is None or not index.ready):
        raise ValueError("a search by index needs an index of the current corpus")
    return method


def semantic_candidates(vectors: DataFrame, query: list[float], allowed: DataFrame | None,
                        index: VectorIndex | None, limit: int = fixed.RERANK_CANDIDATES,
                        digits: int = similarity.SCORE_DIGITS, method: str = "exact") -> DataFrame:
    """The same records by both methods: the index opens fewer cells."""
    if check_method(method, index) == "exact":
        return similarity.top(similarity.exact_scores(vectors, query, allowed, digits), limit)
    return bounded_candidates(index, vectors, query, allowed, limit, digits).rows


@dataclass
class Results:
    """A ranked list (record_no, score) and the number of records it was chosen from."""

    rows: DataFrame
    compared: int


def hybrid(vectors: DataFrame, records: DataFrame, vocabulary: DataFrame, text: str,
           allowed: DataFrame | None = None, index: VectorIndex | None = None,
           candidates: int = fixed.RERANK_CANDIDATES, keep: int = fixed.MAX_RESULTS, method: str = "exact") -> Results:
    """Candidates by document cosine, reranked with concept coverage.

    Only the texts of the candidates are read, from their span folders.
    """
    query = encoding.query_of(check_query(text), vocabulary)
    if query is None:
        raise ValueError("No word of the query is in the vocabulary")
    found = settle(semantic_candidates(vectors, query.vector(), allowed, index, candidates, digits=12, method=method))
    texts = browse.lookup(records, found).select("record_no", text_fn.words(F.col("text")).alias("tokens"))
    blended = found.join(encoding.concept_coverage(texts, query, vocabulary), "record_no").select(
        "record_no", F.round(
            fixed.COSINE_WEIGHT * F.col("score") + fixed.COVERAGE_WEIGHT * F.col("coverage"), 6).alias("score"))
    return Results(settle(keyword.best(blended, keep)), similarity.compared(vectors, allowed).first()["compared"])


def semantic_page(results: Results, records: DataFrame, offset: int, limit: int = fixed.PAGE_SIZE) -> DataFrame:
    """A slice of the ranked list with metadata and the paging state."""
    browse.check_page(offset, limit)
    count = results.rows.count()
    end = min(offset + limit, count)
    page = keyword.ranked(results.rows).filter((F.col("rank") > offset) & (F.col("rank") <= end)).select(
        "*", F.lit(count).cast("long").alias("total"), F.lit(results.compared).cast("long").alias("compared"),
        F.lit(end < count).alias("has_more"), F.lit(end).cast("long").alias("next_offset"))
    return browse.enrich(page, records, ["id", "source", "domain", "token_count"])


def keyword_search(postings: DataFrame, term_stats: DataFrame, size: dict, records: DataFrame, text: str,
                   filters: dict[str, Any], topics: DataFrame | None = None, require_all: bool = False) -> DataFrame:
    """Scores of all records that match words or "quoted phrases" under metadata filters."""
    allowed = selection.eligible(records, filters, topics)
    return keyword.scores(postings, term_stats, size, keyword.parse(check_query(text)), allowed, require_all)
