"""Vector search: exact cosine and the partitioned, quantised index.

The coarse index is three tables: ``centroids(cell, vec)`` of a fixed count,
``cells(cell, record_no, code)`` in one folder per cell, and the original
vectors, which give every returned score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from lexigrove import fixed
from lexigrove.functions import vectors as vec
from lexigrove.functions.vectors import lists_of, matrix_of
from lexigrove.operators import browse
from lexigrove.session import local_table, settle

SCORE_DIGITS = 6
MAX_CELLS = 16_384


def allowed_only(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return rows if allowed is None else rows.join(allowed.select("record_no"), "record_no", "left_semi")


def exact_scores(vectors: DataFrame, query: Sequence[float], allowed: DataFrame | None = None,
                 digits: int = SCORE_DIGITS) -> DataFrame:
    """Cosine of every usable, allowed vector with the query."""
    usable = allowed_only(vectors.filter(vec.is_usable(F.col("vec"))), allowed)
    return usable.select(
        "record_no", F.round(vec.cosine_with(query)(F.col("vec")), digits).alias("score"))


def top(scored: DataFrame, limit: int) -> DataFrame:
    """Best first, ties by record number: every task keeps ``limit`` rows, then they merge."""
    return scored.orderBy(F.desc("score"), F.asc("record_no")).limit(limit)


def compared(vectors: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    usable = allowed_only(vectors.filter(vec.is_usable(F.col("vec"))), allowed)
    return usable.agg(F.count("*").alias("compared"))


# --- training ------------------------------------------------------------------

def cell_count(records: int) -> int:
    """Largest power of two up to a thousandth of the records, within 64..16384."""
    return min(MAX_CELLS, max(64, 1 << max(0, (records // 1000).bit_length() - 1)))


def fit_cell_count(cells: int, sample: int) -> int:
    """Halved while a cell would get fewer than 39 sample vectors."""
    while cells > 1 and sample < 39 * cells:
        cells //= 2
    return cells


def training_sample(vectors: DataFrame, size: int, seed: int = fixed.SEED) -> DataFrame:
    """A seeded uniform sample of usable vectors.

    A digest threshold first keeps slightly more than needed, so that the final
    ordering runs over about ``size`` rows and not over the whole table.
    """
    usable = vectors.filter(vec.is_usable(F.col("vec")))
    total = usable.count()
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col("record_no").cast("string")))
    if total > 2 * size:
        share = min(1.0, (size + 6 * size ** 0.5 + 100) / total)
        cut = format(int(share * (16 ** 8)), "08x")
        narrowed = usable.filter(F.substring(order, 1, 8) <= cut)
        if narrowed.count() >= size:
            usable = narrowed
    chosen = usable.select("record_no").orderBy(order, "record_no").limit(size)
    return usable.join(chosen, "record_no", "left_semi")


def train_cells(sample: DataFrame, cells: int, seed: int = fixed.SEED, rounds: int = 20) -> DataFrame:
    """Centroids by k-means on unit vectors: ``cell, vec``."""
    features = sample.select(array_to_vector(vec.normalised(F.col("vec"))).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=rounds).fit(features)
    return centroid_table(sample.sparkSession, model.clusterCenters())


def centroid_table(spark: SparkSession, centers: Sequence) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    return local_table(spark, rows, "cell bigint, vec array<double>")


def small_table(centroids: DataFrame, name: str = "cell") -> tuple[list[int], list[list[float]]]:
    """Centroids on the driver; their number is fixed by the index, at most 16,384."""
    rows = centroids.select(name, "vec").limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError("Too many centroids")
    rows.sort(key=lambda r: r[0])
    return [r[0] for r in rows], [list(r["vec"]) for r in rows]


def assign(vectors: DataFrame, centroids: DataFrame, name: str = "cell") -> DataFrame:
    """Best centroid per vector by cosine; zero vectors get -1."""
    ids, table = small_table(centroids, name)
    found = vec.nearest_in(ids, table)
    return vectors.withColumn("nearest", found(F.col("vec"))).select(
        *vectors.columns, F.col("nearest.cell").alias(name),
        F.round("nearest.similarity", SCORE_DIGITS).alias("similarity"))


# --- 8-bit scalar codes ----------------------------------------------------------

def dimension_bounds(vectors: DataFrame, size: int) -> tuple[list[float], list[float]]:
    """Smallest and largest value per dimension over all usable unit vectors."""
    unit = vectors.filter(vec.is_usable(F.col("vec"))).select(vec.normalised(F.col("vec")).alias("u"))
    row = unit.agg(
        *[F.min(F.get("u", F.lit(i))).alias(f"a{i}") for i in range(size)],
        *[F.max(F.get("u", F.lit(i))).alias(f"b{i}") for i in range(size)],
    ).first()
    return [row[f"a{i}"] for i in range(size)], [row[f"b{i}"] for i in range(size)]


def quantize(vectors: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """One code of 0..255 per dimension; usable vectors only."""
    lows = F.array(*[F.lit(x) for x in low])
    steps = F.array(*[F.lit((b - a) / 255 if b > a else 1.0) for a, b in zip(low, high)])
    usable = vectors.filter(vec.is_usable(F.col("vec"))).withColumn("unit", vec.normalised(F.col("vec")))
    code = F.transform("unit", lambda x, i: F.floor(
        F.round((x - F.get(lows, i)) / F.get(steps, i), 9) + 0.5).cast("smallint"))
    return usable.withColumn("code", code).drop("unit")


def decoder(query: Sequence[float], low: Sequence[float], high: Sequence[float]):
    """Arrow function: approximate dot product straight from the codes."""
    q = np.asarray(query, dtype=np.float64)
    base = float(q @ np.asarray(low))
    factors = q * np.asarray([(b - a) / 255 if b > a else 1.0 for a, b in zip(low, high)])

    @F.arrow_udf(T.DoubleType())
    def approximate(codes: pa.Array) -> pa.Array:
        rows = matrix_of(codes)
        return pa.array(rows @ factors + base if len(rows) else np.empty(0))

    return approximate


def code_loss(query: Sequence[float], low: Sequence[float], high: Sequence[float]) -> float:
    """How far a score from codes can be from the cosine with a unit query: half a step per dimension."""
    steps = np.asarray([(b - a) / 255 if b > a else 1.0 for a, b in zip(low, high)])
    return float(np.abs(np.asarray(query)) @ (steps / 2 + 1e-8 * steps)) + 1e-9


def cell_bounds(query: np.ndarray, centroids: DataFrame, cells: Sequence[int] | None = None) -> tuple[list[int], list[float]]:
    """Cells and the best cosine a member can have with a unit query, best first.

    ``centroids`` has the smallest cosine of a member to its centroid (rounded):
    two angles bound the third.
    """
    rows = centroids.select("cell", "vec", "least").limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError("Too many centroids")
    only = None if cells is None else set(cells)
    rows = [r for r in rows if only is None or r["cell"] in only]
    if not rows:
        return [], []
    matrix = np.asarray([r["vec"] for r in rows])
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    reach = np.arccos(np.clip([r["least"] - 2e-6 for r in rows], -1, 1))
    angle = np.arccos(np.clip(matrix @ query, -1, 1))
    bounds = np.cos(np.maximum(angle - reach, 0)) + 1e-9
    order = np.lexsort(([r["cell"] for r in rows], -bounds))
    return [rows[i]["cell"] for i in order], [float(bounds[i]) for i in order]


def write_cells(assigned: DataFrame, path: str) -> None:
    """One folder per cell; a big cell is spread over several tasks by record number."""
    (
        assigned.select("record_no", "source", "similarity", "code", "cell")
        .repartition("cell", F.floor(F.col("record_no") / 1_000_000))
        .write.option("compression", "zstd").partitionBy("cell").parquet(path)
    )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("record_no bigint, source string, similarity double, code array<smallint>, cell bigint").parquet(path)


def probed(query: Sequence[float], centroids: tuple[list[int], list[list[float]]], probes: int | None = None) -> list[int]:
    """The cells nearest to the query (all by default), from the fixed-size centroid table."""
    ids, table = centroids
    matrix = np.asarray(table)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    scores = matrix @ np.asarray(query)
    return [ids[i] for i in np.lexsort((ids, -scores))[:probes]]


def candidates(cells: DataFrame, score: Column, chosen: Sequence[int], allowed: DataFrame | None,
               limit: int) -> DataFrame:
    """Best quantised scores inside the chosen cells; the filter applies before the cut."""
    rows = allowed_only(cells.filter(F.col("cell").isin(list(chosen))), allowed)
    return top(rows.select("record_no", score.alias("score")), limit)


def rescored(found: DataFrame, vectors: DataFrame, query: Sequence[float], limit: int,
             digits: int = SCORE_DIGITS) -> DataFrame:
    """Exact cosines for candidates, so no quantisation error is returned.

    The vector table is read only in the span folders of the candidates.
    """
    originals = browse.lookup(vectors, settle(found.select("record_no")))
    return top(exact_scores(originals, query, digits=digits), limit)


# --- product codes ---------------------------------------------------------------

def train_product(sample: DataFrame, size: int, parts: int = 32, words: int = 256,
                  seed: int = fixed.SEED) -> list[list[list[float]]]:
    """A small codebook per sub-vector by k-means on the training sample."""
    width = size // parts
    unit = sample.select(vec.normalised(F.col("vec")).alias("u")).persist()
    count = unit.count()
    books = []
    for part in range(parts):
        features = unit.select(array_to_vector(F.slice("u", part * width + 1, width)).alias("features"))
        model = KMeans(k=max(1, min(words, count // 4)), seed=seed, maxIter=8).fit(features)
        books.append([[float(x) for x in c] for c in model.clusterCenters()])
    unit.unpersist()
    return books


def product_codes(vectors: DataFrame, books: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """Nearest codeword (Euclidean) per sub-vector; usable vectors only."""
    tables = [np.asarray(b, dtype=np.float64) for b in books]
    width = tables[0].shape[1]

    @F.arrow_udf(T.ArrayType(T.ShortType()))
    def encode(units: pa.Array) -> pa.Array:
        rows = matrix_of(units)
        if not len(rows):
            return pa.array([], pa.list_(pa.int16()))
        codes = np.empty((len(rows), len(tables)), dtype=np.int16)
        for part, table in enumerate(tables):
            block = rows[:, part * width:(part + 1) * width]
            distance = (table ** 2).sum(axis=1) - 2 * block @ table.T
            codes[:, part] = distance.argmin(axis=1)
        return lists_of(codes)

    usable = vectors.filter(vec.is_usable(F.col("vec")))
    return usable.withColumn("code", encode(vec.normalised(F.col("vec"))))


def product_score(query: Sequence[float], books: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Sum of table look-ups, one per sub-vector, as a built-in expression."""
    width = len(books[0][0])
    table = F.array(*[
        F.array(*[F.lit(float(np.dot(query[p * width:(p + 1) * width], w))) for w in book])
        for p, book in enumerate(books)
    ])
    looked_up = F.transform("code", lambda c, i: F.get(F.get(table, i), c.cast("int")))
    return F.aggregate(looked_up, F.lit(0.0), lambda s, x: s + x)


# --- many queries ----------------------------------------------------------------

def many_candidates(cells: DataFrame, units: np.ndarray, chosen: Sequence[Sequence[int]], low: Sequence[float],
                    high: Sequence[float], keep: int) -> DataFrame:
    """Best coded scores of a bounded set of queries, each in its own cells: ``query, record_no, score``.

    One matrix product per batch scores all queries; every task keeps one list of
    ``keep`` rows per query, and the lists are merged by query.
    """
    steps = np.asarray([(b - a) / 255 if b > a else 1.0 for a, b in zip(low, high)])
    factors, base = (units * steps).T, units @ np.asarray(low)
    asked = [frozenset(c) for c in chosen]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0)) for _ in asked]
        for batch in batches:
            numbers, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            scores = matrix_of(batch.column(1)) @ factors + base if batch.num_rows else np.zeros((0, len(asked)))
            present = set(np.unique(cell).tolist())
            for q, own in enumerate(asked):
                inside = np.isin(cell, list(own & present))
                if inside.any():
                    n, s = np.append(held[q][0], numbers[inside]), np.append(held[q][1], scores[inside, q])
                    order = np.lexsort((n, -s))[:keep]
                    held[q] = n[order], s[order]
        sizes = [len(n) for n, _ in held]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(asked)), sizes), pa.int64()), pa.array(np.concatenate([n for n, _ in held]) if held else [], pa.int64()),
            pa.array(np.concatenate([s for _, s in held]) if held else [], pa.float64())], names=["query", "record_no", "score"])

    some = cells.filter(F.col("cell").isin(sorted(set().union(*asked))) if asked else F.lit(False))
    rows = some.select("record_no", "code", "cell").mapInArrow(best, "query long, record_no long, score double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc("record_no")))
    return rows.withColumn("place", place).filter(F.col("place") <= keep).drop("place")


def self_retrieval(vectors: DataFrame, index, queries: int = 32, probes: int = 64, keep: int = 50,
                   seed: int = fixed.SEED) -> DataFrame:
    """Share of sampled vectors that find a cosine of at least 0.98 in their list through the stored codes.

    What the codes or the probing lose shows here: candidates come from the
    index alone, and only they are scored from the original vectors.
    """
    spark = vectors.sparkSession
    asked = training_sample(vectors, queries, seed).select("record_no", "vec").collect()
    units = np.asarray([np.asarray(r["vec"]) / np.linalg.norm(r["vec"]) for r in asked])
    table = small_table(index.centroids)
    chosen = [probed(u, table, probes) for u in units]
    found = settle(many_candidates(index.cells, units, chosen, index.low, index.high, keep) if asked
                   else local_table(spark, [], "query bigint, record_no bigint, score double"))
    originals = browse.lookup(vectors, found).select("record_no", "vec")
    given = local_table(spark, [(i, [float(x) for x in u]) for i, u in enumerate(units)], "query bigint, unit array<double>")
    scored = found.select("query", "record_no").join(originals, "record_no").join(given, "query").select(
        "query", (vec.dot(F.col("vec"), F.col("unit")) / vec.norm(F.col("vec"))).alias("score"))
    best = given.select("query").join(scored.groupBy("query").agg(F.max("score").alias("best")), "query", "left")
    return best.agg(
        F.count("*").alias("queries"),
        F.round(F.avg((F.coalesce("best", F.lit(0.0)) >= 0.98).cast("double")), 6).alias("recall"))
