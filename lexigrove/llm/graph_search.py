"""Approximate nearest neighbours by pruned directed graphs, one for each shard.

Equal vectors are one node, known by their smallest id. Nodes are dealt to
shards of about ``SHARD_ROWS``. In a shard, points enter the graph in batches:
a greedy search over the graph so far proposes neighbours; relaxed pruning
keeps a proposal only if no kept one is clearly nearer to it, so that edges
point in different directions; edges back are pruned in the same way. Queries,
in blocks, run a beam search in every shard, and the best of all shards are
merged. Distances that are returned are computed anew in double precision.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components and rows without an id take no part; vectors are compared with those
of the same dimension only; repeated rows count once; ties go to the smaller
id; with fewer candidates than asked for, all are returned.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexigrove.llm.shared import written

SHARD_ROWS = 5_000
BLOCK_QUERIES = 2_048
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
BATCH = 512


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Graph:
    """Points of a shard, their out-edges (-1: none) and the entry point."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, entry: int):
        self.points, self.edges, self.entry = points, edges, entry
        self.squares = np.einsum("nd,nd->n", points, points)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for many queries in step: nodes and squared distances, nearest first (-1: none)."""
        count, rows = len(queries), np.arange(len(queries))
        own = np.einsum("qd,qd->q", queries, queries)
        nodes = np.full((count, beam), -1, dtype=np.int32)
        far = np.full((count, beam), np.inf, dtype=np.float32)
        done = np.zeros((count, beam), dtype=bool)
        seen = np.zeros((count, len(self.points)), dtype=bool)
        nodes[:, 0], seen[:, self.entry] = self.entry, True
        far[:, 0] = self.squares[self.entry] - 2 * queries @ self.points[self.entry] + own
        live = rows
        while len(live):
            open_ = ~done[live] & (nodes[live] >= 0)
            some = open_.any(axis=1)
            live, at = live[some], open_[some].argmax(axis=1)
            if not len(live):
                break
            done[live, at] = True
            near = self.edges[nodes[live, at]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[np.repeat(live, fresh.sum(axis=1)), near[fresh]] = True
            near = np.where(fresh, near, 0)
            d = self.squares[near] - 2 * np.matmul(self.points[near], queries[live][:, :, None])[:, :, 0] + own[live][:, None]
            d = np.where(fresh, d, np.inf).astype(np.float32)
            all_far = np.concatenate([far[live], d], axis=1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_far, best, 1), axis=1, kind="stable"), 1)
            far[live] = np.take_along_axis(all_far, best, 1)
            nodes[live] = np.where(np.isinf(far[live]), -1, np.take_along_axis(np.concatenate([nodes[live], near.astype(np.int32)], axis=1), best, 1))
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(d.shape, bool)], axis=1), best, 1)
        return nodes, far

    def prune(self, owners: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        """Diverse out-edges of each owner from its proposals (-1: none)."""
        order_key = self._distances(owners, proposed)
        order = np.argsort(order_key, axis=1, kind="stable")
        proposed, far = np.take_along_axis(proposed, order, 1), np.take_along_axis(order_key, order, 1)
        alive = np.isfinite(far)
        alive[:, 1:] &= proposed[:, 1:] != proposed[:, :-1]
        points, squares = self.points[proposed], self.squares[proposed]
        between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
        kept = np.full((len(owners), degree), -1, dtype=np.int32)
        rows = np.arange(len(owners))
        for place in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            kept[some, place] = proposed[rows, first][some]
            # Squared distances, so the factor counts twice.
            alive &= alpha * alpha * between[rows, first] > far
            alive[rows, first] = False
        return kept

    def _distances(self, owners: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        safe = np.maximum(proposed, 0)
        d = self.squares[safe] + self.squares[owners][:, None] - 2 * np.matmul(self.points[safe], self.points[owners][:, :, None])[:, :, 0]
        return np.where((proposed < 0) | (proposed == owners[:, None]), np.inf, d)


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = BATCH) -> Graph:
    """A graph over the rows of a matrix."""
    points = points.astype(np.float32)
    # Moved to the middle: distances stay, sums of squares get smaller.
    middle = points.mean(axis=0)
    graph = Graph(points - middle, np.full((len(points), degree), -1, dtype=np.int32), 0)
    graph.entry = int(np.argmin(graph.squares))
    order = np.random.default_rng(11).permutation(len(points))
    order = np.concatenate([[graph.entry], order[order != graph.entry]])
    at, step = 1, 1
    while at < len(order):
        new = order[at:at + step]
        found, _ = graph.search(graph.points[new], beam)
        graph.edges[new] = graph.prune(new, found, degree, alpha)
        _edges_back(graph, new, degree, alpha)
        at += step
        step = min(batch, max(1, at))
    return graph


def _edges_back(graph: Graph, new: np.ndarray, degree: int, alpha: float) -> None:
    source, target = np.repeat(new, degree), graph.edges[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    first = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
    number = np.diff(np.append(first, len(target)))
    for low in range(0, len(first), BATCH):
        some, count = first[low:low + BATCH], number[low:low + BATCH]
        owners = target[some]
        wide = np.full((len(owners), degree + int(count.max())), -1, dtype=np.int32)
        wide[:, :degree] = graph.edges[owners]
        row, column = np.repeat(np.arange(len(owners)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        wide[row, degree + column] = source[np.repeat(some, count) + column]
        if wide.shape[1] > 2 * degree:
            nearest = np.argpartition(graph._distances(owners, wide), 2 * degree - 1, axis=1)[:, :2 * degree]
            wide = np.take_along_axis(wide, nearest, 1)
        graph.edges[owners] = graph.prune(owners, wide, degree, alpha)


def nodes_of(vectors: DataFrame, k: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (node, vec) and, for each, its smallest k + 1 ids (node, vec_id)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(vector).alias("vec")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).distinct()
    same = W.partitionBy("vec").orderBy("vec_id")
    placed = written(rows.withColumn("place", F.row_number().over(same)).withColumn("node", F.first("vec_id").over(same)).filter(F.col("place") <= k + 1), "nodes")
    return placed.filter("place = 1").select("node", "vec"), placed.select("node", "vec_id")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all shards: dimension, shard, node, vec, neighbours (places in the shard) and place; place 0 is the entry."""
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumns({"dimension": F.size("vec"), "shard": F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")})

    def made(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        graph = build(_matrix(table.column("vec")))
        # The entry comes first.
        order = np.concatenate([[graph.entry], np.delete(np.arange(len(graph.points)), graph.entry)])
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        edges = np.where(graph.edges >= 0, place[graph.edges], -1)[order]
        table = table.take(pa.array(order)).select(["dimension", "shard", "node", "vec"])
        return table.append_column("neighbours", pa.array(list(edges.astype(np.int32)), pa.list_(pa.int32()))).append_column(
            "place", pa.array(np.arange(len(order), dtype=np.int32)))

    kind = f"dimension int, shard int, node long, vec {nodes.schema['vec'].dataType.simpleString()}, neighbours array<int>, place int"
    # A given number of partitions is not merged: building takes long for few bytes.
    spread = dealt.select("dimension", "shard", "node", "vec").repartition(shards, "dimension", "shard")
    return spread.groupBy("dimension", "shard").applyInArrow(made, kind)


def search(graphs: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest nodes of each query found in all shards: (query_node, node, score). ``queries``: query_node, vec."""
    blocks = max(1, -(-queries.count() // block_queries))
    shards = graphs.select("dimension", "shard").distinct()
    asked = (queries.withColumns({"dimension": F.size("vec"), "block": F.pmod(F.xxhash64("query_node"), F.lit(blocks)).cast("int")})
             .join(shards, "dimension"))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = pa.schema([("query_node", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])

    def found(shard: pa.Table, wanted: pa.Table) -> pa.Table:
        if not shard.num_rows or not wanted.num_rows:
            return kind.empty_table()
        shard = shard.sort_by("place")
        points, ids, asked_for = _matrix(shard.column("vec")), shard.column("node").to_numpy(), wanted.column("query_node").to_numpy()
        middle, edges = points.mean(axis=0), _matrix(shard.column("neighbours")).astype(np.int32)
        graph = Graph((points - middle).astype(np.float32), edges, 0)
        vectors = _matrix(wanted.column("vec"))
        out = []
        for low in range(0, len(vectors), BATCH):
            part = vectors[low:low + BATCH]
            near, _ = graph.search((part - middle).astype(np.float32), min(max(beam, k), len(points)))
            exact = np.sqrt(((points[np.maximum(near, 0)] - part[:, None, :]) ** 2).sum(axis=2))
            exact[near < 0] = np.inf
            order = np.lexsort((ids[near], exact), axis=1)[:, :k]
            exact, chosen = np.take_along_axis(exact, order, 1), np.take_along_axis(ids[near], order, 1)
            fits = np.isfinite(exact)
            out.append(pa.table([pa.array(np.repeat(asked_for[low:low + BATCH], fits.sum(axis=1))), pa.array(chosen[fits]), pa.array(exact[fits])], schema=kind))
        return pa.concat_tables(out)

    # New names: both sides come from the same table.
    asked = asked.select("query_node", "vec", F.col("dimension").alias("d"), F.col("shard").alias("s"), F.col("block").alias("b"))
    each = (held.groupBy("dimension", "shard", "block").cogroup(asked.groupBy("d", "s", "b"))
            .applyInArrow(found, "query_node long, node long, score double"))
    best = W.partitionBy("query_node").orderBy("score", "node")
    return each.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")


def nearest(vectors: DataFrame, asked: Column, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest rows of every row that meets ``asked``: query_id, rank, vec_id, score."""
    nodes, members = nodes_of(vectors, k)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vec")).filter(asked & F.col("vec_id").isNotNull() & usable(F.col("vec"))).distinct()
    queries = written(rows.join(nodes, "vec").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query_node"), "vec"), "queries")
    graphs = written(index(nodes, shard_rows), "graphs")
    found = search(graphs, queries.select("query_node", "vec").distinct(), k + 1)
    pairs = found.join(members, "node").join(queries.select("query_id", "query_node"), "query_node").filter("vec_id <> query_id")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return (pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
