"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of blocks. A block holds some documents and, for each term
in them, the sorted positions of that term in the block; documents are one free
position apart, so no phrase crosses them. Blocks have a bounded number of
words and are independent, so neither building nor searching shuffles postings.

A search takes the windows of the benchmark items. In each block it starts from
a window's rarest term there and intersects the lists, shifted by their offset
in the window, in order of rarity: what is left are exact phrase matches. A
proximity match has the window's three rarest terms near their places.

Items are broadcast in parts of at most ``ITEM_WORDS`` words; more items make
more passes over the index, whose spans are united by document.

Edge cases: null or empty texts have no words and are never contaminated; items
without words match nothing; an item shorter than the window is one window;
repeated documents are judged one by one; items with a null id hit words but
are not listed. A document longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lexigrove.llm.shared import PARTITIONS_PER_FILE, SMALL_GROUPS, few, pieces, places_of, unused, word_bytes, written

# --- fixed values: the contamination rule ---
WINDOW = 13
HIT_SHARE = 20

# Each block is one row, which Spark copies as a whole: small ones keep the heap small.
BLOCK_BYTES = 1 << 20
ITEM_WORDS = 500_000
NEAR_TERMS = 3
NEAR_SLACK = 3

INDEX = "block long, doc_ids array<long>, versions array<long>, first array<int>, words array<int>, terms array<binary>, ends array<int>, gaps array<int>"
FOUND = "block long, number int, doc_id long, version long, n_words long, spans array<struct<start:int,end:int>>, items array<string>, near_items array<string>"


def _block(doc_ids: list, texts: list) -> dict:
    """The postings of one block."""
    numbers: dict[bytes, int] = {}
    add = numbers.setdefault
    terms, counts = [], []
    for text in texts:
        words = word_bytes(text)
        counts.append(len(words))
        terms.append(np.fromiter((add(w, len(numbers)) for w in words), np.int32, len(words)))
    counts = np.array(counts, dtype=np.int64)
    first = np.cumsum(counts + 1) - counts - 1
    term = np.concatenate(terms) if terms else np.zeros(0, np.int32)
    position = np.arange(len(term)) + np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(term, kind="stable")
    ends = np.cumsum(np.bincount(term, minlength=len(numbers)))
    sorted_positions = position[order]
    gaps = np.diff(sorted_positions, prepend=0)
    return {"doc_ids": doc_ids, "first": first.astype(np.int32), "words": counts.astype(np.int32), "terms": list(numbers),
            "ends": ends.astype(np.int32), "gaps": gaps.astype(np.int32)}


def index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Positional postings of all terms of all documents, one row per block."""
    types = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("versions", pa.list_(pa.int64())), ("first", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())),
                       ("terms", pa.list_(pa.binary())), ("ends", pa.list_(pa.int32())), ("gaps", pa.list_(pa.int32()))])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, (part, texts) in enumerate(pieces(batches, "text", block_bytes)):
            block = {"block": base + number, "versions": part.column(1).to_pylist(), **_block(part.column(0).to_pylist(), texts)}
            yield pa.RecordBatch.from_arrays([pa.array([block[f.name]], f.type) for f in types], schema=types)

    # Numbers of blocks need one run of ``built`` a task: tasks are made fewer before it.
    return few(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").mapInArrow(built, INDEX)


def _windows(words: int, size: int) -> range:
    return range(0, max(words - size, 0) + 1) if words else range(0)


class Postings:
    """One block, ready to be searched."""

    def __init__(self, asked: list[bytes], terms: pa.Array, ends: np.ndarray, gaps: np.ndarray):
        self.numbers = places_of(asked, terms).astype(np.int64)
        self.ends = np.concatenate([[0], ends])
        self.positions = np.cumsum(gaps)

    def of(self, number: int) -> np.ndarray:
        return self.positions[self.ends[number]:self.ends[number + 1]]

    def phrase(self, numbers: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Starts of the phrase: shifted lists intersected from the rarest on."""
        starts = self.of(numbers[order[0]]) - order[0]
        for offset in order[1:]:
            if not len(starts):
                break
            held = self.of(numbers[offset])
            at = np.minimum(np.searchsorted(held, starts + offset), len(held) - 1)
            starts = starts[held[at] == starts + offset]
        return starts

    def near(self, numbers: np.ndarray, order: np.ndarray, slack: int) -> np.ndarray:
        """Starts around which the rarest terms stand, each at most ``slack`` words from its place."""
        starts = self.of(numbers[order[0]]) - order[0]
        for offset in order[1:NEAR_TERMS]:
            held = self.of(numbers[offset])
            at = np.minimum(np.searchsorted(held, starts + offset - slack), len(held) - 1)
            starts = starts[np.abs(held[at] - starts - offset) <= slack]
        return starts


def _search_block(block: Postings, first: np.ndarray, counts: np.ndarray, items: list, size: int, slack: int):
    """Hit words as a flag per position, and the items by document number. Items are places in the asked words."""
    hit = np.zeros(int(first[-1] + counts[-1]) + 1 if len(first) else 1, dtype=bool)
    exact, close = set(), set()
    for item_id, words in items:
        numbers = block.numbers[words]
        width = min(size, len(words))
        absent = np.concatenate([[0], np.cumsum(numbers < 0)])
        rarity = np.where(numbers < 0, 0, block.ends[numbers + 1] - block.ends[numbers])
        for start in _windows(len(words), size):
            if absent[start + width] > absent[start]:
                continue
            part = numbers[start:start + width]
            order = np.argsort(rarity[start:start + width], kind="stable")
            around = block.near(part, order, slack)
            if not len(around):
                continue
            close.update((int(d), item_id) for d in np.unique(np.searchsorted(first, around + order[0], side="right") - 1))
            found = block.phrase(part, order)
            if len(found):
                hit[(found[:, None] + np.arange(width)).ravel()] = True
                exact.update((int(d), item_id) for d in np.unique(np.searchsorted(first, found, side="right") - 1))
    return hit, exact, close


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def _item_parts(benchmark: DataFrame) -> Iterator[list]:
    """The items' words in parts of bounded size."""
    part, total = [], 0
    for row in benchmark.select("item_id", "text").distinct().toLocalIterator():
        words = word_bytes((row["text"] or "").encode())
        if words:
            part.append((None if row["item_id"] is None else str(row["item_id"]), words))
            total += len(words)
        if total >= ITEM_WORDS:
            yield part
            part, total = [], 0
    yield part


def search(blocks: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = NEAR_SLACK) -> DataFrame:
    """Every indexed document with the word spans of exact matches and the items matched exactly or nearly."""
    context = blocks.sparkSession.sparkContext
    kind = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("doc_id", pa.int64()), ("version", pa.int64()), ("n_words", pa.int64()),
                      ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                      ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])

    def one_pass(part: list) -> DataFrame:
        asked = sorted({w for _, words in part for w in words})
        place = {w: n for n, w in enumerate(asked)}
        shared = context.broadcast((asked, [(item_id, np.array([place[w] for w in words], dtype=np.int64)) for item_id, words in part]))

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, items_asked = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    cell = {n: batch.column(n)[i].values for n in batch.schema.names if n != "block"}
                    first, counts = cell["first"].to_numpy(), cell["words"].to_numpy()
                    block = Postings(asked, cell["terms"], cell["ends"].to_numpy(), cell["gaps"].to_numpy())
                    hit, exact, close = _search_block(block, first, counts, items_asked, size, slack)
                    items: dict[int, list] = {}
                    near: dict[int, list] = {}
                    for into, pairs in ((items, exact), (near, close)):
                        for number, item in pairs:
                            into.setdefault(number, []).append(item)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([batch.column("block")[i].as_py()] * len(first), pa.int64()), pa.array(range(len(first)), pa.int32()),
                        cell["doc_ids"], cell["versions"], pa.array(counts, pa.int64()),
                        pa.array([_spans(hit[a:a + n]) if d in items else [] for d, (a, n) in enumerate(zip(first, counts))], kind.field("spans").type),
                        pa.array([items.get(d, []) for d in range(len(first))], kind.field("items").type),
                        pa.array([near.get(d, []) for d in range(len(first))], kind.field("near_items").type)], schema=kind)

        # One run of ``searched`` for each part of a file: a batch never holds more than that part.
        return few(blocks.mapInArrow(searched, FOUND))

    passes = [one_pass(part) for part in _item_parts(benchmark)]
    if len(passes) == 1:
        return passes[0]
    rows = passes[0]
    for other in passes[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("block", "number", "doc_id", "version", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"),
        F.flatten(F.collect_list("near_items")).alias("near_items"))


def _covered(spans):
    """Length of a union of spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")), lambda a: a["n"])


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = NEAR_SLACK) -> DataFrame:
    """Per document: words, hit words, spans, exact and near items and the verdict."""
    stored = written(index(docs), "postings", **SMALL_GROUPS)
    named = search(stored, benchmark, size, slack).withColumns({
        n: F.array_sort(F.array_distinct(F.filter(n, lambda x: x.isNotNull()))) for n in ("items", "near_items")})
    return named.withColumn("n_hit", _covered(F.col("spans"))).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated."""
    key = unused(docs.columns, "_id", "_version")

    def keys(version: Column) -> list[Column]:
        return [F.coalesce("doc_id", F.lit(-1)).alias(key[0]), version.alias(key[1])]

    bad = matches(docs, benchmark).filter("contaminated").select(*keys(F.col("version"))).distinct()
    return few(docs, PARTITIONS_PER_FILE).select("*", *keys(F.xxhash64("text"))).join(bad, key, "left_anti").select(*docs.columns)
