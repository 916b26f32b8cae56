"""Ranked lexical search without random access (NRA) over impact-sorted lists.

The index is a table of blocks of documents. A block holds, for each of its
terms, the documents with that term in falling order of the term's impact
``(10^9 tf) div (1000 tf + 12 m)``, where m grows with the document's length.
Blocks are independent and of bounded size, so neither building nor searching
shuffles postings; only the number and length of all documents and the document
frequencies of the asked terms are summed over all blocks beforehand.

In each block an item reads its lists from the top in rounds. A document's lower
score is what was read of it; its upper score adds, for every list in which it
was not met yet, the impact at which that list stands. Reading goes on until no
other document can reach the last place (equal scores included, as ties go to
the smaller id) and until every list has passed the members or cannot change
their scores any more. The last place of earlier blocks of a task is the bar
that later blocks have to reach. The lists of all tasks are merged by item.

Items are broadcast in parts of at most ``ITEM_WORDS`` words, one part at a time.

Edge cases: null and empty texts have no terms: such documents are not counted
and never found, such items find nothing. A repeated document row is a document
of its own; equal item rows are one item, and a null item id is an id like
others. A null doc_id comes after all others at equal score. Very long texts are
blocks of their own. Empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lexigrove.llm.shared import CHUNK_BYTES, SMALL_GROUPS, WORD_BYTES, few, pieces, places_of, word_bytes, written
from lexigrove.session import local_table

# --- fixed values: the score ---
PLACES = 20
IMPACT_UNIT = 1_000_000_000
TF_FACTOR = 1000
LENGTH_FACTOR = 12
LENGTH_SHARE = 25

# Each block is one row, which Spark copies as a whole: small ones keep the heap small.
BLOCK_BYTES = 2 << 20
ITEM_WORDS = 500_000
FIRST_READ = 256
LANES = 256
NO_ID = np.iinfo(np.int64).max

INDEX = "doc_ids array<long>, lengths array<int>, terms array<binary>, ends array<int>, docs array<int>, tfs array<int>"
FOUND = "item int, doc_id long, score long"


@dataclass(frozen=True)
class Size:
    """Documents with at least one term, and all their terms."""

    documents: int
    terms: int


def impacts(tf: np.ndarray, length: np.ndarray, size: Size) -> np.ndarray:
    m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * size.documents // max(size.terms, 1)
    return IMPACT_UNIT * tf // (TF_FACTOR * tf + LENGTH_FACTOR * m)


def weight(size: Size, df: int) -> int:
    return math.floor(1000 * math.log((2 * size.documents + 2) / (2 * df + 1)))


_PART_OF_WORD = np.frombuffer(WORD_BYTES, np.uint8) != 32


def collection(docs: DataFrame) -> Size:
    """Counts words by their first bytes, without making them."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for _, texts in pieces(batches, "text", CHUNK_BYTES // 4):
            texts = [t or b"" for t in texts]
            inside = _PART_OF_WORD[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
            starts = np.concatenate([[0], np.cumsum(inside[1:] & ~inside[:-1])])
            edges = np.cumsum([0] + [len(t) + 1 for t in texts])
            lengths = np.diff(starts[edges])
            documents, terms = documents + int((lengths > 0).sum()), terms + int(lengths.sum())
        yield pa.RecordBatch.from_pydict({"documents": pa.array([documents], pa.int64()), "terms": pa.array([terms], pa.int64())})

    row = docs.select("text").mapInArrow(counted, "documents long, terms long").agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
    return Size(row["n"] or 0, row["l"] or 0)


def _block(parts: list[tuple[list, list]], size: Size) -> list | None:
    """One index row: per term the documents and frequencies by falling impact."""
    numbers: dict[bytes, int] = {}
    add = numbers.setdefault
    ids, lengths, chunks = [], [], []
    for doc_ids, texts in parts:
        for doc_id, text in zip(doc_ids, texts):
            words = word_bytes(text)
            if words:
                ids.append(NO_ID if doc_id is None else doc_id)
                lengths.append(len(words))
                chunks.append(np.fromiter((add(w, len(numbers)) for w in words), np.int32, len(words)))
    if not ids:
        return None
    count = np.array(lengths, dtype=np.int64)
    key, tf = np.unique(np.concatenate(chunks).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), count), return_counts=True)
    term, doc = np.divmod(key, len(ids))
    order = np.lexsort((doc, -impacts(tf, count[doc], size), term))
    ends = np.cumsum(np.bincount(term, minlength=len(numbers)))
    return [ids, lengths, list(numbers), ends.astype(np.int32), doc[order].astype(np.int32), tf[order].astype(np.int32)]


def index(docs: DataFrame, size: Size, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Impact-sorted lists of all terms of all documents, one row per block."""
    types = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["doc_ids", "lengths", "terms", "ends", "docs", "tfs"]

    def rows(parts: list) -> Iterator[pa.RecordBatch]:
        block = _block(parts, size)
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block, types)], names=names)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part, texts in pieces(batches, "text", min(CHUNK_BYTES, block_bytes)):
            parts.append((part.column(0).to_pylist(), texts))
            held += sum(len(t) for t in texts if t)
            if held >= block_bytes:
                yield from rows(parts)
                parts, held = [], 0
        yield from rows(parts)

    return few(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(built, INDEX)


def item_parts(items: DataFrame, most: int = ITEM_WORDS) -> Iterator[list[tuple]]:
    """Items as (id, {term: occurrences}) in parts of bounded size."""
    part, total = [], 0
    for row in items.select("item_id", "text").distinct().toLocalIterator():
        words = word_bytes((row["text"] or "").encode())
        if words:
            asked: dict[bytes, int] = {}
            for w in words:
                asked[w] = asked.get(w, 0) + 1
            part.append((row["item_id"], asked))
            total += len(words)
        if total >= most:
            yield part
            part, total = [], 0
    if part:
        yield part


def document_frequencies(blocks: DataFrame, asked: set[bytes]) -> dict[bytes, int]:
    """In how many documents each asked term occurs; reads no list."""
    shared = blocks.sparkSession.sparkContext.broadcast(list(asked))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, ends = places_of(terms, batch.column(0)[i].values), np.diff(batch.column(1)[i].values.to_numpy(), prepend=0)
                total[at >= 0] += ends[at[at >= 0]]
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([terms[n] for n in met], pa.binary()), pa.array(total[met])], names=["term", "df"])

    rows = blocks.select("terms", "ends").mapInArrow(counted, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    shared.unpersist()
    return dict(zip(rows["term"].to_pylist(), rows["df"].to_pylist()))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, places: int, bar: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """Documents and exact scores of the first ``places`` that reach ``bar`` (1 at least).

    ``lists``: per term the documents and their contributions, largest first.
    """
    lower = np.zeros(len(ids), dtype=np.int64)
    ends = np.array([len(d) for d, _ in lists])
    at = np.zeros(len(lists), dtype=np.int64)

    def bounds() -> np.ndarray:
        """The contribution at which each list stands; 0 at its end."""
        return np.array([c[a] if a < e else 0 for (_, c), a, e in zip(lists, at, ends)], dtype=np.int64)

    def read(n: int, only: np.ndarray | None = None) -> None:
        for i, (docs, contributions) in enumerate(lists):
            part = slice(at[i], at[i] + n)
            seen, add = docs[part], contributions[part]
            if only is not None:
                keep = only[seen]
                seen, add = seen[keep], add[keep]
            lower[seen] += add
            at[i] = min(at[i] + n, ends[i])

    def gaps(left: np.ndarray) -> np.ndarray:
        """How far each document's score may still rise: the bounds of all lists in which it was not met."""
        out = np.full(len(ids), left.sum())
        for i in np.flatnonzero(left):
            out[lists[i][0][:at[i]]] -= left[i]
        return out

    def last_place(of: np.ndarray) -> int:
        return int(-np.partition(-lower[of], places - 1)[places - 1]) if len(of) >= places else 0

    step, last, open_ = first_read, max(bar, 1), np.zeros(0, np.int64)
    while True:
        read(step)
        step *= 2
        left = bounds()
        touched = np.flatnonzero(lower)
        last = max(last, last_place(touched))
        if left.sum() >= last:
            continue
        open_ = touched[(lower + gaps(left))[touched] >= last]
        if not left.any() or len(open_) <= 2 * places:
            break
    # Few documents are left: the lists are read on for them alone until no score is open.
    chosen = np.zeros(len(ids), dtype=bool)
    chosen[open_] = True
    while left.any() and len(open_):
        rise = gaps(left)[open_]
        last = max(last, last_place(open_))
        inside = lower[open_] + rise >= last
        chosen[open_[~inside]] = False
        open_ = open_[inside]
        if not rise[inside].any():
            break
        read(step, chosen)
        step *= 2
        left = bounds()
    open_ = open_[lower[open_] >= last]
    best = open_[np.lexsort((ids[open_], -lower[open_]))][:places]
    return best, lower[best]


def search_part(blocks: DataFrame, part: list[tuple], size: Size, places: int = PLACES) -> DataFrame:
    """The best documents of each task for each item of a part: item number, doc_id, score."""
    frequencies = document_frequencies(blocks, {t for _, asked in part for t in asked})
    # Terms of no document or of no weight change no score.
    asked = [[(t, n * weight(size, frequencies[t])) for t, n in terms.items() if t in frequencies and weight(size, frequencies[t])] for _, terms in part]
    every = sorted({t for terms in asked for t, _ in terms})
    numbers = {t: n for n, t in enumerate(every)}
    shared = blocks.sparkSession.sparkContext.broadcast((every, [[(numbers[t], w) for t, w in terms] for terms in asked]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, asked = shared.value
        found = [[] for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {n: batch.column(n)[i].values for n in batch.schema.names}
                ids, lengths, docs, tfs = (cell[n].to_numpy().astype(np.int64) for n in ("doc_ids", "lengths", "docs", "tfs"))
                ends = np.concatenate([[0], cell["ends"].to_numpy()])
                at = places_of(every, cell["terms"]).tolist()
                impact = impacts(tfs, lengths[docs], size)
                for item, terms in enumerate(asked):
                    lists = [(docs[ends[k]:ends[k + 1]], w * impact[ends[k]:ends[k + 1]]) for k, w in ((at[n], w) for n, w in terms) if k >= 0]
                    if lists:
                        held = found[item]
                        bar = -held[places - 1][0] if len(held) >= places else 1
                        best, scores = nra(lists, ids, places, bar)
                        found[item] = sorted(held + list(zip((-scores).tolist(), ids[best].tolist())))[:places]
        rows = [(item, None if d == NO_ID else d, -s) for item, held in enumerate(found) for s, d in held]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                                         names=["item", "doc_id", "score"])

    return blocks.mapInArrow(searched, FOUND)


def ranked(docs: DataFrame, items: DataFrame, places: int = PLACES, item_words: int = ITEM_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's best documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    size = collection(docs)
    blocks = written(index(docs, size, block_bytes), "impact-lists", **SMALL_GROUPS)
    kind = items.schema["item_id"].dataType.simpleString()
    def first(rows: DataFrame, *group: str) -> DataFrame:
        order = W.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= places)

    out = None
    for part in item_parts(items, item_words):
        names = local_table(spark, [(n, item_id) for n, (item_id, _) in enumerate(part)], f"item int, item_id {kind}")
        found = search_part(blocks, part, size, places).withColumn("lane", F.spark_partition_id() % LANES)
        # In two steps: however many tasks there are, no item meets more than LANES lists at once.
        best = first(first(found, "item", "lane").drop("rank"), "item")
        rows = written(best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
