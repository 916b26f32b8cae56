"""Mixing sources to target weights, by fixed-length blocks.

The words of each source form one stream, documents in a pseudorandom order;
the stream is cut into blocks of ``block_words``. Every output shard draws its
source counts from a multinomial distribution. The slots of a source are
numbered through all shards, and a keyed permutation of the source's block
indexes says which block each slot takes; a full round takes every block once.
Slots join blocks by index.

Quotas are exact: what a source drew beyond its quota goes to sources that drew
too little, so the noise of the draws stays inside the shards.

Edge cases: null or empty texts have size 0 and take no part; a null source is
a source of its own, the last one; repeated rows are documents of their own;
an empty table gives an empty result. The driver holds one number per source
and nothing per document, block or shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexigrove.llm.shared import PARTITIONS_PER_FILE, few, mixed, written

# --- fixed values: words and weights of the mix ---
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3

BLOCK_WORDS = 64
SHARD_BLOCKS = 4096
ROWS_PER_RANGE = 5_000
SHARDS_PER_RANGE = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Plan:
    """Per source, in their order: name, words, target words, blocks and slots."""

    names: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    quotas: np.ndarray


def shares(sizes: np.ndarray, weights: np.ndarray, most: float = MOST_EPOCHS) -> np.ndarray:
    """Parts of the total by weight, none above ``most`` times its size; the excess is shared again."""
    left, open_ = float(sizes.sum()), sizes > 0
    target = np.zeros(len(sizes))
    while open_.any():
        level = left / weights[open_].sum()
        full = open_ & (level * weights > most * sizes)
        if not full.any():
            target[open_] = level * weights[open_]
            break
        target[full] = most * sizes[full]
        left -= float(target[full].sum())
        open_ &= ~full
    return target


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> Plan:
    """Targets from the words of each source (one row per source reaches the driver)."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.asc_nulls_last("source")).collect()
    sizes = np.array([r["n"] for r in rows], dtype=np.int64)
    given = np.array([weights[i % len(weights)] for i in range(len(rows))])
    targets = shares(sizes, given) if len(rows) else np.zeros(0)
    blocks = -(-sizes // block_words)
    quotas = np.minimum(np.rint(targets / block_words).astype(np.int64), MOST_EPOCHS * blocks)
    quotas = np.where((quotas == 0) & (targets > 0), 1, quotas)
    return Plan([r["source"] for r in rows], sizes, targets, blocks, quotas)


def source_table(spark: SparkSession, made: Plan) -> DataFrame:
    rows = [(n, i, int(s), float(t)) for i, (n, s, t) in enumerate(zip(made.names, made.sizes, made.targets))]
    return spark.createDataFrame(rows, "source string, source_no int, source_size long, target double")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position of each index under the permutation of [0, size) that the key selects.

    Four Feistel rounds on the smallest even number of bits that holds the
    size; a value outside the range goes through them again.
    """
    half = np.array([max(1, (int(n - 1).bit_length() + 1) // 2) for n in size], dtype=np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(4):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (mixed(right + key[todo] * np.uint64(0x9E3779B97F4A7C15), turn) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def draws(spark: SparkSession, made: Plan, shard_blocks: int = SHARD_BLOCKS, seed: int = 17) -> DataFrame:
    """Source counts of every output shard and the number of the first slot of each (source, shard)."""
    total = int(made.quotas.sum())
    chances = made.quotas / max(total, 1)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                counts = np.random.default_rng([seed, int(shard)]).multinomial(min(shard_blocks, total - int(shard) * shard_blocks), chances)
                used = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "source_no": used.astype("int32"), "slots": counts[used].astype("int64"),
                                    "at": (np.cumsum(counts) - counts)[used].astype("int64")})

    counts = spark.range(-(-total // shard_blocks)).mapInPandas(drawn, "shard long, source_no int, slots long, at long")
    counts = counts.withColumn("range", F.floor(F.col("shard") / SHARDS_PER_RANGE))
    ahead = W.partitionBy("source_no").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = counts.groupBy("source_no", "range").agg(F.sum("slots").alias("n"))
    ranges = ranges.select("source_no", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = W.partitionBy("source_no", "range").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return (counts.join(ranges, ["source_no", "range"])
            .select("shard", "source_no", "slots", "at", (F.col("before") + F.coalesce(F.sum("slots").over(inside), F.lit(0))).alias("first")))


def slots(spark: SparkSession, made: Plan, shard_blocks: int = SHARD_BLOCKS, seed: int = 17) -> DataFrame:
    """Every slot of the mix: shard, slot in the shard, source and block of that source."""
    if not made.quotas.sum():
        return spark.createDataFrame([], "shard long, slot long, source_no int, block long")
    table = draws(spark, made, shard_blocks, seed)
    drawn = np.zeros(len(made.names), dtype=np.int64)
    for row in table.groupBy("source_no").agg(F.sum("slots").alias("n")).collect():
        drawn[row["source_no"]] = row["n"]
    quotas, blocks = made.quotas, made.blocks
    excess, missing = np.maximum(drawn - quotas, 0), np.maximum(quotas - drawn, 0)
    excess_first, missing_ends = np.cumsum(excess) - excess, np.cumsum(missing)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                number = row.first + np.arange(row.slots)
                source = np.full(row.slots, row.source_no, dtype=np.int64)
                over = number >= quotas[row.source_no]
                if over.any():
                    extra = excess_first[row.source_no] + number[over] - quotas[row.source_no]
                    other = np.searchsorted(missing_ends, extra, side="right")
                    source[over] = other
                    number[over] = drawn[other] + extra - (missing_ends - missing)[other]
                size = blocks[source]
                key = mixed(source * MOST_EPOCHS + number // size, seed)
                yield pd.DataFrame({"shard": row.shard, "slot": row.at + np.arange(row.slots), "source_no": source.astype("int32"),
                                    "block": permuted(number % size, size, key)})

    return table.mapInPandas(placed, "shard long, slot long, source_no int, block long")


def counted(docs: DataFrame) -> DataFrame:
    """Id, hash of the text, source and size of every document, written: texts are counted once and stay where they are."""
    return written(docs.select("doc_id", F.xxhash64("text").alias("version"), "source", word_count(F.col("text")).alias("size")), "sizes")


def streams(sized: DataFrame, sources: DataFrame, rows: int, seed: int = 17) -> DataFrame:
    """The source's number and the document's first word in the source's stream, for documents with words.

    No source is sorted as a whole: hash ranges are, and sums over ranges place them.
    """
    ranges = max(1, -(-rows // ROWS_PER_RANGE))
    numbered = (sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"]))
                .drop(sources["source"]).filter("size > 0")
                .withColumn("spread", F.xxhash64(F.lit(seed), "doc_id", "version"))
                .withColumn("range", F.pmod(F.col("spread"), F.lit(ranges))))
    sums = numbered.groupBy("source_no", "range").agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("source_no").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source_no", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = W.partitionBy("source_no", "range").orderBy("spread", "doc_id", "version", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = numbered.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, ["source_no", "range"]).withColumn("first", F.col("before") + F.col("inside"))
    return written(placed.select("doc_id", "version", "source_no", "size", "first"), "streams")


def cut(streamed: DataFrame, block_words: int = BLOCK_WORDS, words: Column | None = None) -> DataFrame:
    """Pieces of documents in blocks: block, number of words and, with ``words``, the words themselves."""
    last = F.floor((F.col("first") + F.col("size") - 1) / block_words)
    blocks = streamed.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block_words), last)))
    start = F.greatest(F.col("first"), F.col("block") * block_words)
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block_words)
    kept = ["doc_id", "source_no", "first", "block", start.alias("start"), (end - start).alias("words")]
    if words is not None:
        kept.append(F.array_join(F.slice(words, (start - F.col("first") + 1).cast("int"), (end - start).cast("int")), " ").alias("piece"))
    return blocks.select(*kept)


def with_words(streamed: DataFrame, docs: DataFrame) -> DataFrame:
    """Joins each placed document with the words of its text; the texts are shuffled once, equal rows meet one copy."""
    id_, version = F.coalesce("doc_id", F.lit(-1)), F.xxhash64("text")
    texts = docs.select(id_.alias("id"), version.alias("version"), "text").dropDuplicates(["id", "version"])
    return (streamed.withColumn("id", id_).join(texts.hint("merge"), ["id", "version"])
            .withColumn("all", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).drop("id", "text"))


def filled(spark: SparkSession, pieces: DataFrame, made: Plan, shard_blocks: int) -> DataFrame:
    """The slots of the mix with the pieces of the block that each takes, joined by source and index of the block."""
    columns = [c for c in ("start", "doc_id", "first", "words", "piece") if c in pieces.columns]
    # A block has at most as many pieces as words.
    blocks = pieces.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("pieces"))
    return slots(spark, made, shard_blocks).join(blocks.hint("merge"), ["source_no", "block"])


def taken(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target and taken.

    The same slots and blocks as those of ``mix``, joined without the words.
    """
    spark = docs.sparkSession
    sized = counted(docs)
    made = plan(sized, block_words=block_words)
    sources = source_table(spark, made)
    streamed = streams(sized, sources, sized.count())
    used = (filled(spark, cut(streamed, block_words), made, shard_blocks).select("source_no", F.explode("pieces").alias("p"))
            .groupBy("source_no", F.col("p.first").alias("first")).agg(F.sum("p.words").alias("taken")))
    # A document's source and first word name its place in the streams.
    used = (streamed.join(used, ["source_no", "first"], "left").join(F.broadcast(sources), "source_no")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))
    empty = (sized.filter("size = 0").join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"]))
             .select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
    return used.unionByName(empty)


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mixed corpus: one row per slot with its text and the documents it comes from."""
    spark = docs.sparkSession
    sized = counted(few(docs))
    made = plan(sized, block_words=block_words)
    sources = source_table(spark, made)
    streamed = streams(sized, sources, sized.count())
    pieces = cut(with_words(streamed, docs), block_words, F.col("all"))
    joined = filled(spark, pieces, made, shard_blocks).join(F.broadcast(sources), "source_no")
    return few(joined.select(
        "shard", "slot", "source", "block", F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.words").alias("piece_words"),
        F.array_join("pieces.piece", " ").alias("text")), PARTITIONS_PER_FILE)
