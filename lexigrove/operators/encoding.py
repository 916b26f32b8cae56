"""Document and query vectors from weighted word vectors.

The vocabulary holds every word of the corpus, so it grows with it. Its size is
checked: within the bound it is broadcast once and every task encodes its own
records in Arrow batches, so texts are neither joined nor shuffled. Beyond the
bound the most frequent words that fit are broadcast, and only the rare words
left are joined with the rest of the vocabulary and summed by record.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from lexigrove import fixed
from lexigrove.functions import text as text_fn, vectors as vec
from lexigrove.functions.vectors import lists_of
from lexigrove.session import local_table, scratch, settle

VOCABULARY_BYTES = 256 * 1024 * 1024
TOKENS_PER_BLOCK = 16_384


def weighted_vocabulary(raw: DataFrame, offset: int = fixed.VOCAB_RANK_OFFSET) -> DataFrame:
    """``word, rank, raw`` → unit vectors times ``rank / (rank + offset)``.

    Words are lower-cased; of equal words the first with a non-zero vector stays.
    Words are counted without their vectors; only vectors of repeated words move.
    """
    usable = raw.select(F.lower("word").alias("word"), "rank", "raw").filter(vec.is_usable(F.col("raw")))
    repeated = settle(usable.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("word").alias("again")))
    same = F.col("word").eqNullSafe(F.col("again"))
    chosen = usable.join(repeated, same, "left_semi").groupBy("word").agg(F.min(F.struct("rank", "raw")).alias("f"))
    first = usable.join(repeated, same, "left_anti").unionByName(chosen.select("word", "f.rank", "f.raw"))
    weight = F.col("rank") / (F.col("rank") + offset)
    return first.select(
        "word", "rank", weight.alias("weight"), vec.scaled(vec.normalised(F.col("raw")), weight).alias("vec"))


def dimensions(vocabulary: DataFrame) -> int:
    row = vocabulary.select(F.size("vec").alias("n")).first()
    return row["n"] if row else 0


def split(vocabulary: DataFrame, row_bytes: int, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent words that fit the bound, and the others (``None``: all fit).

    Frequency is the ``rank`` of the vocabulary; without usable ranks no word is among the first.
    """
    if vocabulary.count() * row_bytes <= bound:
        return vocabulary, None
    if "rank" in vocabulary.columns:
        first = F.coalesce(F.col("rank") <= bound // row_bytes, F.lit(False))
        near = vocabulary.filter(first)
        if near.count() * row_bytes <= bound:
            return near, vocabulary.filter(~first)
    return vocabulary.limit(0), vocabulary


def shared(vocabulary: DataFrame, size: int) -> Broadcast:
    """Words and their matrix of ``size`` columns as a broadcast."""
    rows = vocabulary.select("word", "vec").toArrow()
    matrix = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, size)
    return vocabulary.sparkSession.sparkContext.broadcast((rows["word"].combine_chunks(), matrix))


def _known(tokens: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and vocabulary index of every known word of a batch, in row order."""
    lengths = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False)
    found = pc.index_in(tokens.flatten().cast(words.type), value_set=words)
    keep = found.is_valid().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(tokens)), lengths)[keep]
    return rows, found.drop_null().to_numpy(zero_copy_only=False)


def _fold(tokens: pa.Array, words: pa.Array, table: np.ndarray, fold: np.ufunc, start: float) -> np.ndarray:
    """Folds the table rows of all words of each record."""
    rows, index = _known(tokens, words)
    out = np.full((len(tokens), table.shape[1]), start)
    for begin in range(0, len(rows), TOKENS_PER_BLOCK):
        part = rows[begin:begin + TOKENS_PER_BLOCK]
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        folded = fold.reduceat(table[index[begin:begin + TOKENS_PER_BLOCK]], edges, axis=0)
        out[part[edges]] = fold(out[part[edges]], folded)
    return out


def encoder(vocabulary: Broadcast):
    """Arrow function: word lists → unit vectors; zero without a known word."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def encode(tokens: pa.Array) -> pa.Array:
        words, table = vocabulary.value
        total = _fold(tokens, words, table, np.add, 0.0)
        return lists_of(total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12))

    return encode


def _parted(tokens: DataFrame, words: Broadcast, fold: np.ufunc) -> DataFrame:
    """Folded vectors of the broadcast words (``near``) and the other words of each row (``rest``), written once.

    The rows get a number of their own (``row``), so that equal or absent keys stay apart.
    """
    @F.arrow_udf(T.StructType([
        T.StructField("near", T.ArrayType(T.DoubleType())), T.StructField("rest", T.ArrayType(T.StringType()))]))
    def part(lists: pa.Array) -> pa.Array:
        known, table = words.value
        lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        other = pc.is_null(pc.index_in(flat.cast(known.type), value_set=known))
        owner = np.repeat(np.arange(len(lists)), lengths)[other.to_numpy(zero_copy_only=False)]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lists)))]).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(offsets), flat.filter(other).cast(pa.string()))
        return pa.StructArray.from_arrays([lists_of(_fold(lists, known, table, fold, 0.0)), rest], names=["near", "rest"])

    spark = tokens.sparkSession
    path = scratch(spark, "parted")
    kept = [c for c in tokens.columns if c != "tokens"]
    parted = tokens.withColumn("lexigrove_part", part(F.col("tokens"))).select(
        *kept, F.monotonically_increasing_id().alias("lexigrove_row"), "lexigrove_part.near", "lexigrove_part.rest")
    parted.write.parquet(path)
    return spark.read.schema(parted.schema).parquet(path)


def encode_documents(records: DataFrame, vocabulary: DataFrame, key: str = "record_no",
                     bound: int = VOCABULARY_BYTES, keep: Sequence[str] = ()) -> DataFrame:
    """Whole texts → unit document vectors, next to the columns of ``keep``.

    Words meet a vocabulary too large to broadcast by word, but only those that
    are not among its most frequent ones: they are few in each text, so few
    vectors move.
    """
    size = dimensions(vocabulary)
    tokens = records.select(key, *keep, text_fn.words(F.col("text")).alias("tokens"))
    near, far = split(vocabulary, size * 8 + 64, bound)
    words = shared(near, size)
    if far is None:
        return tokens.select(key, encoder(words)(F.col("tokens")).alias("vec"), *keep)
    parted = _parted(tokens, words, np.add)
    counted = parted.select("lexigrove_row", F.explode(text_fn.term_counts(F.col("rest"))).alias("t")).select(
        "lexigrove_row", F.col("t.term").alias("word"), F.col("t.tf").alias("n"))
    sums = counted.join(far.select("word", "vec"), "word").groupBy("lexigrove_row").agg(*[
        F.sum(F.get("vec", F.lit(i)) * F.col("n")).alias(f"lexigrove_{i}") for i in range(size)])
    total = F.array(*[F.get("near", F.lit(i)) + F.coalesce(f"lexigrove_{i}", F.lit(0.0)) for i in range(size)])
    return parted.join(sums, "lexigrove_row", "left").select(key, vec.normalised(total).alias("vec"), *keep)


def encode_long_documents(records: DataFrame, vocabulary: DataFrame,
                          chars: int = fixed.PART_CHARS, key: str = "record_no") -> DataFrame:
    """Texts in parts: each part becomes a unit vector, parts are added by length."""
    parts = records.select(key, F.posexplode(text_fn.text_parts(F.col("text"), chars)).alias("part", "text"))
    parts = parts.withColumn("place", F.struct(F.col(key), F.col("part"), F.char_length("text").alias("chars")))
    encoded = encode_documents(parts, vocabulary, "place")
    # An empty part adds a zero vector; a weight of 0 would leave some records without any sum.
    weight = F.greatest(F.col("place.chars"), F.lit(1)).cast("double")
    total = Summarizer.metrics("sum").summary(array_to_vector("vec"), weight)
    sums = encoded.groupBy(F.col(f"place.{key}").alias(key)).agg(vector_to_array(total["sum"]).alias("total"))
    return sums.select(key, vec.normalised(F.col("total")).alias("vec"))


@dataclass
class Query:
    """Known words of a query: how often each occurs and its weighted vector."""

    words: list[str]
    counts: list[int]
    vectors: np.ndarray

    def vector(self) -> list[float]:
        total = np.asarray(self.counts, dtype=np.float64) @ self.vectors
        return [float(x) for x in total / max(float(np.linalg.norm(total)), 1e-12)]


def query_of(text: str, vocabulary: DataFrame) -> Query | None:
    """Looks up the few words of a query; ``None`` if none is known."""
    spark = vocabulary.sparkSession
    row = local_table(spark, [(text,)], "q string").select(text_fn.words(F.col("q")).alias("w")).first()
    asked = list(row["w"])
    found = {r["word"]: r["vec"] for r in vocabulary.filter(F.col("word").isin(asked)).collect()}
    known = [w for w in dict.fromkeys(asked) if w in found]
    if not known:
        return None
    return Query(known, [asked.count(w) for w in known], np.asarray([found[w] for w in known]))


def query_vector(text: str, vocabulary: DataFrame) -> list[float] | None:
    """Unit vector of a query; ``None`` if no word is known."""
    query = query_of(text, vocabulary)
    return query.vector() if query else None


def concept_coverage(tokens: DataFrame, query: Query, vocabulary: DataFrame, key: str = "record_no",
                     bound: int = VOCABULARY_BYTES) -> DataFrame:
    """How well the known words of a record cover the words of a query: ``key, tokens`` → ``key, coverage``.

    For each query word the best cosine to any word of the record, clipped to
    0..1, averaged with the query words' weights. The cosines of all vocabulary
    words to the query words are computed once; within the bound they are
    broadcast, beyond it only those of the most frequent words are, and the
    records' other words are joined with theirs.
    """
    weights = np.linalg.norm(query.vectors, axis=1)
    size = len(weights)
    ranked = [c for c in ("rank",) if c in vocabulary.columns]
    similar = vocabulary.select("word", *ranked, vec.cosines_with(query.vectors)(F.col("vec")).alias("vec"))
    near, far = split(similar, size * 8 + 64, bound)
    known = shared(near, size)
    if far is not None:
        parted = _parted(tokens.select(key, "tokens"), known, np.maximum)
        words = parted.select("lexigrove_row", F.explode(F.array_distinct("rest")).alias("word")).join(far, "word")
        best = words.groupBy("lexigrove_row").agg(*[F.max(F.get("vec", F.lit(i))).alias(f"lexigrove_{i}") for i in range(size)])
        clipped = [F.least(F.lit(1.0), F.greatest(F.get("near", F.lit(i)), F.coalesce(f"lexigrove_{i}", F.lit(0.0)))) for i in range(size)]
        share = sum((c * float(w / weights.sum()) for c, w in zip(clipped, weights)), F.lit(0.0))
        return parted.join(best, "lexigrove_row", "left").select(key, share.alias("coverage"))

    @F.arrow_udf(T.DoubleType())
    def coverage(lists: pa.Array) -> pa.Array:
        words, table = known.value
        best = _fold(lists, words, table, np.maximum, 0.0)
        return pa.array(np.clip(best, 0, 1) @ weights / weights.sum())

    return tokens.select(key, coverage(F.col("tokens")).alias("coverage"))
