"""Helpers that several operators share: tables, word bytes, scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexigrove.session import scratch

# Bytes that a task works on at once.
CHUNK_BYTES = 4 << 20
# Shuffle partitions, whose number is set for texts, that make one file of a narrow table.
PARTITIONS_PER_FILE = 8
# The same for tables that are made without a shuffle: about 128 MB of texts.
PARTITIONS_PER_TASK = 16
# Row groups of a table whose rows are large: a reader holds whole groups.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Computes a table once in the shared folder: it cuts the lineage and has a known size."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done.scratch_path = path
    return done


def narrow(df: DataFrame) -> DataFrame:
    """Rows of a few numbers in fewer partitions, and so fewer files: each file is a task and, where Hadoop has no native code, six processes."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(-(-partitions // PARTITIONS_PER_FILE))


def few(df: DataFrame, per_task: int = PARTITIONS_PER_TASK) -> DataFrame:
    """The same rows, not shuffled, in fewer tasks and so fewer files, but in several for each core."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-partitions // per_task)))


def discarded(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _kept(keep) -> bytes:
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    return bytes(b if keep(b) else 32 for b in lower)


# UTF-8 bytes of a text to its words: A-Z becomes a-z, everything that is no
# part of a word becomes a space. Bytes of 0x80 and above are parts of words.
WORD_BYTES = _kept(lambda b: b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122)
SPACED_BYTES = _kept(lambda b: True)


def word_bytes(text: bytes | None) -> list[bytes]:
    """Words of letters, digits and bytes of 0x80 and above, lower-cased in A-Z."""
    return text.translate(WORD_BYTES).split() if text else []


def places_of(asked: list[bytes], terms: pa.Array) -> np.ndarray:
    """The place of each asked term among those of a block, -1 if it is not there."""
    return pa.compute.fill_null(pa.compute.index_in(pa.array(asked, terms.type), value_set=terms), -1).to_numpy()


def raw(column: pa.Array) -> pa.Array:
    """A text column as bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches whose texts have about ``most`` bytes, with those texts as bytes.

    A single longer text is a slice of its own.
    """
    for batch in batches:
        column = raw(batch.column(batch.schema.get_field_index(text)))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(first, last - first), column.slice(first, last - first).to_pylist()
            first = last


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them; another for each seed."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo a divisor."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor
