"""Dense numbers, offsets, pages and runs without any group-wide sort.

A source may hold a third of all rows, so nothing here sorts or counts a whole
source in one task. Rows are dealt out by ranges of their order or position; the
per-range counts are a small summary, and their running sums turn a number
inside a range into a number inside the source and in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexigrove.session import scratch, settle

RANGE_WIDTH = 200_000

# Records per span: tables that are read by record number have one folder per span.
SPAN_WIDTH = 20_000


def span_of(record_no: Column, width: int = SPAN_WIDTH) -> Column:
    return F.floor(record_no / width).cast("long")


def running_before(value: str, order: list, partition: list | None = None):
    window = W.partitionBy(*(partition or [])).orderBy(*order)
    return F.coalesce(
        F.sum(value).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    ).cast("long")


def source_offsets(sources: DataFrame) -> DataFrame:
    """Catalog-sized table ``source, records`` → plus ``offset``."""
    return sources.withColumn("offset", running_before("records", ["source"]))


def dense_numbers(df: DataFrame, group: str, position: str) -> DataFrame:
    """Adds ``record_no`` (0-based overall, by group and position) and ``source_row`` (0-based in the group).

    Positions may be sparse, negative or texts; repeated rows and null groups are
    numbered like others. Ranges come from a sample of the order itself, so their
    size depends neither on the gaps between positions nor on a dominant group.
    """
    placed = ordered(df, F.col(group).asc_nulls_first(), F.col(position).asc_nulls_first(), name="record_no")
    firsts = settle(placed.groupBy(F.col(group).alias("lexigrove_group")).agg(F.min("record_no").alias("lexigrove_first")))
    return (
        placed.join(firsts, F.col(group).eqNullSafe(F.col("lexigrove_group")))
        .withColumn("source_row", F.col("record_no") - F.col("lexigrove_first"))
        .drop("lexigrove_group", "lexigrove_first")
    )


def number_by_file_position(df: DataFrame, source: str = "source") -> DataFrame:
    """Numbers rows of per-source files by their place in the file: no shuffle.

    ``df`` comes straight from a file scan and carries ``file_path`` and
    ``row_index``. Only one count per file is aggregated; the rows themselves
    are never moved.
    """
    files = settle(df.groupBy(source, "file_path").agg(F.count("*").alias("records")))
    starts = files.select(
        source, "file_path",
        running_before("records", ["file_path"], [source]).alias("file_offset"),
        running_before("records", [source, "file_path"]).alias("corpus_offset"),
    )
    return (
        df.join(starts, [source, "file_path"])
        .withColumn("source_row", F.col("file_offset") + F.col("row_index"))
        .withColumn("record_no", F.col("corpus_offset") + F.col("row_index"))
        .drop("file_offset", "corpus_offset")
    )


def locate(positions: DataFrame, offsets: DataFrame, cells: int = 4096) -> DataFrame:
    """Global position → source and row inside it.

    A range join written as an equi-join: the number line is cut into at most
    ``cells`` pieces, each source is listed under the pieces it touches, and a
    position looks only at the sources of its own piece.
    """
    spans = offsets.select("source", "offset", "records").filter("records > 0")
    total = spans.agg(F.max(F.col("offset") + F.col("records")).alias("n")).first()["n"] or 1
    width = max(1, -(-total // cells))
    touched = spans.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("offset") / width),
        F.floor((F.col("offset") + F.col("records") - 1) / width),
    )))
    return (
        positions.withColumn("cell", F.floor(F.col("position") / width))
        .join(settle(touched), "cell")
        .filter((F.col("position") >= F.col("offset")) & (F.col("position") < F.col("offset") + F.col("records")))
        .select("position", "source", (F.col("position") - F.col("offset")).alias("row_index"))
    )


def to_global(locations: DataFrame, offsets: DataFrame) -> DataFrame:
    """Source and row inside it → global position; rows outside the source drop."""
    return (
        locations.join(offsets.select("source", "offset", "records"), "source")
        .filter((F.col("row_index") >= 0) & (F.col("row_index") < F.col("records")))
        .select("source", "row_index", (F.col("offset") + F.col("row_index")).alias("position"))
    )


def range_groups(positions: DataFrame, size: int = 30, width: int = RANGE_WIDTH) -> DataFrame:
    """Runs of neighbouring positions, each at most ``size`` long.

    Input ``source, position`` (duplicates allowed). A run may cross range
    borders or fill a whole source: the start of a run is carried from range to
    range over the small range summary only.
    """
    spanned = positions.withColumn("span", F.floor(F.col("position") / width).cast("long"))
    inside = W.partitionBy("source", "span").orderBy("position")
    # A repeated position follows itself; it is dropped without a shuffle of its own.
    starts = spanned.withColumn("before", F.lag("position").over(inside)).filter(
        F.col("before").isNull() | (F.col("before") < F.col("position"))
    ).withColumn("start", F.when(F.col("before").isNull() | (F.col("before") + 1 < F.col("position")), F.col("position")))
    run = starts.withColumn("start", F.last("start", ignorenulls=True).over(
        inside.rowsBetween(W.unboundedPreceding, 0)))
    edges = run.groupBy("source", "span").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.max("start").alias("last_start"),
    )
    by_span = W.partitionBy("source").orderBy("span")
    edges = edges.withColumn("joined", F.coalesce(F.lag("last").over(by_span) + 1 == F.col("first"), F.lit(False)))
    # A range that is one single run joined to the left passes the start on.
    opened = F.when(~(F.col("joined") & (F.col("last_start") == F.col("first"))), F.col("last_start"))
    carried = F.last(opened, ignorenulls=True).over(by_span.rowsBetween(W.unboundedPreceding, -1))
    edges = settle(edges.select("source", "span", "first", F.when(F.col("joined"), carried).alias("carried")))
    true_start = F.when(F.col("start") == F.col("first"), F.coalesce("carried", "start")).otherwise(F.col("start"))
    return (
        run.join(edges, ["source", "span"])
        .withColumn("run_start", true_start)
        .withColumn("piece", F.floor((F.col("position") - F.col("run_start")) / size))
        .groupBy("source", "run_start", "piece")
        .agg(F.min("position").alias("offset"), F.count("*").alias("length"))
        .select("source", "offset", "length")
    )


def ordered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """The rows with their 0-based place in an order over all of them.

    Ranges of the order are sorted side by side and stored; the rows of each
    range are counted, and the counts before a range shift its own numbers. No
    task ever holds more than its range. Rows equal in ``order`` get neighbouring
    places in any order.
    """
    spark = df.sparkSession
    path = scratch(spark, "ordered")
    # The upper bits are the range, the lower ones the place inside it.
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path).withColumn("lexigrove_range", F.shiftright(name, 33))
    counts = settle(stored.groupBy("lexigrove_range").agg(F.count("*").alias("rows")))
    before = counts.select("lexigrove_range", running_before("rows", ["lexigrove_range"]).alias("lexigrove_before"))
    return (
        stored.join(settle(before), "lexigrove_range")
        .withColumn(name, F.col("lexigrove_before") + F.col(name) - F.shiftleft(F.col("lexigrove_range"), 33))
        .drop("lexigrove_range", "lexigrove_before")
    )


def sample_per_group(df: DataFrame, group: str, key: str, count: int, seed: int) -> DataFrame:
    """At most ``count`` rows per group in a seeded pseudo-random order.

    ``row_number() <= count`` lets Spark keep only each task's best ``count``
    rows per group before the shuffle, so a dominant group stays cheap.
    """
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")))
    ranked = df.withColumn("draw", F.row_number().over(W.partitionBy(group).orderBy(order, F.col(key))))
    return ranked.filter(F.col("draw") <= count).drop("draw")
