"""Pages of records in a stable order, and identity-checked text reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexigrove import fixed
from lexigrove.functions import text as text_fn
from lexigrove.operators.numbering import SPAN_WIDTH, running_before, span_of
from lexigrove.session import settle

# Up to this depth each task keeps a heap of the page; beyond it, counts by
# value range find the few rows of the page first.
SHALLOW_ROWS = 10_000

# So many folders may be named to a scan; hits in more of them touch most of the table anyway.
MOST_SPANS = 10_000


def orders() -> dict[str, list[Column]]:
    return {
        "original": [F.col("record_no").asc()],
        "shortest": [F.col("token_count").asc(), F.col("record_no").asc()],
        "longest": [F.col("token_count").desc(), F.col("record_no").asc()],
    }


def check_page(offset: int, limit: int, most: int = 101) -> None:
    """At most 100 rows, and one more to learn whether another page follows."""
    if offset < 0 or not 1 <= limit <= most:
        raise ValueError("a page needs an offset of 0 or more and a limit within its bound")


def page(df: DataFrame, sort: str, offset: int = 0, limit: int = fixed.PAGE_SIZE,
         span: int = 100_000) -> DataFrame:
    check_page(offset, limit)
    if sort not in orders():
        raise ValueError(f"pages cannot be ordered by {sort!r}")
    if offset + limit <= SHALLOW_ROWS:
        return df.orderBy(*orders()[sort]).offset(offset).limit(limit)
    return deep_page(df, sort, offset, limit, span)


def deep_page(df: DataFrame, sort: str, offset: int, limit: int, span: int = 100_000) -> DataFrame:
    """The same page, found by counting instead of by sorting down to it.

    Rows are counted per ``(token_count, record_no range)``. The running count
    tells which of these cells the page touches; only those rows are sorted,
    and a cell never holds more than ``span`` rows.
    """
    by_length = {"original": F.lit(0), "shortest": F.col("token_count"), "longest": -F.col("token_count")}[sort]
    keyed = df.withColumn("major", by_length.cast("long")).withColumn(
        "minor", F.floor(F.col("record_no") / span).cast("long"))
    # Two steps keep the ordered summary small: first whole lengths, then the
    # ranges inside the few lengths the page touches.
    majors = keyed.groupBy("major").agg(F.count("*").alias("rows"))
    majors = _touched(majors, ["major"], offset, limit)
    cells = keyed.join(F.broadcast(majors.select("major")), "major", "left_semi")
    cells = cells.groupBy("major", "minor").agg(F.count("*").alias("rows"))
    base = majors.agg(F.min("before").alias("b")).first()["b"] or 0
    cells = _touched(cells, ["major", "minor"], offset - base, limit)
    first = cells.agg(F.min("before").alias("b")).first()["b"] or 0
    picked = keyed.join(F.broadcast(cells.select("major", "minor")), ["major", "minor"], "left_semi")
    return (
        picked.drop("major", "minor").orderBy(*orders()[sort]).offset(offset - base - first).limit(limit)
    )


def _touched(counts: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    """Summary rows that overlap the page; at most ``limit`` plus one of them."""
    running = settle(counts).withColumn("before", running_before("rows", keys))
    return settle(running.filter(
        (F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)))


def page_probe(df: DataFrame, sort: str, offset: int, limit: int) -> DataFrame:
    """One row more than the page, to learn whether another page follows."""
    return page(df, sort, offset, limit + 1)


def envelope(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Total, rows on the page, whether more follow, and the next offset: one count."""
    total = F.col("total")
    shown = F.greatest(F.lit(0).cast("long"), F.least(F.lit(limit).cast("long"), total - offset))
    return df.agg(F.count("*").alias("total")).select(
        "total", shown.alias("page_rows"),
        (F.lit(offset) + shown < total).alias("has_more"),
        (F.lit(offset) + shown).alias("next_offset"),
    )


def jump(df: DataFrame, record_no: int, total: int, limit: int = fixed.PAGE_SIZE) -> DataFrame:
    """The page that starts at a record number, clamped to the corpus."""
    start = min(max(record_no, 0), max(total - 1, 0))
    return df.filter((F.col("record_no") >= start)).orderBy("record_no").limit(limit)


def page_across_sources(df: DataFrame, sources: DataFrame, offset: int, limit: int) -> DataFrame:
    """Walks whole sources in order and slices by position: the data is not sorted.

    ``sources`` (``source, records``) lists the selected sources. The rows
    wanted from each source are known from the counts alone, so the scan is a
    predicate on ``source`` and ``source_row``.
    """
    ahead = sources.withColumn("ahead", running_before("records", ["source"]))
    slices = ahead.select(
        "source", "ahead",
        F.greatest(F.lit(offset) - F.col("ahead"), F.lit(0)).alias("from_row"),
        F.least(F.lit(offset + limit) - F.col("ahead"), F.col("records")).alias("to_row"),
    ).filter("from_row < to_row")
    wanted = F.lit(False)
    for row in slices.collect():  # at most one entry per row of the page
        wanted = wanted | (
            (F.col("source") == row["source"])
            & (F.col("source_row") >= row["from_row"])
            & (F.col("source_row") < row["to_row"])
        )
    return df.filter(wanted)


def lookup(records: DataFrame, hits: DataFrame, width: int = SPAN_WIDTH) -> DataFrame:
    """The records whose numbers are in ``hits``, a computed table with ``record_no``.

    A table with a ``span`` folder per ``width`` numbers is opened only in the
    folders of the hits; the numbers themselves are joined, never listed.
    """
    if "span" in records.columns:
        spans = hits.select(span_of(F.col("record_no"), width).alias("span")).distinct().limit(MOST_SPANS + 1).collect()
        if len(spans) <= MOST_SPANS:
            records = records.filter(F.col("span").isin([r["span"] for r in spans]))
    return records.join(hits.select("record_no"), "record_no", "left_semi")


def enrich(hits: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the records behind a page or a bounded result list, which is computed once."""
    found = settle(hits)
    return found.join(lookup(records, found).select("record_no", *columns), "record_no")


def by_ids(df: DataFrame, record_nos: list[int]) -> DataFrame:
    """All records with the given numbers."""
    return df.filter(F.col("record_no").isin(record_nos))


def full_record(df: DataFrame, record_no: int) -> DataFrame:
    """All columns of one record, read from its span folder."""
    found = df.filter(F.col("record_no") == record_no)
    if "span" in df.columns:
        found = found.filter(F.col("span") == record_no // SPAN_WIDTH).drop("span")
    if found.isEmpty():
        raise LookupError(f"no record has the number {record_no}")
    return found


def original_text(keys: DataFrame, records: DataFrame) -> DataFrame:
    """Texts by ``(source, id)``; NULL where there is no such record."""
    return keys.join(records.select("source", "id", "text"), ["source", "id"], "left")


def original_checked(records: DataFrame, source: str, row: int, identifier: str) -> DataFrame:
    """Text at a position, only if the id there is the expected one."""
    found = records.filter((F.col("source") == source) & (F.col("source_row") == row) & (F.col("id") == identifier))
    if found.isEmpty():
        raise LookupError("another record stands at this position")
    return found.select("source", "source_row", "id", "text")


def previews(df: DataFrame, record_nos: list[int]) -> DataFrame:
    return by_ids(df, record_nos).select("record_no", "id", text_fn.preview_prefix(F.col("text")).alias("preview"))
