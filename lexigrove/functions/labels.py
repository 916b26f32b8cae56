"""Annotation label functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexigrove import fixed


def is_missing(field: str) -> Column:
    """NULL, or for a multi-label field also an empty list."""
    if field in fixed.MULTI_LABEL_FIELDS:
        return F.col(field).isNull() | (F.size(field) == 0)
    return F.col(field).isNull()


def has_label(field: str, value: str) -> Column:
    if value == fixed.MISSING:
        return is_missing(field)
    if field in fixed.MULTI_LABEL_FIELDS:
        return F.array_contains(field, value)
    return F.col(field) == F.lit(value)


def label_array(field: str) -> Column:
    """The distinct labels of one record; the sentinel where there is none."""
    if field in fixed.MULTI_LABEL_FIELDS:
        return F.when(is_missing(field), F.array(F.lit(fixed.MISSING))).otherwise(F.array_distinct(field))
    return F.array(F.coalesce(F.col(field), F.lit(fixed.MISSING)))


def to_sentinel(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(fixed.MISSING))


def from_sentinel(value: Column) -> Column:
    return F.nullif(value, F.lit(fixed.MISSING))


def pretty_label(value: Column) -> Column:
    # --- fixed values: display names of reserved labels ---
    spaced = F.translate(value, "_", " ")
    return (
        F.when(value == "__missing__", "Not annotated")
        .when(value == "contains_pii", "PII flagged")
        .when(value == "no_pii", "No PII flagged")
        .otherwise(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.char_length(spaced))))
    )


def source_name(identifier: Column) -> Column:
    return F.translate(identifier, "_-", "  ")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, 1))
