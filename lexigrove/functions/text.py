"""Text functions on string columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from lexigrove import fixed

# --- fixed values: word patterns ---------------------------------------------
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’][\p{L}\p{Nl}\p{No}]+)?"
TOPIC_RUN = r"(?<![\p{L}\p{N}_])[\p{L}\p{Nl}\p{No}]{3,}+(?![\p{L}\p{N}_])"
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
EMAIL = r"[A-Za-z0-9.+_-]+@[A-Za-z0-9-]+\.[A-Za-z]+"


def words(text: Column) -> Column:
    """Lower-cased letter runs, an inner apostrophe kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def topic_terms(text: Column, stop_words: Sequence[str] = fixed.TOPIC_STOP_WORDS) -> Column:
    """Runs of at least three letters with no digit or underscore next to them,
    function words removed. The pattern does the work; the word list is a hash set."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(TOPIC_RUN), F.lit(0))
    return F.filter(runs, lambda t: ~t.isin(*stop_words)) if stop_words else runs


def preview_prefix(text: Column) -> Column:
    return F.substring(text, 1, fixed.PREVIEW_CHARS)


def preview_snippet(text: Column, terms: Sequence[str]) -> Column:
    """A window that opens a little before the first hit of any longer term."""
    long_terms = [t.strip('"').lower() for t in terms if len(t) > 2]
    hits = [F.nullif(F.instr(F.lower(text), t), F.lit(0)) - 1 for t in long_terms]
    first = F.least(*hits) if len(hits) > 1 else hits[0] if hits else F.lit(0)
    start = F.greatest(F.lit(0), F.coalesce(first, F.lit(0)) - fixed.SNIPPET_LEAD)
    body = F.substring(text, start + 1, F.lit(fixed.PREVIEW_CHARS))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), body)


def display_title(preview: Column, description: Column, identifier: Column,
                  chars: int = fixed.TITLE_CHARS) -> Column:
    """First line with visible text, of the preview, else the description, else the id."""
    shown = F.coalesce(F.nullif(preview, F.lit("")), F.nullif(description, F.lit("")), identifier)
    lines = F.filter(F.split(shown, "\n"), lambda s: s.rlike(f"[^{SPACE}]"))
    return F.coalesce(F.nullif(F.substring(F.get(lines, F.lit(0)), 1, chars), F.lit("")), identifier)


def text_chunk(text: Column, offset: int, limit: int) -> dict[str, Column]:
    """A slice with what a reader needs to ask for the next one."""
    chunk = F.substring(text, offset + 1, limit)
    total = F.char_length(text)
    return {
        "chunk": chunk,
        "text_length": total.cast("long"),
        "next_offset": (F.lit(offset) + F.char_length(chunk)).cast("long"),
        "has_more": total > offset + limit,
    }


def excerpt(text: Column, limit: int = 6000, part: int = 2000) -> Column:
    """Start, middle and end of a long text; short texts whole."""
    size = F.char_length(text)
    middle = F.floor(size / 2).cast("int") - part // 2 + 1
    return F.when(size <= limit, text).otherwise(F.concat_ws(
        "\n",
        F.substring(text, 1, part),
        F.substring(text, middle, F.lit(part)),
        F.right(text, F.lit(part)),
    ))


def preview_squash(text: Column, read: int = 1000, keep: int = 260) -> Column:
    collapsed = F.regexp_replace(F.substring(text, 1, read), f"[{SPACE}]+", " ")
    return F.substring(F.trim(collapsed), 1, keep)


def text_parts(text: Column, chars: int = fixed.PART_CHARS) -> Column:
    """Consecutive parts that together hold every character."""
    last = F.floor((F.greatest(F.char_length(text), F.lit(1)) - 1) / chars)
    return F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda i: F.substring(text, i * chars + 1, F.lit(chars)),
    )


def record_key(source: Column, identifier: Column) -> Column:
    return F.concat_ws("/", source, identifier)


def split_key(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, "/", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def identity_hash(identifier: Column) -> Column:
    return F.sha2(identifier, 256)


def clean_markdown(text: Column) -> Column:
    linked = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    plain = F.regexp_replace(linked, r"\[([^\]]+)\]", "$1")
    return F.regexp_replace(plain, f"^[{SPACE}]+|[{SPACE}]+$", "")


def term_positions(tokens: Column) -> Column:
    """Array of ``(term, positions)`` for one record, counted from 0, without a shuffle."""
    placed = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("position"))))
    size = F.size(tokens)

    def runs(w: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), size),
            lambda i: (i == 0) | (i == size) | (F.get(w, i)["term"] != F.get(w, i - 1)["term"]),
        )
        return F.transform(F.array(starts), lambda s: F.transform(
            F.sequence(F.lit(0), F.size(s) - 2),
            lambda j: F.struct(
                F.get(w, F.get(s, j))["term"].alias("term"),
                F.slice(w, F.get(s, j) + 1, F.get(s, j + 1) - F.get(s, j))["position"].alias("positions"),
            ),
        ))

    found = F.get(F.flatten(F.transform(F.array(placed), runs)), F.lit(0))
    return F.when(size > 0, found)


def term_counts(tokens: Column) -> Column:
    """Array of ``(term, tf)`` for one record, without a shuffle.

    All words of a record sit in one row, so sorting the array and measuring
    its runs counts them in place; no group-by has to move every word.
    """
    ordered = F.sort_array(tokens)
    size = F.size(tokens)

    def runs(w: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), size),
            lambda i: (i == 0) | (i == size) | (F.get(w, i) != F.get(w, i - 1)),
        )
        return F.transform(F.array(starts), lambda s: F.transform(
            F.sequence(F.lit(0), F.size(s) - 2),
            lambda j: F.struct(
                F.get(w, F.get(s, j)).alias("term"),
                (F.get(s, j + 1) - F.get(s, j)).cast("long").alias("tf"),
            ),
        ))

    counted = F.get(F.flatten(F.transform(F.array(ordered), runs)), F.lit(0))
    return F.when(size > 0, counted)
