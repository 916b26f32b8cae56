"""Short license notices in texts, exact or with a bounded number of edits.

Texts and notices are reduced to their words, one space apart. A notice that
may have k edits is split into k + 1 parts; an occurrence holds at least one of
them unchanged (pigeonhole), so an automaton of all parts finds every candidate
place. There the regex library's bounded-error matching verifies the edits and
reports the span. Base phrases are notices with no edits that must stand on
whole words.

Edge cases: null and empty texts have no words and no labels; a notice that
overlaps another occurrence of itself counts from its first place; repeated
documents are scanned each time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexigrove.llm.shared import pieces, word_bytes

# --- fixed values: phrases and notices with their labels ---
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
}
LETTERS_PER_EDIT = 12


@dataclass
class Notice:
    """A phrase, its label, the edits it may have and its parts with their offsets."""

    phrase: str
    label: str
    edits: int
    base: bool = False

    def __post_init__(self):
        n, k = len(self.phrase), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        self.parts = [(self.phrase[a:b], a) for a, b in zip(cuts, cuts[1:])]

    def pattern(self):
        if not self.edits:
            return regex.compile(r"(?<![^ ])" + regex.escape(self.phrase) + r"(?![^ ])")
        return regex.compile(f"(?:{regex.escape(self.phrase)}){{e<={self.edits}}}", regex.ENHANCEMATCH)


def notices(base: dict[str, str] | None = None, fuzzy: dict[str, str] | None = None) -> list[Notice]:
    return [*(Notice(p, label, 0, True) for p, label in (BASE if base is None else base).items()),
            *(Notice(p, label, max(1, len(p) // LETTERS_PER_EDIT)) for p, label in (NOTICES if fuzzy is None else fuzzy).items())]


class Scanner:
    """Finds notices in one text; built once per task."""

    def __init__(self, wanted: list[Notice]):
        self.wanted = wanted
        self.patterns = [n.pattern() for n in wanted]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(wanted):
            for part, offset in notice.parts:
                places.setdefault(part, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for part, uses in places.items():
            self.automaton.add_word(part, (len(part), uses))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Stretches of the text that may hold each notice, merged."""
        found: dict[int, list[list[int]]] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for number, offset in uses:
                notice = self.wanted[number]
                start = end + 1 - length - offset
                # The word check on the right reads the next character, even without edits.
                a, b = max(0, start - notice.edits), start + len(notice.phrase) + max(1, notice.edits)
                own = found.setdefault(number, [])
                own.append((a, b))
        merged = {}
        for number, own in found.items():
            own.sort()
            joined = [list(own[0])]
            for a, b in own[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            merged[number] = [tuple(x) for x in joined]
        return merged

    def scan(self, text: str) -> list[dict]:
        """Verified occurrences: notice number, first and last character, edits."""
        out = []
        for number, stretches in sorted(self.windows(text).items()):
            pattern, edits = self.patterns[number], self.wanted[number].edits
            for a, b in stretches:
                for hit in pattern.finditer(text, a, min(b, len(text)), overlapped=not edits):
                    out.append({"notice": number, "start": hit.start(), "end": hit.end(), "edits": sum(hit.fuzzy_counts) if edits else 0})
        return out


SPAN = "array<struct<label:string,first_word:long,last_word:long,edits:int>>"


def scan(docs: DataFrame, wanted: list[Notice] | None = None) -> DataFrame:
    """Per document: words, base places, labels, score and the spans of all occurrences in words."""
    chosen = notices() if wanted is None else wanted
    kind = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for part, texts in pieces(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                words = word_bytes(text)
                rows.append({"doc_id": doc_id, "n_words": len(words), **_summary(b" ".join(words).decode(), scanner)})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(
        run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}")


def _summary(text: str, scanner: Scanner) -> dict:
    hits = scanner.scan(text)
    if not hits:
        return {"n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
    spans, base, score = [], [], 0.0
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
    for hit in hits:
        notice = scanner.wanted[hit["notice"]]
        # A match may begin or end with the space beside a word.
        start = hit["start"] + (text[hit["start"]] == " ")
        first = int(np.searchsorted(spaces, start))
        last = first + text[start:hit["end"]].rstrip().count(" ")
        spans.append({"label": notice.label, "first_word": first, "last_word": last, "edits": hit["edits"]})
        score = max(score, 1 - hit["edits"] / len(notice.phrase))
        if notice.base:
            base.append((first, notice.label))
    firsts = [f for f, _ in base]
    return {"n_base": len(base), "first_word": min(firsts, default=None), "last_word": max(firsts, default=None),
            "base_labels": ",".join(sorted({label for _, label in base})), "labels": ",".join(sorted({s["label"] for s in spans})),
            "score": score, "spans": spans}
