import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import labels, text, vectors


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


TEXTS = ["Blåbær og rødgrød 42 det's l’été", "Ⅷ ½ x_y a-b c'd'e", "", "Æøå'", "ab1c 中文 naïve"]


@pytest.mark.parametrize("value", TEXTS)
def test_words_equal_the_letter_run_rule(spark, value):
    expected = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", value.lower())
    assert one(spark, value, text.words(F.col("t"))) == expected


@pytest.mark.parametrize("value", TEXTS + ["alpha al alpha_1 alphabet og ikke alphabet2"])
def test_topic_terms(spark, value):
    from lexigrove.fixed import TOPIC_STOP_WORDS

    expected = [w for w in re.findall(r"(?u)\b[^\W\d_]{3,}\b", value.lower()) if w not in TOPIC_STOP_WORDS]
    assert one(spark, value, text.topic_terms(F.col("t"))) == expected


def test_term_counts(spark):
    from collections import Counter

    for value in ("a b a c b a", "solo", "", "x x x x"):
        got = one(spark, value, text.term_counts(text.words(F.col("t")))) or []
        assert {r["term"]: r["tf"] for r in got} == Counter(value.split())


def test_term_positions(spark):
    for value in ("a b a c b a", "solo", "", "x x x x"):
        got = one(spark, value, text.term_positions(text.words(F.col("t")))) or []
        expected = {}
        for place, word in enumerate(value.split()):
            expected.setdefault(word, []).append(place)
        assert {r["term"]: r["positions"] for r in got} == expected


def test_snippet(spark):
    body = "x" * 300 + " Needle " + "y" * 900
    got = one(spark, body, text.preview_snippet(F.col("t"), ["absent", "needle", "ab"]))
    start = body.lower().find("needle") - 110
    assert got == "…" + body[start:start + 700]
    assert one(spark, "short needle", text.preview_snippet(F.col("t"), ["needle"])) == "short needle"
    assert one(spark, body, text.preview_snippet(F.col("t"), ["absent"])) == body[:700]
    assert one(spark, body, text.preview_snippet(F.col("t"), ["ab"])) == body[:700]


def test_chunks_lose_nothing(spark):
    body = "".join(chr(0x1F600 + i % 50) if i % 3 else "ø" for i in range(95))
    pieces, offset, more = [], 0, True
    while more:
        row = spark.createDataFrame([(body,)], "t string").select(
            *[c.alias(n) for n, c in text.text_chunk(F.col("t"), offset, 20).items()]).first()
        pieces.append(row["chunk"])
        offset, more = row["next_offset"], row["has_more"]
    assert "".join(pieces) == body and row["text_length"] == 95


@pytest.mark.parametrize("size", [10, 6000, 6001, 7003])
def test_excerpt(spark, size):
    body = "".join(chr(97 + i % 26) for i in range(size))
    middle = size // 2
    expected = body if size <= 6000 else body[:2000] + "\n" + body[middle - 1000:middle + 1000] + "\n" + body[-2000:]
    assert one(spark, body, text.excerpt(F.col("t"))) == expected


@pytest.mark.parametrize("body", ["", "abc", "a" * 10, "a" * 11, "ab" * 17])
def test_parts(spark, body):
    got = one(spark, body, text.text_parts(F.col("t"), 10))
    assert "".join(got) == body and all(len(p) == 10 for p in got[:-1])


def test_titles_and_squash(spark):
    title = text.display_title(F.col("t"), F.lit("about"), F.lit("id-1"))
    assert one(spark, "\n  \nFirst line\nsecond", title) == "First line"
    assert one(spark, "", title) == "about"
    assert one(spark, None, title) == "about"
    assert one(spark, "  \n ", title) == "id-1"
    odd = "  a\t\n b  c  "
    assert one(spark, odd, text.preview_squash(F.col("t"))) == " ".join(odd.split())
    assert one(spark, " [n](u) [m] \n", text.clean_markdown(F.col("t"))) == "n m"


def test_labels(spark):
    assert one(spark, "no_pii", labels.pretty_label(F.col("t"))) == "No PII flagged"
    assert one(spark, "news_report_x", labels.pretty_label(F.col("t"))) == "News report x"
    assert one(spark, "", labels.to_sentinel(F.col("t"))) == "__missing__"
    assert one(spark, "__missing__", labels.from_sentinel(F.col("t"))) is None
    source, rest = text.split_key(F.col("t"))
    assert one(spark, "s/a/b", rest) == "a/b" and one(spark, "s/a/b", source) == "s"


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "n int, v array<double>")
    v = F.col("v")
    got = {r["n"]: r for r in rows.select(
        "n", vectors.norm(v).alias("norm"), vectors.normalised(v).alias("unit"), vectors.is_usable(v).alias("ok"),
        vectors.cosine_with([0.0, 2.0])(v).alias("c")).collect()}
    assert got[1]["norm"] == 5 and got[1]["unit"] == [0.6, 0.8] and got[1]["ok"] and abs(got[1]["c"] - 0.8) < 1e-12
    assert got[2]["unit"] == [0.0, 0.0] and not got[2]["ok"] and got[2]["c"] == 0
    near = rows.select("n", vectors.nearest_in([7, 3], [[0.0, 1.0], [0.0, 2.0]])(v).alias("x")).collect()
    assert {r["n"]: r["x"]["cell"] for r in near} == {1: 3, 2: -1}
    bad = spark.createDataFrame([([float("nan")],), ([float("inf")],), ([1.0],)], "v array<double>")
    assert [r[0] for r in bad.select(vectors.is_finite(v)).collect()] == [False, False, True]


def test_word_pattern_matches_unicode_categories():
    assert unicodedata.category("½") == "No" and unicodedata.category("Ⅷ") == "Nl"
