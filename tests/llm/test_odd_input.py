"""Columns of the user named like helpers, equal rows in numbers, very long texts."""

import time

import pytest

from lexigrove.llm import decontamination, jaccard_join, line_spread, notices, pseudonyms, suffix_dedup

NAMES = ["_id", "_version", "_places", "_found", "_new", "root", "first", "n_shingles", "version", "places"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    texts = ["menu line\nown text one", "menu line\nown text two", "write to ann@example.org today", passage, passage, passage + " more", None, ""]
    rows = [(i, t, "en", f"s{i % 4}", 1, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def kept_columns(rows):
    return all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES)


def test_columns_of_the_user_stay(spark, docs):
    lines = line_spread.without_boilerplate(docs, 2).collect()
    assert len(lines) == 8 and kept_columns(lines)
    assert {r["doc_id"]: r["kept"] for r in lines}[0] == "own text one"
    left = jaccard_join.one_of_each(docs, 5, 80).collect()
    assert sorted(r["doc_id"] for r in left) == [0, 1, 2, 3, 6, 7] and kept_columns(left) and left[0].asDict().keys() == set(docs.columns)
    bench = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(10, 30)), "x")], "item_id long, text string, _id string")
    clean = decontamination.clean(docs, bench).collect()
    assert sorted(r["doc_id"] for r in clean) == [0, 1, 2, 6, 7] and kept_columns(clean)
    hidden = pseudonyms.pseudonymised(docs).collect()
    assert kept_columns(hidden) and sum(r["n_values"] for r in hidden) == 1


def test_many_equal_rows_take_linear_time(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 13) % 26) for i in range(12_000))
    rows = [(5, text)] * 600 + [(6, text[2000:5000]), (7, "short")]
    started = time.time()
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed").collect()
    assert time.time() - started < 60
    assert sorted(map(tuple, got)) == [(5, 12_000, 12_000)] * 600 + [(6, 3000, 3000), (7, 5, 0)]


def test_a_long_text_of_notices_takes_linear_time(spark):
    n = 80_000
    started = time.time()
    row = notices.scan(spark.createDataFrame([(1, "MIT License " * n)], "doc_id long, text string")).drop("spans").first()
    assert time.time() - started < 30
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (2 * n, n, 0, 2 * n - 2)


def test_threshold_grows_with_the_sites(spark):
    def docs(sites):
        return spark.createDataFrame([(i, f"menu\nown {i}", f"s{i}") for i in range(sites)] + [(99, "menu", None)], "doc_id long, text string, source string")

    assert [line_spread.threshold(docs(n)) for n in (0, 4, 7, 20)] == [3, 3, 4, 10]
    few = line_spread.without_boilerplate(docs(2)).agg({"n_removed": "sum"}).first()[0]
    some = line_spread.without_boilerplate(docs(4)).agg({"n_removed": "sum"}).first()[0]
    assert (few, some) == (0, 5)


def test_stages_on_odd_tables(spark, docs, tmp_path):
    import corpus_pipeline

    long = "a plain word " * 30_000
    odd = docs.withColumnsRenamed({"_id": "score", "_version": "kept", "_places": "Score_"}).unionByName(
        docs.filter("doc_id in (3, 6)").withColumnsRenamed({"_id": "score", "_version": "kept", "_places": "Score_"}))
    odd = odd.unionByName(spark.createDataFrame([(50, long, "en", "s1", 1, *["x"] * 10), (None, "own words", "en", None, 1, *["x"] * 10)], odd.schema))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (0, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(10, 30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (odd, odd.limit(0)):
        kept = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == rows.columns, name
            found = out.collect()
            assert (len(found) > 0) == (rows is odd)
            assert all(r["score"] in (f"_id{r['doc_id']}", "x") and r["kept"] in (f"_version{r['doc_id']}", "x") for r in found), name
        assert len(corpus_pipeline.mixed(spark, kept, str(tmp_path)).collect()) >= 0
