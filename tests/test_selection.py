import pytest
from pyspark.sql import functions as F

from lexigrove.operators import browse, selection, stats


def numbers(df):
    return sorted(r["record_no"] for r in df.select("record_no").collect())


@pytest.mark.parametrize("filters, expected", [
    ({}, [0, 1, 2, 3]),
    ({"source": "", "min_tokens": None}, [0, 1, 2, 3]),
    ({"source": "s1"}, [0, 1]),
    ({"source": "nowhere"}, []),
    ({"source": "s' OR '1'='1"}, []),
    ({"pii_presence": "no_pii"}, [0, 3]),
    ({"pii_presence": "__missing__"}, [2]),
    ({"content_type": "opinion"}, [1]),
    ({"content_type": "__missing__"}, [2, 3]),
    ({"min_tokens": 50, "max_tokens": "100"}, [1, 3]),
    ({"min_tokens": 0}, [0, 1, 2, 3]),
    ({"annotation_key": "educational_value", "annotation_value": "none"}, [1, 3]),
    ({"content_quality": "good", "annotation_key": "content_quality", "annotation_value": "poor"}, []),
    ({"annotation_key": "content_type", "annotation_value": "__missing__", "domain": "News"}, [2, 3]),
])
def test_selection(four, filters, expected):
    assert numbers(selection.select(four, filters)) == expected


@pytest.mark.parametrize("filters", [
    {"min_tokens": -1}, {"max_tokens": 100_000_001}, {"min_tokens": "many"},
    {"annotation_key": "unknown", "annotation_value": "x"}, [],
])
def test_invalid_filters_are_refused(four, filters):
    with pytest.raises(ValueError):
        selection.select(four, filters)


def test_topic_numbers():
    assert selection.topic_number("3", {3}) == 3
    assert selection.topic_number(-1, {3}) == -1
    for wrong in (True, 3.0, "03", "x", 4, None):
        with pytest.raises(ValueError):
            selection.topic_number(wrong, {3})


def test_topic_filter_is_a_semi_join(spark, four):
    topics = spark.createDataFrame([(0, 1), (1, -1), (2, 1), (3, 2)], "record_no bigint, topic_id bigint")
    assert numbers(selection.select(four, {"topic_id": 1}, topics)) == [0, 2]
    assert numbers(selection.select(four, {"topic_id": -1}, topics)) == [1]
    assert numbers(selection.select(four, {"topic_id": 1, "domain": "News"}, topics)) == [2]


def test_scope(spark):
    sources = spark.createDataFrame([("da", "a", "Books"), ("da", "b", "News")], "corpus string, source string, domain string")
    assert selection.corpus_scope(sources, "da", "a", "News").isEmpty()
    assert selection.corpus_scope(sources, "da", domain="News").first()["source"] == "b"
    with pytest.raises(ValueError):
        selection.corpus_scope(sources, "da", "zzz")


def test_no_filter_needs_no_eligible_set(four):
    assert selection.eligible(four, {"source": ""}) is None
    assert numbers(selection.eligible(four, {"domain": "News"})) == [2, 3]


def test_totals(four):
    assert stats.totals(four).first().asDict() == {"records": 4, "tokens": 1160, "sources": 2, "annotated": 3}
    empty = stats.totals(four.filter("false")).first().asDict()
    assert empty == {"records": 0, "tokens": 0, "sources": 0, "annotated": 0}


def test_repeated_label_counts_once(four):
    found = {r["name"]: (r["records"], r["covered"]) for r in stats.annotation_distribution(four, "content_type").collect()}
    assert found == {"news_report": (1, 2), "opinion": (1, 2), "creative": (1, 2), "__missing__": (2, 2)}


def test_histogram_keeps_empty_bins_and_overflow(spark, four):
    extra = four.limit(1).withColumn("token_count", F.lit(2 ** 40).cast("long"))
    rows = stats.length_histogram(four.unionByName(extra)).orderBy("bin").collect()
    assert len(rows) == 22 and rows[0]["records"] == 1 and rows[-1]["records"] == 1
    assert (rows[0]["min"], rows[0]["max"]) == (0, 15) and sum(r["records"] for r in rows) == 5
    shown = stats.shown_histogram(stats.length_histogram(four))
    assert shown.agg(F.max("max")).first()[0] == 1023
    assert stats.token_range(shown, 2, 3) == (32, 127)


def test_power_bins(spark):
    from lexigrove.fixed import POWER_EDGES

    rows = spark.createDataFrame([(t,) for t in (0, 16, 49, 64, 64)], "token_count bigint")
    found = {r["min"]: r["records"] for r in stats.length_histogram(rows, POWER_EDGES).collect() if r["records"]}
    assert len(POWER_EDGES) - 1 == 29
    assert found == {0: 1, 16: 1, 32: 1, 64: 2}


def test_published_fallback(spark):
    schema = "corpus string, source string, records bigint, annotation_distributions map<string,map<string,bigint>>"
    rows = spark.createDataFrame([
        ("x", "a", 10, {"q": {"good": 4, "poor": 1}}), ("x", "b", 5, {"q": {}}), ("y", "c", 7, None)], schema)
    found = {r["name"]: r["records"] for r in stats.published_fallback(rows, "q").collect()}
    assert found == {"good": 4, "poor": 1, "__missing__": 10}
    with pytest.raises(ValueError):
        stats.published_fallback(rows, "q", {"min_tokens": 3})


def test_pages(four):
    assert [r["record_no"] for r in browse.page(four, "longest", 0, 3).collect()] == [2, 3, 1]
    assert [r["record_no"] for r in browse.page(four, "shortest", 1, 2).collect()] == [1, 3]
    assert browse.page_probe(four, "original", 0, 3).count() == 4
    assert browse.envelope(four, 3, 3).first().asDict() == {
        "total": 4, "page_rows": 1, "has_more": False, "next_offset": 4}
    assert browse.envelope(four, 9, 3).first()["page_rows"] == 0
    assert [r["record_no"] for r in browse.jump(four, 99, 4).collect()] == [3]
    for wrong in (("sideways", 0, 3), ("original", -1, 3), ("original", 0, 0), ("original", 0, 102)):
        with pytest.raises(ValueError):
            browse.page(four, *wrong)
    with pytest.raises(LookupError):
        browse.full_record(four, 12)


@pytest.mark.parametrize("sort", ["original", "shortest", "longest"])
def test_deep_page_equals_sorted_page(spark, sort):
    # One length holds most rows, as a dominant value would.
    rows = spark.range(4000).select(
        ((F.col("id") * 7919) % 4000).alias("record_no"),
        F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 17).cast("long").alias("token_count"))
    for offset in (0, 1999, 2660, 3990, 5000):
        plain = [r["record_no"] for r in rows.orderBy(*browse.orders()[sort]).offset(offset).limit(20).collect()]
        deep = [r["record_no"] for r in browse.deep_page(rows, sort, offset, 20, 64).collect()]
        assert deep == plain


def test_statistics_come_from_one_scan(four):
    cube = stats.cube(four)
    assert cube.agg(F.sum("records"), F.sum("tokens"), F.sum("annotated")).first()[:] == (4, 1160, 3)


def test_topic_filters_refuse_what_is_no_topic(spark, four):
    topics = spark.createDataFrame([(0, 2), (1, 2), (2, -1)], "record_no bigint, topic_id int")
    assert selection.select(four, {"topic_id": "2"}, topics).count() == 2
    assert selection.select(four, {"topic_id": -1}, topics).count() == 1
    for wrong in (2.9, True, 77, "x"):
        with pytest.raises(ValueError):
            selection.select(four, {"topic_id": wrong}, topics)


def test_a_missing_source_is_no_source(spark, four):
    rows = four.withColumn("source", F.when(F.col("source") == "s1", F.col("source")))
    assert stats.totals(rows).first()["sources"] == 1


def test_all_asked_ids_are_returned(spark):
    rows = spark.range(100).withColumnRenamed("id", "record_no")
    assert browse.by_ids(rows, list(range(50))).count() == 50
