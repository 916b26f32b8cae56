import datetime

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import audits, catalog, compare, joins, tags, topics
from lexigrove.plans import build
from lexigrove.sources import catalog_files, sinks, tables
from lexigrove.streaming import ingest, tags as stream_tags


def test_catalog_null_is_not_zero(spark, four):
    rows = four.withColumn("corpus", F.when(F.col("source") == "s1", "x").otherwise("y"))
    built = {r["source"]: r for r in catalog.catalog_sources(rows, ["y"]).collect()}
    assert built["s1"]["annotated"] == 2 and built["s1"]["annotation_distributions"]["content_type"] == {
        "news_report": 1, "opinion": 1, "creative": 1}
    assert built["s2"]["annotated"] is None and built["s2"]["annotation_distributions"] is None
    open_ = {r["source"]: r for r in catalog.catalog_sources(rows, []).collect()}
    assert open_["s2"]["annotation_distributions"]["content_type"] == {}


def test_shares_use_the_whole_corpus(spark):
    domains = spark.createDataFrame([("x", "A", 325), ("x", "B", 675), ("y", "A", 10)], "corpus string, name string, tokens bigint")
    got = {(r["corpus"], r["domain"]): (r["share"], r["of_max"]) for r in compare.domain_share(domains, "tokens", "A").collect()}
    assert got == {("x", "A"): (0.325, 1.0), ("y", "A"): (1.0, round(10 / 325, 6))}
    matrix = {r["domain"]: (r["x"], r["y"]) for r in compare.domain_matrix(domains, "tokens", ["x", "y"]).collect()}
    assert matrix == {"A": (325, 10), "B": (675, None)}


def test_unreported_is_the_rest(spark):
    schema = "corpus string, source string, domain string, records bigint, annotation_distributions map<string,map<string,bigint>>"
    rows = spark.createDataFrame([
        ("x", "a", "A", 8, {"q": {"good": 3}}), ("x", "b", "B", 2, {"q": {"poor": 1}}), ("y", "c", "A", 5, None)], schema)
    got = {(r["corpus"], r["value"]): (r["records"], r["share"], r["published"]) for r in compare.annotation_share(rows, "q").collect()}
    assert got == {("x", "good"): (3, 0.3, True), ("x", "poor"): (1, 0.1, True), ("x", "unreported"): (6, 0.6, True),
                   ("y", "unreported"): (5, 1.0, False)}


def test_domain_table(spark):
    lines = spark.createDataFrame([(s,) for s in (
        "intro [no](x)", "| Domain | Sources | N |", "|:--|:--|--:|", "| Books | [a](u), [b_1](v) | 3 |",
        "| News | [c-2](w) | 1 |", "| **Total** | [all](x) | 4 |", "| two | cells |")], "value string")
    mapping = catalog_files.domain_table(lines)
    assert {tuple(r) for r in mapping.collect()} == {("Books", "a"), ("Books", "b_1"), ("News", "c-2")}
    assert catalog_files.mapping_faults(mapping).isEmpty()
    bad = mapping.unionByName(spark.createDataFrame([("News", "a"), ("News", "s p")], "domain string, source string"))
    assert {r["source"] for r in catalog_files.mapping_faults(bad).collect()} == {"a", "s p"}


def test_annotations_attach_only_to_the_same_record(spark):
    texts = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c")], "source string, source_row bigint, id string")
    notes = spark.createDataFrame([("s", 0, "a", "good"), ("s", 1, "X", "poor"), ("t", 2, "c", "good")],
                                  "source string, row_index bigint, id string, content_quality string")
    notes = notes.withColumn("id_hash", F.sha2("id", 256))
    got = {r["id"]: (r["matched"], r["content_quality"])
           for r in joins.attach_if_identical(texts, notes, ["content_quality"]).collect()}
    assert got == {"a": (True, "good"), "b": (False, None), "c": (False, None)}


def texts_of(spark):
    return spark.createDataFrame(
        [("x", s, f"{s}{i}", i, 5, "t") for s in ("a", "b", "c") for i in range(3)],
        "corpus string, source string, id string, doc_id bigint, token_count bigint, text string")


def notes_of(spark, rows):
    return spark.createDataFrame(
        [("x", s, i, "good", None, None, None, None) for s, i in rows], tables.ANNOTATION_SCHEMA)


def test_ingest_resumes_and_refuses_duplicates(spark, tmp_path):
    texts = texts_of(spark)
    declared = spark.createDataFrame([("a", 9), ("b", 3), ("c", 5)], "source string, tokens bigint")
    target, state = str(tmp_path / "t"), str(tmp_path / "s")
    notes = notes_of(spark, [("a", "a0"), ("b", "b1")])
    first = build.ingest_pending(spark, declared.filter("source <> 'c'"), texts, notes, target, state)
    assert first == ["b", "a"]  # the smallest first
    with pytest.raises(ValueError):
        build.ingest_pending(spark, declared, texts, notes_of(spark, [("c", "c0"), ("c", "c0")]), target, state)
    assert build.ingest_pending(spark, declared, texts, notes, target, state) == ["c"]
    assert build.ingest_pending(spark, declared, texts, notes, target, state) == []
    rows = spark.read.parquet(target)
    assert rows.count() == 9 and rows.filter("content_quality = 'good'").count() == 2


def test_assembly_unites_and_numbers(spark):
    texts = texts_of(spark)
    parts = [texts.filter("source = 'b'"), texts.filter("source <> 'b'").withColumn("label", F.lit("x"))]
    got = build.assemble(parts).orderBy("record_no").collect()
    assert [(r["record_no"], r["source"], r["source_row"]) for r in got] == [
        (i, "abc"[i // 3], i % 3) for i in range(9)]
    assert {r["label"] for r in got if r["source"] == "b"} == {None}


def test_publication_needs_every_audit(spark, tmp_path):
    texts = texts_of(spark)
    manifest = str(tmp_path / "m")
    write = lambda df, folder: sinks.write_partitioned(df, folder, ["corpus", "source"])
    with pytest.raises(ValueError, match="keys"):
        build.publish(spark, manifest, texts, {"keys": audits.repeated(texts.union(texts), ["source", "id"])}, write)
    assert not tables.exists(spark, manifest)
    good = {"keys": audits.repeated(texts, ["source", "id"])}
    row = build.publish(spark, manifest, texts, good, write).first()
    assert row["records"] == 9 and row["status"] == "ready"
    # A writer that stores too little leaves the old version in place.
    with pytest.raises(ValueError, match="differ"):
        build.publish(spark, manifest, texts, good, lambda df, folder: write(df.limit(1), folder))
    assert build.published(spark, manifest).count() == 9
    # A source that is gone is gone in the next version too.
    fewer = texts.filter("source <> 'a'")
    assert build.publish(spark, manifest, fewer, good, write).first()["records"] == 6
    assert build.published(spark, manifest).select("source").distinct().count() == 2


def test_fingerprint_ignores_order_but_not_content(spark):
    texts = texts_of(spark)
    a = sinks.fingerprint(texts, ["source"], F.col("id"))
    b = sinks.fingerprint(texts.orderBy(F.desc("id")), ["source"], F.col("id"))
    assert sinks.compare_fingerprints(a, b, ["source"]).isEmpty()
    c = sinks.fingerprint(texts.withColumn("id", F.when(F.col("source") == "b", "z").otherwise(F.col("id"))), ["source"], F.col("id"))
    assert {tuple(r) for r in sinks.compare_fingerprints(a, c.filter("source <> 'a'"), ["source"]).collect()} == {
        ("b", "differs"), ("a", "missing")}


def test_source_sets_must_agree(spark, tmp_path):
    texts = texts_of(spark)
    for s in "abc":
        texts.filter(F.col("source") == s).repartition(2).write.parquet(str(tmp_path / s))
    globs = {s: [str(tmp_path / s)] for s in "abc"}
    rows = tables.per_source_files(spark, globs, texts, texts.schema)
    assert {(r["source"], r["id"]) for r in rows.collect()} == {(r["source"], r["id"]) for r in texts.collect()}
    with pytest.raises(ValueError):
        tables.per_source_files(spark, {"a": globs["a"]}, texts, texts.schema)


def at(second):
    return datetime.datetime(2024, 1, 1, 0, 0, second)


def test_tag_stream_equals_batch(spark, tmp_path):
    schema = stream_tags.TAG_SCHEMA
    first = spark.createDataFrame([(1, "ocr", at(5), 1), (2, "review", at(1), 2), (2, "", at(9), 3)], schema)
    late = spark.createDataFrame([(1, "privacy", at(3), 4), (2, "quality", at(4), 5), (3, "ocr", at(2), 6)], schema)
    inbox, store, log = (str(tmp_path / n) for n in ("inbox", "store", "log"))
    for part in (first, late):
        part.write.mode("append").parquet(inbox)
        stream_tags.upsert(spark, inbox, store, log)
    expected = {tuple(r) for r in tags.live(first.unionByName(late)).collect()}
    assert {tuple(r) for r in stream_tags.current(spark, store).collect()} == expected
    assert {r[0]: r[1] for r in expected} == {1: "ocr", 3: "ocr"}
    stream_tags.fold(spark, store)
    assert {tuple(r) for r in stream_tags.current(spark, store).collect()} == expected
    # A batch folder that a folding covers is not read any more; later batches are.
    first.limit(1).withColumn("tag", F.lit("wrong")).withColumn("event_id", F.lit(99).cast("bigint")).write.parquet(f"{store}/new/batch=0", mode="overwrite")
    assert {tuple(r) for r in stream_tags.current(spark, store).collect()} == expected
    late.withColumn("tag", F.lit("")).withColumn("saved_at", F.lit(at(30)).cast("timestamp_ntz")).write.mode("append").parquet(inbox)
    stream_tags.upsert(spark, inbox, store, log, fold_after=0)
    assert stream_tags.current(spark, store).collect() == []


def test_ingest_stream_survives_a_crash_before_its_commit(spark, tmp_path, monkeypatch):
    texts = texts_of(spark)
    notes = notes_of(spark, [("a", "a0"), ("b", "b1"), ("c", "c2")])
    inbox, target, log = (str(tmp_path / n) for n in ("inbox", "target", "log"))

    def run(given=notes):
        ingest.ingest(spark, inbox, texts.schema, given, target, log)

    def add(s):
        texts.filter(F.col("source") == s).coalesce(1).write.mode("append").parquet(inbox)

    add("a")
    run()
    run()
    add("b")
    with pytest.raises(Exception, match="Duplicate annotation ids"):
        run(notes.unionByName(notes))
    assert ingest.read(spark, target).count() == 3
    # The batch is written, but the job dies before the log says so.
    real = ingest.joins.attach_annotations

    def dies(rows, given):
        real(rows, given).write.mode("overwrite").partitionBy("source").parquet(f"{target}/batch=1")
        raise RuntimeError("executor lost")

    monkeypatch.setattr(ingest.joins, "attach_annotations", dies)
    with pytest.raises(Exception, match="executor lost"):
        run()
    monkeypatch.setattr(ingest.joins, "attach_annotations", real)
    run()
    add("c")
    run()
    rows = ingest.read(spark, target)
    assert rows.count() == 9 and rows.select("source", "id").distinct().count() == 9
    assert {r["id"] for r in rows.filter("content_quality = 'good'").collect()} == {"a0", "b1", "c2"}
    assert {(r["batch"], r["source"], r["records"]) for r in ingest.committed(spark, target).collect()} == {(0, "a", 3), (1, "b", 3), (2, "c", 3)}


def test_manifests_are_never_changed(spark, tmp_path):
    texts = texts_of(spark)
    path = str(tmp_path / "m")
    write = lambda df, folder: sinks.write_partitioned(df, folder, ["corpus", "source"])
    good = {"keys": audits.repeated(texts, ["source", "id"])}
    build.publish(spark, path, texts, good, write, "r1")
    build.publish(spark, path, texts.filter("source <> 'a'"), good, write, "r2")
    assert build.versions(spark, path) == [1, 2]
    assert (build.published(spark, path).count(), build.published(spark, path, "r1").count()) == (6, 9)
    with pytest.raises(LookupError):
        build.published(spark, path, "r3")
    # A changed text is another content, though ids and counts agree.
    changed = texts.withColumn("text", F.when(F.col("id") == "a1", "other").otherwise(F.col("text")))
    assert build.describe(texts, "x", "ready").first()["fingerprint"] != build.describe(changed, "x", "ready").first()["fingerprint"]
    with pytest.raises(ValueError, match="differ"):
        build.publish(spark, path, texts, good, lambda df, folder: write(changed, folder))
    assert build.versions(spark, path) == [1, 2]


def test_label_position_is_the_upper_median(spark):
    points = spark.createDataFrame(
        [(1, float(i), float(-i)) for i in range(20)] + [(2, float(i), 0.0) for i in range(21)] + [(3, 1.0, 1.0)],
        "topic_id bigint, x double, y double")
    got = {r["topic_id"]: (r["x"], r["y"]) for r in topics.label_positions(points).collect()}
    assert got == {1: (10.0, -9.0), 2: (10.0, 0.0)}


def test_topic_model(work):
    model = work.fitted
    ids = {r["topic_id"] for r in model.labelled.select("topic_id").distinct().collect()} - {-1}
    assert 0 < len(ids) <= 28
    assert {r["topic_id"] for r in model.centroids.collect()} == ids
    assert audits.topic_faults(work.records, model.assignments, work.vectors, sorted(ids)).isEmpty()
    assert model.points.count() == model.labelled.count()


def test_reduce_topics_keeps_every_record(work):
    reduced = topics.reduce_topics(work.labelled, 64, 3)
    assert reduced.count() == work.labelled.count()
    assert reduced.select("topic_id").distinct().count() == 3


def test_zero_vectors_have_no_topic(work):
    some = work.vectors.filter("record_no % 9 = 0")
    zeroed = some.withColumn("vec", F.transform("vec", lambda _: F.lit(0.0)))
    vectors = work.vectors.filter("record_no % 9 <> 0").unionByName(zeroed)
    found = topics.assign_records(work.records, vectors, work.topic_centers)
    assert found.count() == work.records.count()
    zero = found.join(zeroed.select("record_no"), "record_no", "left_semi")
    assert zero.count() > 0 and zero.filter("topic_id <> -1").isEmpty()


def test_texts_of_the_topic_sample_are_not_shuffled(spark):
    from lexigrove.plans.topic_model import sample_texts
    from lexigrove.session import checkpointed

    records = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(100)], "record_no long, text string")
    texts = sample_texts(records, checkpointed(spark.createDataFrame([(3,), (5,), (500,)], "record_no long")))
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, texts.collect())) == [(3, None), (5, "t5")]
