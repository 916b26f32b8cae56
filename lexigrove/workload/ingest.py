"""Scans, sources, sinks, numbering, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrove import fixed
from lexigrove.functions import text as text_fn, vectors as vec
from lexigrove.operators import browse, catalog, joins, keyword, numbering, selection, similarity, tags
from lexigrove.plans import build
from lexigrove.plans.workspace import Workspace, documents
from lexigrove.session import scratch
from lexigrove.sources import catalog_files, sinks, tables
from lexigrove.streaming import ingest as stream_ingest, tags as stream_tags
from lexigrove.workload.registry import query

LABELS = ["content_quality", "content_safety", "pii_presence", "content_length"]


# --- scans -----------------------------------------------------------------------

@query("scan_with_row_position", "SELECT doc_id, row_number() OVER () - 1 AS row_index FROM documents")
def scan_with_row_position(w: Workspace) -> DataFrame:
    return tables.with_position(w.spark, f"{w.folder}/documents.parquet").select("doc_id", "row_index")


@query("scan_union_by_name", "SELECT record_no, corpus, content_quality, pii_presence FROM records", "records")
def scan_union_by_name(w: Workspace) -> DataFrame:
    plain = w.records.filter(F.col("corpus") == "fr").select("record_no", "corpus")
    labelled = w.records.filter(F.col("corpus") != "fr").select("record_no", "corpus", "content_quality", "pii_presence")
    return tables.union_by_name([labelled, plain])


@query("scan_projected_batches",
       "SELECT id, length(text) AS chars, md5(text) AS digest, token_count FROM records", "records")
def scan_projected_batches(w: Workspace) -> DataFrame:
    rows = w.records.select("id", "text", "token_count")
    return rows.select("id", F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("digest"), "token_count")


def _source_files(w: Workspace) -> str:
    path = scratch(w.spark, "per-source")
    docs = documents(w.spark, w.folder)
    sinks.write_partitioned(docs, path, ["source"], F.floor(F.col("doc_id") / numbering.RANGE_WIDTH))
    return path


@query("scan_multi_file_source", "SELECT source, doc_id, length(text) AS chars FROM documents")
def scan_multi_file_source(w: Workspace) -> DataFrame:
    path = _source_files(w)
    names = [r["source"] for r in w.source_table.select("source").collect()]
    rows = tables.per_source_files(
        w.spark, {s: [f"{path}/source={s}"] for s in names}, w.source_table,
        documents(w.spark, w.folder).schema)
    return rows.select("source", "doc_id", F.char_length("text").cast("long").alias("chars"))


def _annotation_table(w: Workspace) -> DataFrame:
    return w.records.filter(~F.col("corpus").isin("fr") & F.col("content_quality").isNotNull()).select(
        *[f.name for f in tables.ANNOTATION_SCHEMA])


@query("optional_annotation_source", """
    SELECT record_no, content_quality, len(content_type) AS labels FROM records""", "records")
def optional_annotation_source(w: Workspace) -> DataFrame:
    path = scratch(w.spark, "annotations")
    _annotation_table(w).write.parquet(path)
    present = tables.optional_annotations(w.spark, path)
    absent = tables.optional_annotations(w.spark, path + "-absent")
    texts = w.records.select("record_no", "corpus", "source", "id")
    return joins.attach_annotations(texts, present.unionByName(absent)).select(
        "record_no", "content_quality", F.size("content_type").cast("long").alias("labels"))


@query("catalog_json_source", "SELECT corpus, source, name, domain, records, tokens, annotated FROM catalog", "catalog")
def catalog_json_source(w: Workspace) -> DataFrame:
    path = scratch(w.spark, "catalog")
    sinks.export_json(catalog.as_datasets(w.sources), path)
    return catalog_files.sources_of(catalog_files.read_catalog(w.spark, path))


@query("source_domain_mapping", "SELECT DISTINCT domain, source FROM records", "records")
def source_domain_mapping(w: Workspace) -> DataFrame:
    listed = w.source_table.groupBy("domain").agg(
        F.array_join(F.array_sort(F.collect_list(F.format_string("[%s](data/%s.md)", "source", "source"))), ", ").alias("s"),
        F.sum("records").alias("n"))
    lines = listed.select(F.format_string("| %s | %s | %d |", "domain", "s", "n").alias("value"))
    head = listed.select(F.explode(F.array(
        F.lit("| Domain | Sources | N. |"), F.lit("|:---|:---|---:|"), F.lit("| **Total** | all | 1 |"), F.lit("other text"),
    )).alias("value"))
    path = scratch(w.spark, "card")
    lines.unionByName(head).write.text(path)
    mapping = catalog_files.domain_table(w.spark.read.text(path))
    if not catalog_files.mapping_faults(mapping).isEmpty():
        raise ValueError("A source appears in several domain rows")
    return mapping


@query("source_card_defaults", """
    SELECT source,
      CASE WHEN domain = 'Books' THEN 'Pretty ' || source ELSE source END AS name,
      CASE WHEN domain = 'News' THEN domain WHEN domain = 'Books' THEN 'Header ' || domain ELSE 'Other' END AS domain,
      CASE WHEN domain = 'News' THEN 'CC0' WHEN domain = 'Books' THEN 'MIT' ELSE 'See source' END AS license
    FROM (SELECT DISTINCT source, domain FROM records)""", "records")
def source_card_defaults(w: Workspace) -> DataFrame:
    cards = w.source_table.filter("domain = 'News'").select("source", "domain", F.lit("CC0").alias("license"))
    headers = w.source_table.filter("domain = 'Books'").select(
        "source", F.concat(F.lit("Pretty "), "source").alias("pretty_name"),
        F.concat(F.lit("Header "), "domain").alias("domain"), F.lit("MIT").alias("license"))
    return catalog_files.card_defaults(w.source_table, cards, headers)


# --- sinks and build state ---------------------------------------------------------

@query("sink_partitioned_parquet", """
    SELECT corpus, source, count(*) AS records, CAST(sum(token_count) AS BIGINT) AS tokens
    FROM records GROUP BY corpus, source""", "records")
def sink_partitioned_parquet(w: Workspace) -> DataFrame:
    path = scratch(w.spark, "sink")
    sinks.write_partitioned(w.records, path, ["corpus", "source"], F.floor(F.col("source_row") / sinks.ROWS_PER_FILE))
    return w.spark.read.schema(w.records.schema).parquet(path).groupBy("corpus", "source").agg(
        F.count("*").alias("records"), F.sum("token_count").alias("tokens"))


LATER = "domain IN ('Books', 'Web', 'Other')"


@query("resume_pending_sources", f"""
    SELECT source, count(*) AS records, count(content_quality) AS annotated FROM records
    WHERE {LATER} GROUP BY source""", "records")
def resume_pending_sources(w: Workspace) -> DataFrame:
    target, state = scratch(w.spark, "resumed"), scratch(w.spark, "state")
    sinks.commit(w.spark, state, w.source_table.filter(f"NOT ({LATER})"))
    texts = w.records.select("corpus", "source", "id", "doc_id", "token_count", "text")
    build.ingest_pending(w.spark, w.source_table, texts, _annotation_table(w), target, state)
    if build.ingest_pending(w.spark, w.source_table, texts, _annotation_table(w), target, state):
        raise ValueError("A committed source was processed again")
    return w.spark.read.parquet(target).groupBy("source").agg(
        F.count("*").alias("records"), F.count("content_quality").alias("annotated"))


@query("replace_source", f"""
    SELECT source, count(*) AS records,
      CAST(sum(token_count + CASE WHEN {LATER} THEN 1 ELSE 0 END) AS BIGINT) AS tokens
    FROM records GROUP BY source""", "records")
def replace_source(w: Workspace) -> DataFrame:
    path = scratch(w.spark, "replaced")
    rows = w.records.select("source", "domain", "record_no", "token_count")
    sinks.replace_source(rows, path, ["source"])
    newer = rows.filter(LATER).withColumn("token_count", F.col("token_count") + 1)
    for _ in range(2):
        sinks.replace_source(newer, path, ["source"])
    return w.spark.read.schema(rows.schema).parquet(path).groupBy("source").agg(
        F.count("*").alias("records"), F.sum("token_count").alias("tokens"))


@query("smallest_source_first", """
    SELECT source, tokens, row_number() OVER (ORDER BY tokens, source) AS place FROM source_table
    WHERE domain NOT IN ('News', 'Web')""", "source_table")
def smallest_source_first(w: Workspace) -> DataFrame:
    from pyspark.sql import Window as W

    done = w.source_table.filter(F.col("domain").isin("News", "Web"))
    todo = sinks.pending(w.source_table, done)
    return todo.select("source", "tokens", F.row_number().over(W.orderBy("tokens", "source")).cast("long").alias("place"))


@query("validated_publish",
       "SELECT 'records' AS artefact, 'ready' AS status, 'v1' AS revision, count(*) AS records FROM records", "records")
def validated_publish(w: Workspace) -> DataFrame:
    from lexigrove.operators import audits

    checks = {
        "keys": audits.repeated(w.records, ["source", "id"]),
        "published": audits.counts_vs_published(w.records, w.sources),
        "tokens": audits.token_counts(w.records),
        "numbers": audits.boundary_numbers(w.records, w.source_table),
    }
    manifest = build.publish(
        w.spark, scratch(w.spark, "manifest"), w.records, checks,
        lambda df, folder: sinks.write_partitioned(df, folder, ["corpus", "source"]))
    return manifest.select("artefact", "status", "revision", "records")


_DIGEST = "CAST(('0x' || substr(sha256(source || '/' || id), 1, 8)) AS BIGINT)"


@query("snapshot_fingerprint", f"""
    SELECT corpus, source, count(*) AS rows, CAST(sum({_DIGEST}) AS BIGINT) AS digest
    FROM records GROUP BY corpus, source""", "records")
def snapshot_fingerprint(w: Workspace) -> DataFrame:
    return sinks.fingerprint(w.records, ["corpus", "source"], text_fn.record_key(F.col("source"), F.col("id")))


@query("fingerprint_verify", """
    SELECT source, CASE domain WHEN 'News' THEN 'missing' WHEN 'Books' THEN 'differs' ELSE 'duplicate' END AS status
    FROM source_table WHERE domain IN ('News', 'Books', 'Legal')
    UNION ALL SELECT source || '-x', 'extra' FROM source_table WHERE domain = 'Web'
    UNION ALL SELECT source, 'missing' FROM source_table WHERE domain = 'Web'""",
       "source_table")
def fingerprint_verify(w: Workspace) -> DataFrame:
    expected = sinks.fingerprint(w.records, ["source", "domain"], F.col("id"))
    kind = F.col("domain")
    altered = expected.filter(kind != "News").select(
        F.when(kind == "Web", F.concat("source", F.lit("-x"))).otherwise(F.col("source")).alias("source"), "domain",
        "rows", (F.col("digest") + F.when(kind == "Books", 1).otherwise(0)).alias("digest"))
    present = altered.unionByName(altered.filter(kind == "Legal"))
    return sinks.compare_fingerprints(expected, present, ["source"])


@query("source_counts_export", "SELECT corpus, source, records, tokens FROM catalog", "catalog")
def source_counts_export(w: Workspace) -> DataFrame:
    path = scratch(w.spark, "counts")
    sinks.export_json(w.sources.select("corpus", "source", "records", "tokens"), path)
    return w.spark.read.schema("corpus string, source string, records bigint, tokens bigint").json(path)


@query("review_tags_export", """
    SELECT t.record_no, r.id, r.source, 'v1' AS version, t.tag, CAST(epoch_us(t.saved_at) AS BIGINT) AS saved_us
    FROM last_tags t JOIN records r ON t.record_no = r.record_no WHERE t.tag <> ''""", "last_tags records")
def review_tags_export(w: Workspace) -> DataFrame:
    path = scratch(w.spark, "tags")
    rows = tags.export(tags.live(w.tag_writes), w.records, "v1")
    sinks.export_json(rows.withColumn("saved_us", _micros("saved_at")).drop("saved_at"), path)
    return w.spark.read.schema(
        "record_no bigint, id string, source string, version string, tag string, saved_us bigint").json(path)


def _micros(column: str):
    """Microseconds of a timestamp without zone, whatever the session's zone is."""
    return F.expr(
        f"unix_date(CAST({column} AS DATE)) * 86400000000L + (hour({column}) * 3600 + minute({column}) * 60) * 1000000L"
        f" + CAST(date_part('SECOND', {column}) * 1000000 AS BIGINT)")


# --- joins -------------------------------------------------------------------------

@query("join_annotations_left", "SELECT record_no, content_quality, pii_presence FROM records", "records")
def join_annotations_left(w: Workspace) -> DataFrame:
    texts = w.records.select("record_no", "corpus", "source", "id")
    return joins.attach_annotations(texts, _annotation_table(w)).select("record_no", "content_quality", "pii_presence")


@query("join_identity_checked", """
    SELECT record_no, domain <> 'Books' AS matched, CASE WHEN domain <> 'Books' THEN content_quality END AS content_quality
    FROM records""", "records")
def join_identity_checked(w: Workspace) -> DataFrame:
    wrong = F.when(F.col("domain") == "Books", F.lit("other")).otherwise(F.col("id"))
    notes = w.records.select(
        "source", F.col("source_row").alias("row_index"), text_fn.identity_hash(wrong).alias("id_hash"), "content_quality")
    texts = w.records.select("record_no", "source", "source_row", "id")
    return joins.attach_if_identical(texts, notes, ["content_quality"]).select("record_no", "matched", "content_quality")


@query("join_positional", """
    SELECT source, source_row, id AS text_id, CASE WHEN domain = 'Books' THEN 'other' ELSE NULL END AS metadata_id
    FROM records WHERE domain = 'Books' OR corpus = 'de'""", "records")
def join_positional(w: Workspace) -> DataFrame:
    meta = w.records.filter("domain = 'Books' OR corpus <> 'de'").select(
        "source", "source_row", F.when(F.col("domain") == "Books", "other").otherwise(F.col("id")).alias("id"))
    return joins.positional_mismatches(w.records, meta)


SEARCH = ["the", "market", "dans", "orre"]


def _hits(w: Workspace) -> DataFrame:
    return keyword.best(keyword.bm25(w.postings, w.term_stats, w.collection, SEARCH), 100)


HITS = """
    SELECT record_no, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
    FROM postings JOIN (
      SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avg_dl) AS avg_dl
      FROM postings, (SELECT count(*)::DOUBLE AS n, avg(token_count) AS avg_dl FROM records)
      WHERE term IN ({terms}) GROUP BY term, n) USING (term)
    WHERE term IN ({terms}) {{where}} GROUP BY record_no {{having}}"""


def hits_sql(terms: list[str], where: str = "", having: str = "") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return HITS.format(terms=listed).replace("{where}", where).replace("{having}", having)


TOP100 = f"SELECT * FROM ({hits_sql(SEARCH)}) ORDER BY score DESC, record_no LIMIT 100"


@query("join_enrich_ranked_key", f"""
    SELECT row_number() OVER (ORDER BY score DESC, h.record_no) AS rank, r.source, r.id, h.score, r.domain, r.token_count
    FROM ({TOP100}) h JOIN records r ON h.record_no = r.record_no WHERE r.domain <> 'Books'""", "records postings")
def join_enrich_ranked_key(w: Workspace) -> DataFrame:
    keyed = browse.enrich(_hits(w), w.records, ["source", "id"])
    known = w.records.filter(F.col("domain") != "Books")
    rows = joins.enrich_by_key(keyed, known, ["domain", "token_count"])
    return keyword.ranked(rows).select("rank", "source", "id", "score", "domain", "token_count")


@query("join_enrich_ranked_no", f"""
    SELECT row_number() OVER (ORDER BY score DESC, h.record_no) AS rank, h.record_no, h.score, r.id, r.source, r.token_count
    FROM ({TOP100}) h JOIN records r ON h.record_no = r.record_no""", "records postings")
def join_enrich_ranked_no(w: Workspace) -> DataFrame:
    rows = browse.enrich(_hits(w), w.records, ["id", "source", "token_count"])
    return keyword.ranked(rows).select("rank", "record_no", "score", "id", "source", "token_count")


@query("join_topic_points", """
    SELECT p.record_no, p.x, p.y, a.topic_id, r.source, r.domain FROM points p
    JOIN records r ON r.record_no = p.record_no JOIN assigned a ON a.record_no = p.record_no""", "records points assigned")
def join_topic_points(w: Workspace) -> DataFrame:
    rows = w.records.select("record_no", "source", "domain")
    return joins.topic_points(rows, w.points, w.assignments.select("record_no", "topic_id"))


@query("join_topic_assignment", """
    SELECT topic_id, count(*) AS records, CAST(sum(token_count) AS BIGINT) AS tokens
    FROM records JOIN assigned USING (record_no) WHERE domain = 'News' GROUP BY topic_id""", "records assigned")
def join_topic_assignment(w: Workspace) -> DataFrame:
    base = w.records.filter(F.col("domain") == "News").select("record_no", "token_count")
    return base.join(w.assignments, "record_no").groupBy("topic_id").agg(
        F.count("*").alias("records"), F.sum("token_count").alias("tokens"))


@query("join_semi_metadata", """
    SELECT record_no, tf FROM postings WHERE term = 'the' AND record_no IN (
      SELECT record_no FROM records WHERE content_length = 'substantial')""", "records postings")
def join_semi_metadata(w: Workspace) -> DataFrame:
    allowed = selection.eligible(w.records, {"content_length": "substantial"})
    rows = similarity.allowed_only(keyword.for_terms(w.postings, ["the"]), allowed)
    return rows.select("record_no", "tf")


@query("join_anti_coverage", """
    SELECT record_no, 'left' AS only_in FROM records WHERE record_no NOT IN (SELECT record_no FROM vectors)
    UNION ALL SELECT record_no, 'right' FROM vectors WHERE record_no NOT IN (SELECT record_no FROM records)""",
       "records vectors")
def join_anti_coverage(w: Workspace) -> DataFrame:
    return joins.uncovered(w.records, w.vectors)


@query("join_range_location", """
    SELECT record_no AS position, source, source_row AS row_index FROM records""", "records")
def join_range_location(w: Workspace) -> DataFrame:
    return numbering.locate(w.records.select(F.col("record_no").alias("position")), w.source_table)


@query("join_location_to_position", "SELECT source, source_row AS row_index, record_no AS position FROM records", "records")
def join_location_to_position(w: Workspace) -> DataFrame:
    return numbering.to_global(w.records.select("source", F.col("source_row").alias("row_index")), w.source_table)


@query("join_vector_identity", """
    SELECT r.record_no, r.id, v.usable FROM records r JOIN vectors v ON r.record_no = v.record_no""", "records vectors")
def join_vector_identity(w: Workspace) -> DataFrame:
    rows = w.vectors.select("record_no", vec.is_usable(F.col("vec")).alias("usable"))
    return w.records.select("record_no", "id").join(rows, "record_no")


@query("join_vocab", """
    SELECT record_no, count(*) AS known_terms, CAST(sum(tf) AS BIGINT) AS known_words
    FROM postings JOIN vocab ON term = word GROUP BY record_no""", "postings vocab")
def join_vocab(w: Workspace) -> DataFrame:
    known = w.postings.join(w.vocabulary.select("word"), F.col("term") == F.col("word"))
    return known.groupBy("record_no").agg(F.count("*").alias("known_terms"), F.sum("tf").alias("known_words"))


QUERY_VECTOR = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3)"


def query_vector(w: Workspace) -> list[float]:
    row = w.spark.read.parquet(f"{w.folder}/embeddings.parquet").filter("vec_id = 3").first()
    return [float(x) for x in row["embedding"]]


@query("join_query_cross", f"""
    SELECT record_no, round(list_cosine_similarity(vec, q), 6) AS score
    FROM vectors, {QUERY_VECTOR} WHERE usable""", "vectors")
def join_query_cross(w: Workspace) -> DataFrame:
    return similarity.exact_scores(w.vectors, query_vector(w))


@query("join_domain_dimension", "SELECT record_no, source, domain, source AS name FROM records", "records")
def join_domain_dimension(w: Workspace) -> DataFrame:
    return joins.domain_of(w.records.select("record_no", "source"), w.source_table).select(
        "record_no", "source", "domain", "name")


# --- numbering and runs ------------------------------------------------------------

@query("record_numbering", "SELECT doc_id, source, record_no, source_row FROM records", "records")
def record_numbering(w: Workspace) -> DataFrame:
    keys = documents(w.spark, w.folder).select("doc_id", "source")
    return numbering.dense_numbers(keys, "source", "doc_id").select("doc_id", "source", "record_no", "source_row")


@query("source_offsets", 'SELECT source, records, "offset" FROM source_table', "source_table")
def source_offsets(w: Workspace) -> DataFrame:
    counts = w.records.groupBy("source").agg(F.count("*").alias("records"))
    return numbering.source_offsets(counts)


@query("rank_ties_by_record", f"""
    SELECT record_no, score, row_number() OVER (ORDER BY score DESC, record_no) AS rank FROM (
      SELECT record_no, round(list_cosine_similarity(vec, q), 1) AS score FROM vectors, {QUERY_VECTOR} WHERE usable
      ORDER BY score DESC, record_no LIMIT 200)""", "vectors")
def rank_ties_by_record(w: Workspace) -> DataFrame:
    scored = similarity.exact_scores(w.vectors, query_vector(w)).withColumn("score", F.round("score", 1))
    return keyword.ranked(similarity.top(scored, 200))


@query("page_across_sources", """
    SELECT record_no, source, source_row FROM (
      SELECT *, row_number() OVER (ORDER BY source, source_row) - 1 AS place FROM records WHERE domain IN ('Legal', 'Web'))
    WHERE place >= 95 AND place < 195""", "records")
def page_across_sources(w: Workspace) -> DataFrame:
    chosen = w.source_table.filter(F.col("domain").isin("Legal", "Web")).select("source", "records")
    return browse.page_across_sources(w.records, chosen, 95, 100).select("record_no", "source", "source_row")


@query("range_groups", """
    SELECT source, min(source_row) AS "offset", count(*) AS length FROM (
      SELECT *, (source_row - min(source_row) OVER (PARTITION BY source, island)) // 30 AS piece FROM (
        SELECT source, source_row, source_row - row_number() OVER (PARTITION BY source ORDER BY source_row) AS island
        FROM records WHERE content_quality IS NULL))
    GROUP BY source, island, piece""", "records")
def range_groups(w: Workspace) -> DataFrame:
    wanted = w.records.filter(F.col("content_quality").isNull())
    return numbering.range_groups(wanted.select("source", F.col("source_row").alias("position")))


@query("latest_review_tag", """
    SELECT record_no, tag, CAST(epoch_us(saved_at) AS BIGINT) AS saved_us FROM last_tags WHERE tag <> ''""", "last_tags")
def latest_review_tag(w: Workspace) -> DataFrame:
    return tags.live(w.tag_writes).select("record_no", "tag", _micros("saved_at").alias("saved_us"))


@query("sample_per_source", """
    SELECT record_no, source FROM vectors WHERE usable
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42-' || record_no), record_no) <= 12""", "vectors")
def sample_per_source(w: Workspace) -> DataFrame:
    usable = w.vectors.filter(vec.is_usable(F.col("vec"))).select("record_no", "source")
    return numbering.sample_per_group(usable, "source", "record_no", 12, fixed.SEED)


# --- set operations ------------------------------------------------------------------

@query("set_pending", f"SELECT source FROM source_table WHERE {LATER}", "source_table")
def set_pending(w: Workspace) -> DataFrame:
    declared = w.records.select("source").distinct()
    return declared.exceptAll(w.source_table.filter(f"NOT ({LATER})").select("source"))


@query("set_equal_sources", """
    SELECT (SELECT count(DISTINCT source) FROM records) - (SELECT count(DISTINCT source) FROM vectors) AS missing,
      CAST(0 AS BIGINT) AS unexpected""", "records vectors")
def set_equal_sources(w: Workspace) -> DataFrame:
    a, b = w.records.select("source").distinct(), w.vectors.select("source").distinct()
    return a.exceptAll(b).agg(F.count("*").alias("missing")).withColumn(
        "unexpected", b.exceptAll(a).agg(F.count("*")).scalar())


@query("set_union_domains", "SELECT DISTINCT domain FROM records", "records")
def set_union_domains(w: Workspace) -> DataFrame:
    return w.sources.select("domain").distinct()


@query("set_vocab_intersection", """
    SELECT word FROM vocab WHERE word IN (SELECT term FROM topic_terms)""", "vocab topic_terms")
def set_vocab_intersection(w: Workspace) -> DataFrame:
    return w.vocabulary.select("word").intersect(w.topic_terms.select(F.col("term").alias("word")))


# --- streams -------------------------------------------------------------------------

@query("stream_ingest_sources", """
    SELECT corpus, source, id, length(text) AS chars, content_quality, content_safety FROM records""", "records")
def stream_ingest_sources(w: Workspace) -> DataFrame:
    inbox, target, log = (scratch(w.spark, n) for n in ("inbox", "streamed", "log"))
    texts = w.records.select("corpus", "source", "id", "text")
    for part in (texts.filter("corpus = 'en'"), texts.filter("corpus <> 'en'")):  # the second half arrives later
        part.write.mode("append").parquet(inbox)
        stream_ingest.ingest(w.spark, inbox, texts.schema, _annotation_table(w), target, log)
    return stream_ingest.read(w.spark, target).select(
        "corpus", "source", "id", F.char_length("text").cast("long").alias("chars"), "content_quality", "content_safety")


@query("stream_latest_tags", """
    SELECT record_no, tag, CAST(epoch_us(saved_at) AS BIGINT) AS saved_us FROM last_tags WHERE tag <> ''""", "last_tags")
def stream_latest_tags(w: Workspace) -> DataFrame:
    inbox, store, log = (scratch(w.spark, n) for n in ("tag-inbox", "tag-store", "tag-log"))
    removals = F.col("tag") == ""
    for part in (w.tag_writes.filter(removals), w.tag_writes.filter(~removals)):
        part.select(tags.TAG_COLUMNS).write.mode("append").parquet(inbox)
        stream_tags.upsert(w.spark, inbox, store, log)
    return stream_tags.current(w.spark, store).select("record_no", "tag", _micros("saved_at").alias("saved_us"))
