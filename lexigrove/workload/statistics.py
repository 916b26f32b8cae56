"""Selections, statistics, catalog, comparison, pages and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrove import fixed
from lexigrove.functions import labels as label_fn, text as text_fn, vectors as vec
from lexigrove.operators import audits, browse, catalog, compare, selection, stats, topics
from lexigrove.plans.workspace import Workspace, documents
from lexigrove.session import settle
from lexigrove.workload.ingest import query_vector, QUERY_VECTOR
from lexigrove.workload.registry import query
from lexigrove.workload.views import RUN, STOP, TERM

KEEP = ["record_no", "source", "domain", "token_count"]
KEPT = "record_no, source, domain, token_count"


def _selected(w: Workspace, filters: dict) -> DataFrame:
    return selection.select(w.records, filters, w.assignments if "topic_id" in filters else None).select(*KEEP)


def _filter_query(name: str, where: str, filters: dict, views: str = "records") -> None:
    query(name, f"SELECT {KEPT} FROM records WHERE {where}", views)(lambda w: _selected(w, filters))


# --- selections ----------------------------------------------------------------------

_filter_query("filter_source_domain", "source = 'src4' AND domain = 'Conversation'",
              {"source": "src4", "domain": "Conversation"})
_filter_query("filter_annotation_scalar", "content_quality = 'good' AND content_safety = 'safe'",
              {"content_quality": "good", "content_safety": "safe"})
_filter_query("filter_missing", "pii_presence IS NULL", {"pii_presence": "__missing__"})
_filter_query("filter_multilabel", "list_contains(content_type, 'prose')", {"content_type": "prose"})
_filter_query("filter_multilabel_missing", "content_type IS NULL OR len(content_type) = 0", {"content_type": "__missing__"})
_filter_query("filter_token_range", "token_count >= 100 AND token_count <= 400", {"min_tokens": 100, "max_tokens": "400"})
_filter_query("filter_key_value_pair", "content_quality = 'good' AND content_type IS NOT NULL AND list_contains(content_type, 'opinion')",
              {"content_quality": "good", "annotation_key": "content_type", "annotation_value": "opinion"})
_filter_query("filter_topic", "record_no IN (SELECT record_no FROM assigned WHERE topic_id = 3)", {"topic_id": 3},
              "records assigned")
_filter_query("filter_conjunction", "domain = 'Legal' AND content_quality IS NULL AND token_count >= 50",
              {"domain": "Legal", "content_quality": "__missing__", "min_tokens": 50, "max_tokens": "", "pii_presence": ""})


@query("filter_from_histogram", f"SELECT {KEPT} FROM records WHERE token_count BETWEEN 64 AND 511", "records")
def filter_from_histogram(w: Workspace) -> DataFrame:
    histogram = stats.shown_histogram(stats.length_histogram(w.records))
    low, high = stats.token_range(settle(histogram), 3, 5)
    return _selected(w, {"min_tokens": low, "max_tokens": high})


@query("filter_validate", """
    SELECT t.corpus, f.corpus AS asked_from, f.field, f.value,
      EXISTS (SELECT 1 FROM flat o WHERE o.corpus = t.corpus AND o.field = f.field AND o.value = f.value) AS accepted
    FROM (SELECT DISTINCT corpus, field, value FROM flat) f JOIN (SELECT DISTINCT corpus FROM records) t ON true""",
       "flat records")
def filter_validate(w: Workspace) -> DataFrame:
    labels = catalog.flatten_labels(w.sources).select("corpus", "field", "value").distinct()
    selection.validated(labels, {"content_quality": "good", "pii_presence": "__missing__"})
    for wrong in ({"unknown": "x"}, {"content_quality": "splendid"}, {"content_quality": 3}):
        try:
            selection.validated(labels, wrong)
        except ValueError:
            continue
        raise AssertionError(f"accepted {wrong}")
    corpora = sorted(r["corpus"] for r in w.sources.select("corpus").distinct().collect())
    asked = labels.select(F.explode(F.array(*[F.lit(c) for c in corpora])).alias("corpus"),
                          F.col("corpus").alias("asked_from"), "field", "value")
    return selection.check_requests(asked, labels)


@query("filter_corpus_scope", "SELECT source, domain, records FROM catalog WHERE corpus = 'de' AND domain = 'Books'", "catalog")
def filter_corpus_scope(w: Workspace) -> DataFrame:
    return selection.corpus_scope(w.sources, "de", domain="Books").select("source", "domain", "records")


@query("eligibility_set", """
    SELECT record_no FROM records WHERE domain = 'Web' AND pii_presence = 'no_pii'""", "records")
def eligibility_set(w: Workspace) -> DataFrame:
    return selection.eligible(w.records, {"domain": "Web", "pii_presence": "no_pii"})


@query("filter_by_ids", "SELECT record_no, id, substr(text, 1, 700) AS preview FROM records WHERE record_no IN (3, 77, 150)", "records")
def filter_by_ids(w: Workspace) -> DataFrame:
    return browse.previews(w.records, [3, 77, 150])


@query("project_row_columns", """
    SELECT record_no, id, source, domain, token_count, source_row, content_quality, pii_presence,
      array_to_string(content_type, ',') AS content_type FROM records""", "records")
def project_row_columns(w: Workspace) -> DataFrame:
    shown = [c for c in fixed.ROW_COLUMNS if c in w.records.columns]
    return w.records.select(*shown).withColumn("content_type", F.array_join("content_type", ","))


@query("project_full_record", """
    SELECT record_no, source_row, doc_id, id, domain, token_count, content_quality, content_safety, pii_presence,
      content_length, array_to_string(content_type, ',') AS content_type, corpus, source
    FROM records WHERE record_no = (SELECT min(record_no) FROM records WHERE content_type IS NOT NULL)""", "records")
def project_full_record(w: Workspace) -> DataFrame:
    number = w.records.filter("content_type IS NOT NULL").agg(F.min("record_no").alias("n")).first()["n"]
    return browse.full_record(w.records, number).drop("text").withColumn("content_type", F.array_join("content_type", ","))


@query("find_source", "SELECT source, domain FROM source_table WHERE contains(lower(source), 'src1')", "source_table")
def find_source(w: Workspace) -> DataFrame:
    return selection.find_source(w.source_table, "SRC1").select("source", "domain")


@query("find_topic", "SELECT topic_id, name FROM topic_names WHERE contains(lower(name || ' ' || keywords), 'ch')", "topic_names")
def find_topic(w: Workspace) -> DataFrame:
    return selection.find_topic(topics.names(w.topic_keywords), "CH").select("topic_id", "name")


@query("unpublished_category_check", """
    SELECT field, value, count(*) AS records FROM labels_long
    WHERE value <> '__missing__' AND (field, value) NOT IN (SELECT (field, value) FROM flat WHERE value NOT IN ('harmful', 'opinion'))
    GROUP BY field, value""", "labels_long flat")
def unpublished_category_check(w: Workspace) -> DataFrame:
    published = catalog.flatten_labels(w.sources).filter("value NOT IN ('harmful', 'opinion')").select("field", "value").distinct()
    return selection.unpublished_values(w.records, published)


# --- statistics -------------------------------------------------------------------------

@query("stats_totals", """
    SELECT count(*) AS records, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens,
      count(DISTINCT source) AS sources, count(content_quality) AS annotated FROM records""", "records")
def stats_totals(w: Workspace) -> DataFrame:
    return stats.totals(w.records)


@query("stats_by_domain", """
    SELECT domain AS name, count(*) AS records, CAST(sum(token_count) AS BIGINT) AS tokens FROM records GROUP BY domain""", "records")
def stats_by_domain(w: Workspace) -> DataFrame:
    return stats.by_domain(w.records).orderBy(F.desc("tokens"))


@query("stats_by_source", """
    SELECT source AS name, domain, count(*) AS records, CAST(sum(token_count) AS BIGINT) AS tokens
    FROM records GROUP BY source, domain""", "records")
def stats_by_source(w: Workspace) -> DataFrame:
    return stats.by_source(w.records).orderBy(F.desc("tokens"))


def _bins(edges: list[int]) -> str:
    rows = ", ".join(f"({i}, {a}, {b - 1})" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    case = " ".join(f"WHEN token_count < {b} THEN {i}" for i, b in enumerate(edges[1:]))
    return f"""
    SELECT b.bin, b.low AS "min", b.high AS "max", coalesce(c.n, 0) AS records
    FROM (SELECT bin, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM (VALUES {rows}) t(bin, low, high)) b LEFT JOIN (
      SELECT CASE {case} ELSE {len(edges) - 2} END AS bin, count(*) AS n FROM records GROUP BY 1) c ON b.bin = c.bin"""


@query("stats_length_histogram", _bins(fixed.LENGTH_EDGES), "records")
def stats_length_histogram(w: Workspace) -> DataFrame:
    return stats.length_histogram(w.records)


@query("stats_length_histogram_pow2", _bins(fixed.POWER_EDGES), "records")
def stats_length_histogram_pow2(w: Workspace) -> DataFrame:
    return stats.length_histogram(w.records, fixed.POWER_EDGES)


@query("stats_annotation_distribution", """
    SELECT coalesce(content_quality, '__missing__') AS name, count(*) AS records,
      (SELECT count(content_quality) FROM records) AS covered FROM records GROUP BY 1""", "records")
def stats_annotation_distribution(w: Workspace) -> DataFrame:
    return stats.annotation_distribution(w.records, "content_quality")


@query("stats_multilabel_distribution", """
    SELECT value AS name, count(*) AS records, (SELECT count(*) FROM records WHERE len(content_type) > 0) AS covered
    FROM labels_long WHERE field = 'content_type' GROUP BY value""", "labels_long records")
def stats_multilabel_distribution(w: Workspace) -> DataFrame:
    return stats.annotation_distribution(w.records, "content_type")


@query("stats_all_annotation_fields", "SELECT field, value, count(*) AS records FROM labels_long GROUP BY field, value", "labels_long")
def stats_all_annotation_fields(w: Workspace) -> DataFrame:
    return stats.all_distributions(w.records)


@query("annotation_values", """
    SELECT field, string_agg(DISTINCT value, ',' ORDER BY value) AS "values" FROM labels_long
    WHERE value <> '__missing__' GROUP BY field""", "labels_long")
def annotation_values(w: Workspace) -> DataFrame:
    return stats.annotation_values(w.records).select("field", F.array_join("values", ",").alias("values"))


@query("stats_published_fallback", """
    SELECT name, CAST(sum(records) AS BIGINT) AS records FROM (
      SELECT value AS name, records FROM flat WHERE field = 'content_quality'
      UNION ALL SELECT '__missing__', count(*) FROM records WHERE corpus <> 'fr' AND content_quality IS NULL)
    GROUP BY name HAVING sum(records) > 0""", "flat records")
def stats_published_fallback(w: Workspace) -> DataFrame:
    return stats.published_fallback(w.sources, "content_quality")


@query("catalog_from_records", """
    SELECT c.corpus, c.source, c.domain, c.records, c.tokens, c.annotated, f.labels, f.counted
    FROM catalog c LEFT JOIN (
      SELECT corpus, source, count(*) AS labels, CAST(sum(records) AS BIGINT) AS counted FROM flat GROUP BY corpus, source
    ) f ON c.corpus = f.corpus AND c.source = f.source""", "catalog flat")
def catalog_from_records(w: Workspace) -> DataFrame:
    built = catalog.catalog_sources(w.records, ["fr"])
    flat = catalog.flatten_labels(built).groupBy("corpus", "source").agg(
        F.count("*").alias("labels"), F.sum("records").alias("counted"))
    return built.select("corpus", "source", "domain", "records", "tokens", "annotated").join(
        flat, ["corpus", "source"], "left")


@query("catalog_domain_rollup", """
    SELECT corpus, domain AS name, CAST(sum(records) AS BIGINT) AS records, CAST(sum(tokens) AS BIGINT) AS tokens,
      count(*) AS sources FROM catalog GROUP BY corpus, domain""", "catalog")
def catalog_domain_rollup(w: Workspace) -> DataFrame:
    return catalog.domain_rollup(w.sources).orderBy("corpus", "name")


@query("catalog_grand_totals", """
    SELECT coalesce(corpus, 'all') AS corpus, CAST(sum(records) AS BIGINT) AS records,
      CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS sources FROM catalog GROUP BY ROLLUP (corpus)""", "catalog")
def catalog_grand_totals(w: Workspace) -> DataFrame:
    return catalog.grand_totals(w.sources)


_DOMAINS = "(SELECT corpus, domain, CAST(sum(tokens) AS BIGINT) AS amount FROM catalog GROUP BY corpus, domain)"


@query("compare_domain_share", f"""
    SELECT corpus, domain, amount, round(amount / whole, 6) AS share,
      round(amount / (SELECT greatest(1, max(a)) FROM (SELECT sum(amount) AS a FROM {_DOMAINS} WHERE domain = 'Legal' GROUP BY corpus)), 6) AS of_max
    FROM {_DOMAINS} JOIN (SELECT corpus, sum(tokens) AS whole FROM catalog GROUP BY corpus) USING (corpus)
    WHERE domain = 'Legal'""", "catalog")
def compare_domain_share(w: Workspace) -> DataFrame:
    return compare.domain_share(catalog.domain_rollup(w.sources), "tokens", "Legal")


@query("compare_domain_matrix", f"""
    SELECT domain, max(amount) FILTER (corpus = 'de') AS de, max(amount) FILTER (corpus = 'en') AS en,
      max(amount) FILTER (corpus = 'es') AS es, max(amount) FILTER (corpus = 'fr') AS fr
    FROM {_DOMAINS} GROUP BY domain""", "catalog")
def compare_domain_matrix(w: Workspace) -> DataFrame:
    return compare.domain_matrix(catalog.domain_rollup(w.sources), "tokens", ["de", "en", "es", "fr"])


@query("compare_annotation_share", """
    WITH known AS (SELECT corpus, value, sum(records) AS n FROM flat WHERE field = 'content_quality' AND domain = 'Books'
                   GROUP BY corpus, value),
      total AS (SELECT corpus, sum(records) AS total FROM catalog WHERE domain = 'Books' GROUP BY corpus),
      both_ AS (SELECT corpus, value, n FROM known UNION ALL
        SELECT corpus, 'unreported', total - coalesce((SELECT sum(n) FROM known k WHERE k.corpus = t.corpus), 0) FROM total t)
    SELECT corpus, value, CAST(n AS BIGINT) AS records, round(n / total, 6) AS share,
      corpus IN (SELECT corpus FROM known) AS published FROM both_ JOIN total USING (corpus)""", "flat catalog")
def compare_annotation_share(w: Workspace) -> DataFrame:
    return compare.annotation_share(w.sources, "content_quality", "Books")


@query("compare_categories", "SELECT DISTINCT value FROM flat WHERE field = 'content_length'", "flat")
def compare_categories(w: Workspace) -> DataFrame:
    return compare.categories(w.sources, "content_length")


@query("coverage_usable_vectors", """
    SELECT r.source, count(*) AS records, count(v.record_no) AS vectors, count(*) FILTER (v.usable) AS usable
    FROM records r LEFT JOIN vectors v ON r.record_no = v.record_no GROUP BY r.source""", "records vectors")
def coverage_usable_vectors(w: Workspace) -> DataFrame:
    return audits.usable_vectors(w.records, w.vectors)


@query("distinct_sources_in_selection", """
    SELECT DISTINCT source FROM records WHERE content_safety = 'harmful' AND domain = 'News'""", "records")
def distinct_sources_in_selection(w: Workspace) -> DataFrame:
    return selection.select(w.records, {"content_safety": "harmful", "domain": "News"}).select("source").distinct()


@query("selection_percent", """
    SELECT corpus, source, round(100.0 * coalesce(annotated, 0) / records, 1) AS share FROM catalog""", "catalog")
def selection_percent(w: Workspace) -> DataFrame:
    return w.sources.select("corpus", "source", label_fn.percent(
        F.coalesce("annotated", F.lit(0)), F.col("records")).alias("share"))


# --- pages and orders ---------------------------------------------------------------------

def _page_query(name: str, sort: str, order: str, offset: int) -> None:
    sql = f"SELECT {KEPT} FROM (SELECT * FROM records WHERE domain = 'Web' ORDER BY {order} LIMIT 30 OFFSET {offset})"
    query(name, sql, "records")(
        lambda w: browse.page(selection.select(w.records, {"domain": "Web"}).select(*KEEP), sort, offset, 30))


_page_query("browse_original", "original", "record_no", 30)
_page_query("browse_shortest", "shortest", "token_count, record_no", 30)
_page_query("browse_longest", "longest", "token_count DESC, record_no", 30)


@query("browse_deep", f"""
    SELECT {KEPT} FROM (SELECT * FROM records ORDER BY token_count DESC, record_no LIMIT 30
      OFFSET (SELECT count(*) // 2 FROM records))""", "records")
def browse_deep(w: Workspace) -> DataFrame:
    rows = w.records.select(*KEEP)
    return browse.deep_page(rows, "longest", rows.count() // 2, 30, 128)


@query("page_probe", f"""
    SELECT {KEPT} FROM (SELECT * FROM records WHERE content_quality = 'good' ORDER BY record_no LIMIT 31)""", "records")
def page_probe(w: Workspace) -> DataFrame:
    return browse.page_probe(_selected(w, {"content_quality": "good"}), "original", 0, 30)


@query("page_envelope", """
    SELECT count(*) AS total, least(30, greatest(0, count(*) - 60)) AS page_rows,
      60 + least(30, greatest(0, count(*) - 60)) < count(*) AS has_more,
      60 + least(30, greatest(0, count(*) - 60)) AS next_offset FROM records WHERE content_quality = 'good'""", "records")
def page_envelope(w: Workspace) -> DataFrame:
    return browse.envelope(_selected(w, {"content_quality": "good"}), 60, 30)


@query("jump_to_record", f"""
    SELECT {KEPT} FROM (SELECT * FROM records WHERE record_no >= 123 ORDER BY record_no LIMIT 30)""", "records")
def jump_to_record(w: Workspace) -> DataFrame:
    return browse.jump(w.records.select(*KEEP), 123, w.records.count())


@query("topn_composition", """
    SELECT name, domain, records, tokens FROM (
      SELECT source AS name, domain, records, tokens FROM source_table ORDER BY tokens DESC, source LIMIT 15)""", "source_table")
def topn_composition(w: Workspace) -> DataFrame:
    return stats.top_composition(stats.by_source(w.records), "tokens", 15)


@query("quality_order", """
    SELECT coalesce(content_quality, '__missing__') AS name, count(*) AS records,
      CAST(CASE content_quality WHEN 'poor' THEN 1 WHEN 'good' THEN 3 ELSE 99 END AS BIGINT) AS place
    FROM records GROUP BY content_quality""", "records")
def quality_order(w: Workspace) -> DataFrame:
    counted = stats.annotation_distribution(w.records, "content_quality").drop("covered")
    return stats.quality_order(counted).orderBy("place")


@query("sources_by_size", """
    SELECT source, records, row_number() OVER (ORDER BY records DESC, source) AS place FROM source_table""", "source_table")
def sources_by_size(w: Workspace) -> DataFrame:
    from pyspark.sql import Window as W

    return w.source_table.select("source", "records", F.row_number().over(
        W.orderBy(F.desc("records"), "source")).cast("long").alias("place"))


# --- scalar functions ------------------------------------------------------------------------

@query("tokenize_words", "SELECT record_no, term, tf FROM postings", "postings")
def tokenize_words(w: Workspace) -> DataFrame:
    tokens = w.records.select("record_no", text_fn.words(F.col("text")).alias("t"))
    return tokens.select("record_no", F.explode(text_fn.term_counts(F.col("t"))).alias("c")).select(
        "record_no", "c.term", "c.tf")


@query("tokenize_topic_terms", f"""
    SELECT doc_id, len(terms) AS terms, md5(array_to_string(terms, ' ')) AS digest FROM (
      SELECT doc_id, [t for t in regexp_extract_all(lower(text), {RUN})
                      if regexp_matches(t, {TERM}) AND NOT list_contains({STOP}, t)] AS terms FROM documents)""")
def tokenize_topic_terms(w: Workspace) -> DataFrame:
    terms = documents(w.spark, w.folder).select("doc_id", text_fn.topic_terms(F.col("text")).alias("t"))
    return terms.select("doc_id", F.size("t").cast("long").alias("terms"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("preview_prefix", "SELECT doc_id, substr(text, 1, 700) AS preview FROM documents")
def preview_prefix(w: Workspace) -> DataFrame:
    return documents(w.spark, w.folder).select("doc_id", text_fn.preview_prefix(F.col("text")).alias("preview"))


SNIPPET = """
    CASE WHEN start > 0 THEN '…' ELSE '' END || substr(text, start + 1, 700)"""
SNIPPET_START = """greatest(0, coalesce(least({hits}), 0) - 110)"""


def snippet_start(terms: list[str]) -> str:
    hits = ", ".join(f"nullif(instr(lower(text), '{t}'), 0) - 1" for t in terms if len(t) > 2)
    return SNIPPET_START.format(hits=hits)


@query("preview_snippet", f"""
    SELECT doc_id, {SNIPPET} AS preview FROM (SELECT *, {snippet_start(['und', 'the', 'que'])} AS start FROM documents)""")
def preview_snippet(w: Workspace) -> DataFrame:
    return documents(w.spark, w.folder).select(
        "doc_id", text_fn.preview_snippet(F.col("text"), ["und", "the", "la", "que"]).alias("preview"))


@query("display_title", rf"""
    SELECT id, coalesce(nullif(substr([l for l in string_split(
        coalesce(nullif(substr(text, 1, 700), ''), id), chr(10)) if regexp_matches(l, '[^{text_fn.SPACE}]')][1], 1, 130), ''), id) AS title
    FROM records""", "records")
def display_title(w: Workspace) -> DataFrame:
    return w.records.select("id", text_fn.display_title(
        text_fn.preview_prefix(F.col("text")), F.lit(None).cast("string"), F.col("id")).alias("title"))


@query("text_chunk", """
    SELECT doc_id, substr(text, 101, 500) AS chunk, length(text) AS text_length,
      100 + length(substr(text, 101, 500)) AS next_offset, length(text) > 600 AS has_more FROM documents""")
def text_chunk(w: Workspace) -> DataFrame:
    parts = text_fn.text_chunk(F.col("text"), 100, 500)
    return documents(w.spark, w.folder).select("doc_id", *[c.alias(n) for n, c in parts.items()])


@query("excerpt_begin_mid_end", """
    SELECT doc_id, CASE WHEN length(text) <= 6000 THEN text ELSE substr(text, 1, 2000) || chr(10)
      || substr(text, length(text) // 2 - 999, 2000) || chr(10) || right(text, 2000) END AS excerpt FROM documents""")
def excerpt_begin_mid_end(w: Workspace) -> DataFrame:
    return documents(w.spark, w.folder).select("doc_id", text_fn.excerpt(F.col("text")).alias("excerpt"))


@query("preview_squash", rf"""
    SELECT doc_id, substr(trim(regexp_replace(substr(text, 1, 1000), '[{text_fn.SPACE}]+', ' ', 'g')), 1, 260) AS preview FROM documents""")
def preview_squash(w: Workspace) -> DataFrame:
    return documents(w.spark, w.folder).select("doc_id", text_fn.preview_squash(F.col("text")).alias("preview"))


@query("split_long_text", """
    SELECT doc_id, CAST(p AS BIGINT) AS part, length(substr(text, CAST(p * 5000 + 1 AS BIGINT), 5000)) AS chars,
      md5(substr(text, CAST(p * 5000 + 1 AS BIGINT), 5000)) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 4999) // 5000))) AS p FROM documents)""")
def split_long_text(w: Workspace) -> DataFrame:
    parts = documents(w.spark, w.folder).select("doc_id", F.posexplode(text_fn.text_parts(F.col("text"), 5000)))
    return parts.select("doc_id", F.col("pos").cast("long").alias("part"),
                        F.char_length("col").cast("long").alias("chars"), F.md5("col").alias("digest"))


@query("record_key", "SELECT record_no, source || '/' || id AS key, source, id FROM records", "records")
def record_key(w: Workspace) -> DataFrame:
    keyed = w.records.select("record_no", text_fn.record_key(F.col("source"), F.col("id")).alias("key"))
    source, identifier = text_fn.split_key(F.col("key"))
    return keyed.select("record_no", "key", source.alias("source"), identifier.alias("id"))


@query("identity_hash", "SELECT record_no, sha256(id) AS id_hash FROM records", "records")
def identity_hash(w: Workspace) -> DataFrame:
    return w.records.select("record_no", text_fn.identity_hash(F.col("id")).alias("id_hash"))


@query("missing_sentinel", """
    SELECT record_no, coalesce(content_quality, '__missing__') AS stored, content_quality AS shown FROM records""", "records")
def missing_sentinel(w: Workspace) -> DataFrame:
    stored = w.records.select("record_no", label_fn.to_sentinel(F.col("content_quality")).alias("stored"))
    return stored.withColumn("shown", label_fn.from_sentinel(F.col("stored")))


@query("clean_markdown", rf"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('[' || source || '](data/x.md) ' || text,
      '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]', '\1', 'g'), '^[{text_fn.SPACE}]+|[{text_fn.SPACE}]+$', '', 'g') AS plain FROM documents""")
def clean_markdown(w: Workspace) -> DataFrame:
    linked = F.concat(F.lit("["), "source", F.lit("](data/x.md) "), "text")
    return documents(w.spark, w.folder).select("doc_id", text_fn.clean_markdown(linked).alias("plain"))


@query("pretty_label", """
    SELECT value, count(*) AS records, CASE value WHEN '__missing__' THEN 'Not annotated' WHEN 'contains_pii' THEN 'PII flagged'
      WHEN 'no_pii' THEN 'No PII flagged' ELSE upper(substr(value, 1, 1)) || substr(replace(value, '_', ' '), 2) END AS shown
    FROM labels_long GROUP BY value""", "labels_long")
def pretty_label(w: Workspace) -> DataFrame:
    counted = stats.all_distributions(w.records).groupBy("value").agg(F.sum("records").alias("records"))
    return counted.withColumn("shown", label_fn.pretty_label(F.col("value")))


@query("label_codes", """
    WITH codes AS (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY value) AS code
                   FROM (SELECT DISTINCT field, value FROM flat))
    SELECT record_no, coalesce(q.code, 0) AS content_quality_code, coalesce(l.code, 0) AS content_length_code FROM records r
    LEFT JOIN codes q ON q.field = 'content_quality' AND q.value = r.content_quality
    LEFT JOIN codes l ON l.field = 'content_length' AND l.value = r.content_length""", "flat records")
def label_codes(w: Workspace) -> DataFrame:
    dictionary = settle(catalog.label_dictionary(w.sources))
    rows = w.records.select("record_no", "content_quality", "content_length")
    return catalog.encode_labels(rows, dictionary, ["content_quality", "content_length"]).select(
        "record_no", "content_quality_code", "content_length_code")


@query("vector_ops", f"""
    SELECT record_no, round(sqrt(list_dot_product(vec, vec)), 6) AS norm, round(list_dot_product(vec, q), 6) AS dot,
      usable, CASE WHEN usable THEN round(vec[1] / sqrt(list_dot_product(vec, vec)), 6) ELSE 0.0 END AS unit_first, true AS finite
    FROM vectors, {QUERY_VECTOR}""", "vectors")
def vector_ops(w: Workspace) -> DataFrame:
    q = F.array(*[F.lit(x) for x in query_vector(w)])
    v = F.col("vec")
    return w.vectors.select(
        "record_no", F.round(vec.norm(v), 6).alias("norm"), F.round(vec.dot(v, q), 6).alias("dot"),
        vec.is_usable(v).alias("usable"), F.round(F.get(vec.normalised(v), F.lit(0)), 6).alias("unit_first"),
        vec.is_finite(v).alias("finite"))


@query("map_flatten", "SELECT corpus, source, field, value, records FROM flat", "flat")
def map_flatten(w: Workspace) -> DataFrame:
    return catalog.flatten_labels(w.sources).select("corpus", "source", "field", "value", "records")
