"""Keyword search, vectors, topics and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexigrove import fixed
from lexigrove.functions import text as text_fn, vectors as vec
from lexigrove.operators import audits, browse, catalog, encoding, joins, keyword, selection, similarity, topics
from lexigrove.plans import build, search
from lexigrove.plans.workspace import UNPUBLISHED, Workspace
from lexigrove.session import scratch
from lexigrove.workload.ingest import QUERY_VECTOR, SEARCH, TOP100, hits_sql, query_vector
from lexigrove.workload.registry import query
from lexigrove.workload.statistics import SNIPPET, snippet_start
from lexigrove.workload.views import WORD

TEXT = "the market of"
TERMS = ["the", "market", "of"]


# --- keyword search --------------------------------------------------------------------

@query("index_postings", "SELECT term, record_no, tf, dl FROM postings", "postings")
def index_postings(w: Workspace) -> DataFrame:
    return w.postings.select("term", "record_no", "tf", "dl")


@query("index_doc_stats", """
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
      round(ln(1 + ((SELECT count(*) FROM records) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf
    FROM postings GROUP BY term""", "postings records")
def index_doc_stats(w: Workspace) -> DataFrame:
    return keyword.document_stats(w.postings, w.collection)


@query("search_bm25", hits_sql(SEARCH), "postings records")
def search_bm25(w: Workspace) -> DataFrame:
    return keyword.bm25(w.postings, w.term_stats, w.collection, SEARCH)


_FILTER = {"domain": "News", "min_tokens": 100}
_WHERE = "AND record_no IN (SELECT record_no FROM records WHERE domain = 'News' AND token_count >= 100)"


@query("search_bm25_filtered", hits_sql(SEARCH, _WHERE), "postings records")
def search_bm25_filtered(w: Workspace) -> DataFrame:
    return search.keyword_search(w.postings, w.term_stats, w.collection, w.records, " ".join(SEARCH), _FILTER)


_PHRASE_FILTER = "AND record_no IN (SELECT record_no FROM records WHERE token_count >= 50)"


def _phrase_sql(where: str = "") -> str:
    """Records with the phrase "of the" or the word dans; the phrase weighs as much as its words together."""
    return f"""SELECT record_no, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM (
        SELECT record_no, tf, dl, sum(w) AS w FROM (
          SELECT record_no, any_value(token_count) AS dl, count(*)::DOUBLE AS tf FROM (
            SELECT record_no, token_count, list_slice(t, i, i + 1) AS pair FROM (
              SELECT record_no, token_count, t, unnest(range(1, len(t))) AS i FROM (
                SELECT record_no, token_count, regexp_extract_all(lower(text), {WORD}) AS t FROM records)))
          WHERE pair = ['of', 'the'] GROUP BY record_no), idf WHERE term IN ('of', 'the') GROUP BY record_no, tf, dl
        UNION ALL SELECT record_no, tf, dl, w FROM postings JOIN idf USING (term) WHERE term = 'dans'),
      (SELECT avg(token_count) AS avg_dl FROM records)
      WHERE true {where} GROUP BY record_no"""


_PHRASE_WITH = """WITH idf AS (
      SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM postings, (SELECT count(*)::DOUBLE AS n FROM records)
      WHERE term IN ('of', 'the', 'dans') GROUP BY term, n)"""


def _phrase_hits(w: Workspace) -> DataFrame:
    return search.keyword_search(w.postings, w.term_stats, w.collection, w.records, '"of the" dans', {"min_tokens": 50})


@query("search_phrase", f"{_PHRASE_WITH} {_phrase_sql(_PHRASE_FILTER)}", "postings records")
def search_phrase(w: Workspace) -> DataFrame:
    return _phrase_hits(w)


@query("search_phrase_page", f"""{_PHRASE_WITH}
    SELECT rank, record_no, score, total, least(60, total) < total AS has_more, least(60, total) AS next_offset FROM (
      SELECT *, row_number() OVER (ORDER BY score DESC, record_no) AS rank, count(*) OVER () AS total
      FROM ({_phrase_sql(_PHRASE_FILTER)})) WHERE rank > 30 AND rank <= 60""", "postings records")
def search_phrase_page(w: Workspace) -> DataFrame:
    return keyword.search_page(_phrase_hits(w), 30)


@query("phrase_places", f"""
    SELECT record_no, count(*) AS places FROM (
      SELECT record_no, list_slice(t, i, i + 1) AS pair FROM (
        SELECT record_no, t, unnest(range(1, len(t))) AS i FROM (
          SELECT record_no, regexp_extract_all(lower(text), {WORD}) AS t FROM records)))
    WHERE pair = ['of', 'the'] GROUP BY record_no""", "records")
def phrase_places(w: Workspace) -> DataFrame:
    return keyword.phrase(w.postings, ["of", "the"])


@query("search_require_all", hits_sql(["the", "de", "in"], having="HAVING count(*) = 3"), "postings records")
def search_require_all(w: Workspace) -> DataFrame:
    return keyword.bm25(w.postings, w.term_stats, w.collection, ["the", "de", "in"], require_all=True)


@query("search_by_topic", hits_sql(SEARCH, "AND record_no IN (SELECT record_no FROM assigned WHERE topic_id = 2)"),
       "postings records assigned")
def search_by_topic(w: Workspace) -> DataFrame:
    return search.keyword_search(
        w.postings, w.term_stats, w.collection, w.records, " ".join(SEARCH), {"topic_id": 2}, w.assignments)


@query("search_page", f"""
    SELECT rank, record_no, score, total, least(60, total) < total AS has_more, least(60, total) AS next_offset FROM (
      SELECT *, row_number() OVER (ORDER BY score DESC, record_no) AS rank, count(*) OVER () AS total
      FROM ({hits_sql(SEARCH)})) WHERE rank > 30 AND rank <= 60""", "postings records")
def search_page(w: Workspace) -> DataFrame:
    return keyword.search_page(keyword.bm25(w.postings, w.term_stats, w.collection, SEARCH), 30)


@query("search_with_snippet", f"""
    SELECT record_no, source, id, score, {SNIPPET} AS preview FROM (
      SELECT r.*, h.score, {snippet_start(SEARCH)} AS start FROM ({TOP100}) h JOIN records r ON r.record_no = h.record_no)""",
       "postings records")
def search_with_snippet(w: Workspace) -> DataFrame:
    top = keyword.best(keyword.bm25(w.postings, w.term_stats, w.collection, SEARCH), 100)
    return keyword.with_snippets(top, w.records, SEARCH)


@query("original_text_lookup", """
    SELECT source, id, text FROM records UNION ALL SELECT source, 'none', NULL FROM source_table""", "records source_table")
def original_text_lookup(w: Workspace) -> DataFrame:
    keys = w.records.select("source", "id").unionByName(w.source_table.select("source", F.lit("none").alias("id")))
    return browse.original_text(keys, w.records)


@query("original_text_checked", """
    SELECT source, source_row, id, text FROM records WHERE record_no = 60""", "records")
def original_text_checked(w: Workspace) -> DataFrame:
    row = w.records.filter("record_no = 60").select("source", "source_row", "id").first()
    try:
        browse.original_checked(w.records, row["source"], row["source_row"], "other")
    except LookupError:
        return browse.original_checked(w.records, row["source"], row["source_row"], row["id"])
    raise AssertionError("A wrong identity was accepted")


# --- vectors -----------------------------------------------------------------------------

_FIVE = ", ".join(f"round({{v}}[{i}], 6) AS v{i}" for i in (1, 2, 17, 33, 64))


def _five(column) -> list:
    return [F.round(F.get(column, F.lit(i - 1)), 6).alias(f"v{i}") for i in (1, 2, 17, 33, 64)]


@query("vocab_weighting", f"SELECT word, rank, round(weight, 6) AS weight, {_FIVE.format(v='vec')} FROM vocab", "vocab")
def vocab_weighting(w: Workspace) -> DataFrame:
    v = encoding.weighted_vocabulary(w.raw_vocabulary)
    return v.select("word", "rank", F.round("weight", 6).alias("weight"), *_five(F.col("vec")))


def _encoded(counts: str, key: str) -> str:
    return f"""
      SELECT {key}, list(x ORDER BY i) AS total FROM (
        SELECT {key}, i, sum(x * tf) AS x FROM (
          SELECT {key}, tf, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM {counts} JOIN vocab ON term = word)
        GROUP BY {key}, i) GROUP BY {key}"""


def _unit(v: str) -> str:
    return f"[x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12) for x in {v}]"


ENCODED = f"""(SELECT r.record_no, CASE WHEN total IS NULL THEN list_resize([]::DOUBLE[], 64, 0.0::DOUBLE)
      ELSE {_unit('total')} END AS vec FROM records r LEFT JOIN ({_encoded('postings', 'record_no')}) t
      ON r.record_no = t.record_no)"""


@query("encode_documents", f"SELECT record_no, {_FIVE.format(v='vec')} FROM {ENCODED}", "records postings vocab")
def encode_documents(w: Workspace) -> DataFrame:
    encoded = encoding.encode_documents(w.records, w.vocabulary)
    return encoded.select("record_no", *_five(F.col("vec")))


_PART_WORDS = """(SELECT key, term, count(*) AS tf FROM (
        SELECT record_no || ':' || p AS key, unnest(regexp_extract_all(lower(substr(text, p * 4000 + 1, 4000)), $W)) AS term
        FROM (SELECT record_no, text, CAST(unnest(range(0, greatest(1, (length(text) + 3999) // 4000))) AS BIGINT) AS p FROM records))
      GROUP BY key, term) pw""".replace("$W", "'[\\p{L}\\p{Nl}\\p{No}]+(?:[''’][\\p{L}\\p{Nl}\\p{No}]+)?'")


@query("encode_long_documents", f"""
    WITH parts AS (SELECT record_no, record_no || ':' || p AS key, length(substr(text, p * 4000 + 1, 4000)) AS chars
      FROM (SELECT record_no, text, CAST(unnest(range(0, greatest(1, (length(text) + 3999) // 4000))) AS BIGINT) AS p FROM records)),
    units AS (SELECT key, {_unit('total')} AS u FROM ({_encoded(_PART_WORDS, 'key')})),
    added AS (SELECT record_no, list(x ORDER BY i) AS total FROM (
      SELECT record_no, i, sum(x * chars) AS x FROM (
        SELECT record_no, chars, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM parts JOIN units USING (key))
      GROUP BY record_no, i) GROUP BY record_no)
    SELECT r.record_no, {", ".join(f"coalesce(round(vec[{i}], 6), 0.0) AS v{i}" for i in (1, 2, 17, 33, 64))}
    FROM records r LEFT JOIN (SELECT record_no, {_unit('total')} AS vec FROM added) a ON r.record_no = a.record_no""",
       "records vocab")
def encode_long_documents(w: Workspace) -> DataFrame:
    encoded = encoding.encode_long_documents(w.records, w.vocabulary, 4000)
    return encoded.select("record_no", *_five(F.col("vec")))


_QUERY_UNIT = f"""(SELECT {_unit('total')} AS q FROM ({_encoded("(SELECT 0 AS k, unnest(['the', 'market', 'of']) AS term, 1 AS tf)", 'k')}))"""


@query("encode_query", f"""
    SELECT word, round(list_dot_product(vec, q), 6) AS dot FROM vocab, {_QUERY_UNIT}""", "vocab")
def encode_query(w: Workspace) -> DataFrame:
    q = encoding.query_vector(TEXT, w.vocabulary)
    if encoding.query_vector("qqqq zzzz", w.vocabulary) is not None:
        raise AssertionError("Unknown words must not give a vector")
    literal = F.array(*[F.lit(x) for x in q])
    return w.vocabulary.select("word", F.round(vec.dot(F.col("vec"), literal), 6).alias("dot"))


_ALLOWED = "AND record_no IN (SELECT record_no FROM records WHERE domain <> 'Books' AND token_count >= 50)"


def _exact(where: str = "", limit: int = 300) -> str:
    return f"""SELECT record_no, round(list_cosine_similarity(vec, q), 6) AS score FROM vectors, {QUERY_VECTOR}
      WHERE usable {where} ORDER BY score DESC, record_no LIMIT {limit}"""


@query("search_cosine_exact", f"SELECT record_no, score FROM ({_exact(_ALLOWED)})", "vectors records")
def search_cosine_exact(w: Workspace) -> DataFrame:
    allowed = w.records.filter("domain <> 'Books' AND token_count >= 50").select("record_no")
    return similarity.top(similarity.exact_scores(w.vectors, query_vector(w), allowed), fixed.MAX_RESULTS)


@query("topk_merge", f"SELECT record_no, score FROM ({_exact(limit=50)})", "vectors")
def topk_merge(w: Workspace) -> DataFrame:
    return similarity.top(similarity.exact_scores(w.vectors, query_vector(w)), 50)


@query("ivf_train", f"""
    WITH n AS (SELECT count(*) AS records FROM vectors WHERE usable),
      wanted AS (SELECT records, least(16384, greatest(64, max(c) FILTER (c <= greatest(records // 1000, 1)))) AS most
                 FROM n, (SELECT CAST(pow(2, unnest(range(0, 15))) AS BIGINT) AS c) GROUP BY records)
    SELECT max(c) FILTER (c <= most AND (least(records, {search.SAMPLE_SIZE}) >= 39 * c OR c = 1)) AS cells, 64::BIGINT AS dimensions, any_value(records) AS records,
      0::BIGINT AS outside
    FROM wanted, (SELECT CAST(pow(2, unnest(range(0, 15))) AS BIGINT) AS c)""", "vectors")
def ivf_train(w: Workspace) -> DataFrame:
    """Cells, dimensions, coded vectors, and those farther from their centroid than the index says."""
    far = similarity.assign(w.vectors, w.index.centroids).join(w.index.centroids.select("cell", "least"), "cell")
    facts = w.index.centroids.agg(F.count("*").alias("cells"), F.max(F.size("vec")).cast("long").alias("dimensions"))
    return facts.withColumn("records", w.index.cells.agg(F.count("*")).scalar()).withColumn(
        "outside", far.filter("similarity < least - 1e-5").agg(F.count("*")).scalar())


@query("ivf_train_sample", """
    SELECT record_no FROM vectors WHERE usable ORDER BY md5('42-' || record_no), record_no LIMIT 200""", "vectors")
def ivf_train_sample(w: Workspace) -> DataFrame:
    return similarity.training_sample(w.vectors, 200).select("record_no")


@query("ivf_assign", """
    SELECT record_no, topic_id AS cell, topic_similarity AS similarity FROM assigned
    WHERE record_no IN (SELECT record_no FROM vectors)""", "assigned vectors")
def ivf_assign(w: Workspace) -> DataFrame:
    cells = w.topic_centers.withColumnRenamed("topic_id", "cell")
    return similarity.assign(w.vectors, cells).select("record_no", "cell", "similarity")


@query("quantize_sq8", """
    WITH units AS (SELECT record_no, unnest(vec) / sqrt(list_dot_product(vec, vec)) AS x, generate_subscripts(vec, 1) AS i
                   FROM vectors WHERE usable),
      bounds AS (SELECT i, min(x) AS low, (max(x) - min(x)) / 255 AS step FROM units GROUP BY i)
    SELECT record_no, CAST(sum(code) AS BIGINT) AS code_sum, CAST(sum(code * i) AS BIGINT) AS code_checksum FROM (
      SELECT record_no, i, CAST(floor(round((x - low) / step, 9) + 0.5) AS BIGINT) AS code FROM units JOIN bounds USING (i))
    GROUP BY record_no""", "vectors")
def quantize_sq8(w: Workspace) -> DataFrame:
    size = encoding.dimensions(w.vectors)
    coded = similarity.quantize(w.vectors, *similarity.dimension_bounds(w.vectors, size))
    whole = F.transform("code", lambda c: c.cast("long"))
    weighted = F.transform("code", lambda c, i: c.cast("long") * (i + 1))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return coded.select("record_no", total(whole).alias("code_sum"), total(weighted).alias("code_checksum"))


@query("quantize_pq")
def quantize_pq(w: Workspace) -> DataFrame:
    books = similarity.train_product(similarity.training_sample(w.vectors, 2000), 64, 8, 16)
    return similarity.product_codes(w.vectors, books).select("record_no", F.array_join("code", ",").alias("code"))


def _unit_books(w: Workspace) -> list:
    """Codebooks from the topic centroids, so that SQL can state the same scores."""
    _, table = similarity.small_table(w.topic_centers, "topic_id")
    return [[row[p * 8:(p + 1) * 8] for row in table] for p in range(8)]


@query("pq_score", f"""
    WITH words AS (SELECT p, topic_id, vec[p * 8 + 1:p * 8 + 8] AS word
                   FROM topic_centers, (SELECT CAST(unnest(range(0, 8)) AS BIGINT) AS p)),
      parts AS (SELECT record_no, p, list_transform(vec[p * 8 + 1:p * 8 + 8], lambda x: x / n) AS part
                FROM (SELECT *, sqrt(list_dot_product(vec, vec)) AS n FROM vectors WHERE usable),
                     (SELECT CAST(unnest(range(0, 8)) AS BIGINT) AS p)),
      coded AS (SELECT record_no, p, word FROM parts JOIN words USING (p)
        QUALIFY row_number() OVER (PARTITION BY record_no, p ORDER BY list_distance(part, word), topic_id) = 1)
    SELECT record_no, round(sum(list_dot_product(word, q[p * 8 + 1:p * 8 + 8])), 6) AS score
    FROM coded, {QUERY_VECTOR} GROUP BY record_no""", "vectors topic_centers")
def pq_score(w: Workspace) -> DataFrame:
    books = _unit_books(w)
    coded = similarity.product_codes(w.vectors, books)
    return coded.select("record_no", F.round(similarity.product_score(query_vector(w), books), 6).alias("score"))


@query("search_ivf_filtered", f"SELECT record_no, score FROM ({_exact(_ALLOWED)})", "vectors records")
def search_ivf_filtered(w: Workspace) -> DataFrame:
    allowed = w.records.filter("domain <> 'Books' AND token_count >= 50").select("record_no")
    cells = search.cells_of(w.index, F.col("domain") != "Books")
    found = search.index_candidates(w.index, query_vector(w), allowed, cells=cells, limit=w.index.cells.count())
    return similarity.rescored(found, w.vectors, query_vector(w), fixed.MAX_RESULTS)


@query("search_rescore_exact", f"SELECT record_no, score FROM ({_exact(limit=100)})", "vectors")
def search_rescore_exact(w: Workspace) -> DataFrame:
    q = query_vector(w)
    return similarity.rescored(search.index_candidates(w.index, q, None, limit=400), w.vectors, q, 100)


_NEWS = "AND record_no IN (SELECT record_no FROM records WHERE domain = 'News')"


@query("search_adaptive_probe", f"SELECT record_no, score FROM ({_exact(_NEWS, 100)})", "vectors records")
def search_adaptive_probe(w: Workspace) -> DataFrame:
    allowed = w.records.filter("domain = 'News'").select("record_no")
    cells = search.cells_of(w.index, F.col("domain") == "News")
    return search.bounded_candidates(w.index, w.vectors, query_vector(w), allowed, 100, cells=cells, first_probes=1).rows


@query("search_strategy_switch", f"SELECT record_no, score FROM ({_exact(_ALLOWED, 1200)})", "vectors records")
def search_strategy_switch(w: Workspace) -> DataFrame:
    allowed = w.records.filter("domain <> 'Books' AND token_count >= 50").select("record_no")
    return search.semantic_candidates(w.vectors, query_vector(w), allowed, w.index, method="index")


COVERAGE = """(
      SELECT r.record_no, coalesce(c.coverage, 0.0) AS coverage FROM records r LEFT JOIN (
        SELECT record_no, sum(best * weight) / sum(weight) AS coverage FROM (
          SELECT record_no, query_word, any_value(weight) AS weight, max(least(1.0, greatest(0.0, similarity))) AS best
          FROM postings JOIN (
            SELECT v.word, q.word AS query_word, sqrt(list_dot_product(q.vec, q.vec)) AS weight,
              list_cosine_similarity(v.vec, q.vec) AS similarity
            FROM vocab v JOIN vocab q ON q.word IN ('the', 'market', 'of')) ON term = word
          GROUP BY record_no, query_word) GROUP BY record_no) c ON r.record_no = c.record_no)"""


@query("concept_coverage", f"SELECT record_no, round(coverage, 6) AS coverage FROM {COVERAGE}", "records postings vocab")
def concept_coverage(w: Workspace) -> DataFrame:
    query_ = encoding.query_of(TEXT, w.vocabulary)
    tokens = w.records.select("record_no", text_fn.words(F.col("text")).alias("tokens"))
    return encoding.concept_coverage(tokens, query_, w.vocabulary).select("record_no", F.round("coverage", 6).alias("coverage"))


def _hybrid(where: str = "", keep: int = 300) -> str:
    return f"""SELECT e.record_no, round(0.45 * e.score + 0.55 * c.coverage, 6) AS score FROM (
        SELECT record_no, round(list_cosine_similarity(vec, q), 12) AS score FROM {ENCODED}, {_QUERY_UNIT}
        WHERE list_dot_product(vec, vec) > 0 {where} ORDER BY score DESC, record_no LIMIT 1200) e
      JOIN {COVERAGE} c ON e.record_no = c.record_no ORDER BY score DESC, e.record_no LIMIT {keep}"""


@query("search_hybrid_rerank", f"SELECT record_no, score FROM ({_hybrid()})", "records postings vocab")
def search_hybrid_rerank(w: Workspace) -> DataFrame:
    return search.hybrid(w.encoded, w.records, w.vocabulary, TEXT, index=w.encoded_index, method="index").rows


@query("semantic_page", f"""
    SELECT rank, h.record_no, score, total, compared, least(60, total) < total AS has_more, least(60, total) AS next_offset, id, source, domain, token_count
    FROM (SELECT *, row_number() OVER (ORDER BY score DESC, record_no) AS rank, count(*) OVER () AS total FROM ({_hybrid()})) h
    JOIN records r ON r.record_no = h.record_no, (SELECT count(*) AS compared FROM {ENCODED} WHERE list_dot_product(vec, vec) > 0)
    WHERE rank > 30 AND rank <= 60""", "records postings vocab")
def semantic_page(w: Workspace) -> DataFrame:
    results = search.hybrid(w.encoded, w.records, w.vocabulary, TEXT, index=w.encoded_index, method="index")
    return search.semantic_page(results, w.records, 30)


_TOPIC = "AND record_no IN (SELECT record_no FROM assigned WHERE topic_id = 5)"


@query("semantic_by_topic", f"SELECT record_no, score FROM ({_hybrid(_TOPIC)})", "records postings vocab assigned")
def semantic_by_topic(w: Workspace) -> DataFrame:
    allowed = selection.eligible(w.records, {"topic_id": 5}, w.assignments)
    return search.hybrid(w.encoded, w.records, w.vocabulary, TEXT, allowed, w.encoded_index, method="index").rows


@query("validate_self_retrieval", """
    SELECT least(32, count(*)) AS queries, true AS passes FROM vectors WHERE usable""", "vectors")
def validate_self_retrieval(w: Workspace) -> DataFrame:
    facts = similarity.self_retrieval(w.vectors, w.index)
    return facts.select("queries", (F.col("recall") >= search.LEAST_RECALL).alias("passes"))


ARTEFACTS = ("records", "text_index", "vectors", "topics", "map")


def _manifest(w: Workspace) -> DataFrame:
    """A manifest written for the session's tables: which records each of them covers. There is none of a map."""
    path = scratch(w.spark, "artefacts")
    built = {"records": w.records, "text_index": w.postings, "vectors": w.vectors, "topics": w.assignments}
    rows = None
    for name, df in built.items():
        row = build.covered(df, name)
        rows = row if rows is None else rows.unionByName(row)
    build.publish_manifest(w.spark, path, rows)
    return build.manifest(w.spark, path)


_COVERS = """SELECT unnest(['records', 'text_index', 'vectors', 'topics']) AS artefact,
      unnest([(SELECT count(*) FROM records), (SELECT count(DISTINCT record_no) FROM postings),
              (SELECT count(*) FROM vectors), (SELECT count(*) FROM assigned)]) AS n"""


@query("index_staleness", f"""
    SELECT artefact, CASE WHEN n = (SELECT count(*) FROM records) THEN 'ready' ELSE 'stale' END AS state FROM ({_COVERS})
    UNION ALL SELECT 'map', 'unavailable'""", "records postings vectors assigned")
def index_staleness(w: Workspace) -> DataFrame:
    expected = build.covered(w.records, "x").select(
        F.explode(F.array(*[F.lit(a) for a in ARTEFACTS])).alias("artefact"), "revision", "records", "fingerprint")
    return audits.staleness(_manifest(w), expected)


# --- topics --------------------------------------------------------------------------------

@query("topic_vocabulary", "SELECT term, df, cf FROM topic_vocab", "topic_vocab")
def topic_vocabulary(w: Workspace) -> DataFrame:
    return topics.term_selection(w.topic_terms, w.labelled.count(), w.vocabulary)


@query("topic_fit")
def topic_fit(w: Workspace) -> DataFrame:
    return w.fitted.labelled.select("record_no", "topic_id")


@query("topic_reduce")
def topic_reduce(w: Workspace) -> DataFrame:
    reduced = topics.reduce_topics(w.labelled, encoding.dimensions(w.vectors), 4)
    return reduced.groupBy("topic_id").agg(F.count("*").alias("records"))


@query("topic_centroids", f"SELECT topic_id, {_FIVE.format(v='vec')} FROM topic_centers", "topic_centers")
def topic_centroids(w: Workspace) -> DataFrame:
    return w.topic_centers.select("topic_id", *_five(F.col("vec")))


@query("topic_assign_all", "SELECT record_no, topic_id, topic_similarity FROM assigned", "assigned")
def topic_assign_all(w: Workspace) -> DataFrame:
    return topics.assign_records(w.records, w.vectors, w.topic_centers)


@query("topic_keywords", "SELECT topic_id, rank, word, score FROM topic_words", "topic_words")
def topic_keywords(w: Workspace) -> DataFrame:
    return w.topic_keywords.select("topic_id", "rank", "word", "score")


@query("topic_names", "SELECT topic_id, name, keywords FROM topic_names", "topic_names")
def topic_names(w: Workspace) -> DataFrame:
    return topics.names(w.topic_keywords).select("topic_id", "name", F.array_join("keywords", " ").alias("keywords"))


@query("topic_manifest", """
    SELECT a.topic_id, coalesce(f.n, 0) AS fit_records, a.n AS records
    FROM (SELECT topic_id, count(*) AS n FROM assigned GROUP BY topic_id) a
    LEFT JOIN (SELECT label AS topic_id, count(*) AS n FROM sampled GROUP BY label) f ON a.topic_id = f.topic_id""",
       "assigned sampled")
def topic_manifest(w: Workspace) -> DataFrame:
    return topics.manifest(w.labelled, w.assignments)


@query("topic_map_points")
def topic_map_points(w: Workspace) -> DataFrame:
    return topics.map_points(w.labelled)


_VIEW = {"domain": "News", "topic_id": 3}


@query("topic_distribution", """
    SELECT topic_id, records, tokens, CAST(sum(records) OVER () AS BIGINT) AS base_records FROM (
      SELECT topic_id, count(*) AS records, CAST(sum(token_count) AS BIGINT) AS tokens
      FROM records JOIN assigned USING (record_no) WHERE domain = 'News' GROUP BY topic_id)""", "records assigned")
def topic_distribution(w: Workspace) -> DataFrame:
    return topics.distribution(w.records, w.assignments, _VIEW)


@query("topic_selected_count", """
    SELECT count(*) AS selected FROM records JOIN assigned USING (record_no) WHERE domain = 'News' AND topic_id = 3""",
       "records assigned")
def topic_selected_count(w: Workspace) -> DataFrame:
    return topics.selected_count(w.records, w.assignments, _VIEW)


@query("topic_view", """
    SELECT 'topic' AS kind, topic_id, count(*) AS records FROM records JOIN assigned USING (record_no)
      WHERE domain = 'News' GROUP BY topic_id
    UNION ALL SELECT 'points', 3, count(*) FROM points JOIN records USING (record_no) JOIN assigned USING (record_no)
      WHERE domain = 'News' AND topic_id = 3
    UNION ALL SELECT 'selected', 3, count(*) FROM records JOIN assigned USING (record_no) WHERE domain = 'News' AND topic_id = 3
    UNION ALL SELECT 'base', -2, count(*) FROM records WHERE domain = 'News'""", "records assigned points")
def topic_view(w: Workspace) -> DataFrame:
    groups = topics.distribution(w.records, w.assignments, _VIEW)
    points = topics.view_points(w.records, w.points, w.assignments, _VIEW)
    three = F.lit(3).cast("long").alias("topic_id")
    return (
        groups.select(F.lit("topic").alias("kind"), "topic_id", "records")
        .unionByName(points.agg(F.count("*").alias("records")).select(F.lit("points").alias("kind"), three, "records"))
        .unionByName(topics.selected_count(w.records, w.assignments, _VIEW).select(
            F.lit("selected").alias("kind"), three, F.col("selected").alias("records")))
        .unionByName(groups.agg(F.max("base_records").alias("records")).select(
            F.lit("base").alias("kind"), F.lit(-2).cast("long").alias("topic_id"), "records"))
    )


@query("topic_points_grouped", """
    SELECT coalesce(r.content_quality, '__missing__') AS name, p.record_no, p.x, p.y
    FROM points p JOIN records r ON p.record_no = r.record_no""", "points records")
def topic_points_grouped(w: Workspace) -> DataFrame:
    shown = topics.view_points(w.records, w.points, w.assignments, {})
    return topics.grouped_points(shown, "content_quality")


@query("topic_label_position", """
    SELECT topic_id, max(n) AS points, max(CASE WHEN rx = n // 2 THEN x END) AS x, max(CASE WHEN ry = n // 2 THEN y END) AS y
    FROM (SELECT topic_id, x, y, count(*) OVER (PARTITION BY topic_id) AS n,
            row_number() OVER (PARTITION BY topic_id ORDER BY x) - 1 AS rx,
            row_number() OVER (PARTITION BY topic_id ORDER BY y) - 1 AS ry
          FROM points JOIN assigned USING (record_no) WHERE topic_id >= 0)
    GROUP BY topic_id HAVING max(n) >= 20""", "points assigned")
def topic_label_position(w: Workspace) -> DataFrame:
    return topics.label_positions(w.points.join(w.assignments.select("record_no", "topic_id"), "record_no"))


@query("topic_audit", "SELECT record_no, 'coverage' AS fault FROM records WHERE record_no NOT IN (SELECT record_no FROM vectors)",
       "records vectors")
def topic_audit(w: Workspace) -> DataFrame:
    ids, _ = similarity.small_table(w.topic_centers, "topic_id")
    return audits.topic_faults(w.records, w.assignments, w.vectors, ids)


# --- audits: on data with known defects ------------------------------------------------------

def _twice(w: Workspace) -> DataFrame:
    """Records with the Legal ones stored twice."""
    rows = w.records.drop("text")
    return rows.unionByName(rows.filter("domain = 'Legal'"))


def _altered(w: Workspace) -> DataFrame:
    """Catalog with News counts one too high and one source also listed elsewhere."""
    changed = w.sources.withColumn("records", F.col("records") + F.when(F.col("domain") == "News", 1).otherwise(0))
    return changed.unionByName(
        w.sources.filter("domain = 'Other'").withColumn("domain", F.lit("Books"))
        .withColumn("annotation_distributions", F.expr(
            "CASE WHEN annotation_distributions IS NOT NULL THEN map('content_quality', map('splendid', records + 5)) END"))
        .withColumn("quality", F.col("annotation_distributions")["content_quality"]))


@query("audit_duplicate_annotation_ids", """
    SELECT corpus, source, id, 2 AS times FROM records WHERE domain = 'Legal' AND content_quality IS NOT NULL""", "records")
def audit_duplicate_annotation_ids(w: Workspace) -> DataFrame:
    notes = _twice(w).filter("content_quality IS NOT NULL")
    return audits.repeated(notes, joins.RECORD_KEY)


@query("audit_duplicate_record_keys", "SELECT source, id, 2 AS times FROM records WHERE domain = 'Legal'", "records")
def audit_duplicate_record_keys(w: Workspace) -> DataFrame:
    return audits.repeated(_twice(w), ["source", "id"])


@query("audit_join_preserves_rows", """
    SELECT source, records AS texts, 2 * records AS joined FROM source_table WHERE domain = 'Legal'""", "source_table")
def audit_join_preserves_rows(w: Workspace) -> DataFrame:
    texts = w.records.select("corpus", "source", "id")
    notes = _twice(w).select("corpus", "source", "id", "content_quality")
    return audits.rows_preserved(texts, joins.attach_annotations(texts, notes))


@query("audit_counts_vs_published", """
    SELECT corpus, source, domain, records AS actual_records, records + 1 AS published_records,
      CAST(0 AS BIGINT) AS token_difference FROM catalog WHERE domain = 'News'
    UNION ALL SELECT corpus, source, 'Books', 0, records, -tokens FROM catalog WHERE domain = 'Other'""", "catalog")
def audit_counts_vs_published(w: Workspace) -> DataFrame:
    return audits.counts_vs_published(w.records, _altered(w))


@query("audit_distribution_vs_published", """
    SELECT corpus, source, 'Books' AS domain, 'content_quality' AS field, 'splendid' AS value, CAST(0 AS BIGINT) AS actual,
      records + 5 AS published FROM catalog WHERE domain = 'Other' AND corpus <> 'fr'""", "catalog")
def audit_distribution_vs_published(w: Workspace) -> DataFrame:
    return audits.distribution_vs_published(w.records, _altered(w))


@query("audit_sources_sum_to_root", """
    SELECT corpus, CAST(sum(CASE WHEN domain = 'News' THEN 1 WHEN domain = 'Other' THEN records ELSE 0 END) AS BIGINT) AS record_difference,
      CAST(sum(CASE WHEN domain = 'Other' THEN tokens ELSE 0 END) AS BIGINT) AS token_difference
    FROM catalog GROUP BY corpus""", "catalog")
def audit_sources_sum_to_root(w: Workspace) -> DataFrame:
    return audits.sources_vs_root(_altered(w), catalog.corpus_totals(w.sources))


@query("audit_published_bounds", """
    SELECT corpus, source, 'Books' AS domain, 'content_quality' AS fault FROM catalog
    WHERE domain = 'Other' AND corpus <> 'fr'""", "catalog")
def audit_published_bounds(w: Workspace) -> DataFrame:
    return audits.published_bounds(_altered(w))


@query("audit_quality_taxonomy", """
    SELECT corpus, source, 'splendid' AS value, records + 5 AS records FROM catalog
    WHERE domain = 'Other' AND corpus <> 'fr'""", "catalog")
def audit_quality_taxonomy(w: Workspace) -> DataFrame:
    return audits.quality_taxonomy(_altered(w))


@query("audit_source_one_domain", "SELECT source, 2 AS domains FROM source_table WHERE domain = 'Other'", "source_table")
def audit_source_one_domain(w: Workspace) -> DataFrame:
    return audits.several_domains(_altered(w))


@query("audit_root_vs_source_annotated", """
    SELECT corpus, CASE corpus WHEN 'fr' THEN 'none published' WHEN 'en' THEN 'differs' WHEN 'de' THEN 'some unknown'
      ELSE 'equal' END AS note FROM catalog GROUP BY corpus""", "catalog")
def audit_root_vs_source_annotated(w: Workspace) -> DataFrame:
    partly = w.sources.withColumn("annotated", F.when(
        (F.col("corpus") != "de") | (F.col("domain") != "News"), F.col("annotated")))
    root = catalog.corpus_totals(w.sources).withColumn(
        "annotated", F.when(F.col("corpus") == "fr", F.lit(None)).otherwise(
            F.col("annotated") + F.when(F.col("corpus") == "en", 1).otherwise(0)))
    return audits.annotated_note(partly, root)


@query("audit_vector_coverage", """
    SELECT record_no, 'no vector' AS fault FROM records WHERE record_no NOT IN (SELECT record_no FROM vectors)
    UNION ALL SELECT record_no, 'repeated' FROM vectors JOIN records USING (record_no) WHERE domain = 'Legal'""", "records vectors")
def audit_vector_coverage(w: Workspace) -> DataFrame:
    legal = w.vectors.join(w.records.filter("domain = 'Legal'").select("record_no"), "record_no", "left_semi")
    return audits.vector_coverage(w.records, w.vectors.unionByName(legal))


@query("audit_index_coverage", """
    SELECT source, count(*) FILTER (token_count > 0) AS expected, count(*) FILTER (token_count > 0) AS indexed
    FROM records GROUP BY source""", "records")
def audit_index_coverage(w: Workspace) -> DataFrame:
    return audits.index_coverage(w.postings, w.records)


@query("audit_boundary_numbers", """
    SELECT source, "offset" + 1 AS first, "offset" + records AS last FROM source_table WHERE domain = 'Legal'""", "source_table")
def audit_boundary_numbers(w: Workspace) -> DataFrame:
    shifted = w.records.withColumn("record_no", F.col("record_no") + F.when(F.col("domain") == "Legal", 1).otherwise(0))
    return audits.boundary_numbers(shifted, w.source_table)


@query("audit_snapshot_consistency", f"""
    SELECT true AS same_revision, count(DISTINCT n) = 1 AS same_count, count(DISTINCT n) = 1 AS same_content, true AS all_ready
    FROM ({_COVERS})""", "records postings vectors assigned")
def audit_snapshot_consistency(w: Workspace) -> DataFrame:
    return audits.snapshot_differences(_manifest(w))


@query("audit_publication_gate", """
    SELECT DISTINCT corpus, corpus NOT IN (SELECT corpus FROM catalog WHERE domain = 'News') AS records_agree,
      true AS tokens_agree, true AS filtered_agree FROM records""", "records catalog")
def audit_publication_gate(w: Workspace) -> DataFrame:
    published = w.sources.withColumn("records", F.col("records") + F.when(F.col("domain") == "News", 1).otherwise(0))
    known = w.records.withColumn("content_quality", F.when(~F.col("corpus").isin(UNPUBLISHED), F.col("content_quality")))
    return audits.publication_gate(known, published, "content_quality", "good")


@query("audit_token_counts", """
    SELECT record_no, CASE WHEN domain = 'Legal' THEN NULL ELSE -token_count END AS token_count FROM records
    WHERE domain = 'Legal' OR (domain = 'Books' AND token_count > 0)""", "records")
def audit_token_counts(w: Workspace) -> DataFrame:
    broken = F.when(F.col("domain") == "Books", -F.col("token_count")).when(F.col("domain") != "Legal", F.col("token_count"))
    return audits.token_counts(w.records.withColumn("token_count", broken))
