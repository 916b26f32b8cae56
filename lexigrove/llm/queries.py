"""The registered queries of the operators, with SQL where SQL states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrove.llm import decontamination, graph_search, jaccard_join, line_spread, mixing, notices, page_text, pairwise_quality, prefix_trie, pseudonyms, ranked_search, suffix_dedup, toxicity
from lexigrove.llm.shared import remainder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Maximal runs of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_graph_search")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return graph_search.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op4_mixing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


@query("op5_line_spread", f"""
    WITH parts AS (
        SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS place
        FROM documents),
    common AS (
        SELECT trim(line, ' ') AS line FROM parts WHERE trim(line, ' ') <> ''
        GROUP BY 1 
        HAVING count(DISTINCT source) >= (SELECT greatest({line_spread.LEAST_SITES}, ceil(count(DISTINCT source) / {line_spread.SITE_SHARE})) FROM documents)),
    marked AS (
        SELECT p.doc_id, p.line, p.place, c.line IS NOT NULL AS gone
        FROM parts p LEFT JOIN common c ON trim(p.line, ' ') = c.line)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS kept
    FROM marked GROUP BY doc_id
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return line_spread.without_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "kept")


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    scores, _ = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score",
                         F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query("op9_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
                        F.size("near_items").cast("long").alias("n_near"))


@query("op2_pseudonyms")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, folder, "documents")).select("doc_id", "text", "n_values")


@query("op3_pairwise_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = pairwise_quality.train(docs, table(spark, folder, "labels"), held_out)
    return pairwise_quality.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= pairwise_quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query("op6_notices")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return notices.scan(table(spark, folder, "documents"))


@query("op10_jaccard_join", f"""
    WITH RECURSIVE lowered AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    grams AS (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {jaccard_join.WORDS} THEN [array_to_string(w, ' ')]
            ELSE list_distinct([array_to_string(w[i:i + {jaccard_join.WORDS - 1}], ' ') FOR i IN range(1, len(w) - {jaccard_join.WORDS - 2})]) END) AS g
        FROM lowered),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * n_both >= {jaccard_join.PERCENT} * (x.n + y.n - n_both)),
    reached AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
    SELECT r.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
    FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.joined(table(spark, folder, "documents"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")



@query("op13_ranked_search", f"""
    WITH terms AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
        FROM documents),
    postings AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
    lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1),
    size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
        FROM postings, size GROUP BY term),
    asked AS (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
        FROM benchmark),
    scores AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words)))))::BIGINT AS score
        FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), size GROUP BY 1, 2),
    placed AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scores WHERE score > 0)
    SELECT * FROM placed WHERE rank <= {ranked_search.PLACES}
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op11_prefix_trie", """
    WITH turns AS (
        SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
        SELECT conv_id, conv_id - conv_id % 20 AS family,
               xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                   lambda crc, byte: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, byte)),
                   4294967295::BIGINT), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM turns)),
    steps AS (
        SELECT c.conv_id, 0 AS part, p, t, words FROM convs c JOIN turns f ON f.conv_id = c.family AND f.p <= c.h
        UNION ALL SELECT c.conv_id, 1, p, t, words FROM convs c JOIN turns o ON o.conv_id = c.conv_id AND o.p > c.h),
    seqs AS (
        SELECT c.conv_id, coalesce(list(t ORDER BY part, p) FILTER (t IS NOT NULL), []) AS s, list(words ORDER BY part, p) AS w
        FROM convs c LEFT JOIN steps USING (conv_id) GROUP BY c.conv_id),
    paths AS (
        SELECT conv_id, d, array_to_string(s[1:d], '') AS k, CASE WHEN d > 0 THEN array_to_string(s[1:d - 1], '') END AS parent, len(s) AS n,
               CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words
        FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
    nodes AS (
        SELECT k, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends
        FROM paths GROUP BY k, d),
    kids AS (SELECT parent AS k, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
    valued AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (k)),
    sums AS (
        SELECT a.k, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved
        FROM valued v JOIN paths a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY a.k)
    SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
    FROM valued v JOIN sums USING (k) LEFT JOIN nodes p ON p.k = v.parent
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, folder, "conversations"))


@query("op12_page_text")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.main_texts(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")
