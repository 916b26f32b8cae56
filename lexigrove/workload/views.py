"""The derived corpus tables as DuckDB SQL, for the side-by-side check."""

from __future__ import annotations

from lexigrove import fixed
from lexigrove.functions import text
from lexigrove.plans import workspace as ws


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WORD = quoted(text.WORD)
EMAIL = quoted(text.EMAIL)
# RE2 has no look-around, so SQL takes whole word-character runs and tests them.
RUN = quoted(r"[\p{L}\p{N}_]+")
TERM = quoted(r"^[\p{L}\p{Nl}\p{No}]{3,}$")
STOP = "[" + ", ".join(quoted(w) for w in fixed.TOPIC_STOP_WORDS) + "]"
FIELDS = ["content_quality", "pii_presence", "content_type", "content_safety", "content_length"]
DOMAIN = "[" + ", ".join(quoted(d) for d in ws.DOMAINS) + "]"
UNPUBLISHED = ", ".join(quoted(c) for c in ws.UNPUBLISHED)

# name → (views it reads, body)
VIEWS: dict[str, tuple[str, str]] = {
    "records": ("", f"""
        SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS record_no,
               row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS source_row,
               lang AS corpus, source, doc_id, 'doc-' || doc_id AS id,
               ({DOMAIN})[(CAST(substr(source, 4) AS INT) % 6) + 1] AS domain,
               token_count, text,
               CASE WHEN labelled THEN CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END END AS content_quality,
               CASE WHEN labelled THEN CASE WHEN toxic = 1 THEN 'harmful' ELSE 'safe' END END AS content_safety,
               CASE WHEN labelled THEN CASE WHEN regexp_matches(text, {EMAIL}) THEN 'contains_pii' ELSE 'no_pii' END END
                 AS pii_presence,
               CASE WHEN labelled THEN CASE WHEN token_count < 50 THEN 'minimal' WHEN token_count < 500 THEN 'moderate'
                 ELSE 'substantial' END END AS content_length,
               CASE WHEN labelled THEN list_concat(
                 CASE WHEN quality = 1 THEN ['prose', 'prose'] ELSE []::VARCHAR[] END,
                 CASE WHEN toxic = 1 THEN ['opinion'] ELSE []::VARCHAR[] END) END AS content_type
        FROM (SELECT d.*, l.quality, l.toxic, l.doc_id IS NOT NULL AND d.lang NOT IN ({UNPUBLISHED}) AS labelled,
                     CAST(len(regexp_extract_all(lower(d.text), {WORD})) AS BIGINT) AS token_count
              FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""),
    "labels_long": ("records", " UNION ALL ".join(
        f"""SELECT corpus, source, domain, record_no, '{f}' AS field,
              unnest(CASE WHEN content_type IS NULL OR len(content_type) = 0 THEN ['__missing__']
                     ELSE list_distinct(content_type) END) AS value FROM records""" if f == "content_type" else
        f"SELECT corpus, source, domain, record_no, '{f}' AS field, coalesce({f}, '__missing__') AS value FROM records"
        for f in FIELDS)),
    "catalog": ("records", f"""
        SELECT corpus, source, domain, replace(replace(source, '_', ' '), '-', ' ') AS name, count(*) AS records,
               CAST(sum(token_count) AS BIGINT) AS tokens,
               CASE WHEN corpus NOT IN ({UNPUBLISHED}) THEN count(content_quality) END AS annotated
        FROM records GROUP BY corpus, source, domain"""),
    "flat": ("labels_long", f"""
        SELECT corpus, source, domain, field, value, count(*) AS records FROM labels_long
        WHERE value <> '__missing__' AND corpus NOT IN ({UNPUBLISHED})
        GROUP BY corpus, source, domain, field, value"""),
    "source_table": ("records", """
        SELECT source, domain, records, tokens,
               CAST(coalesce(sum(records) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS BIGINT) AS "offset"
        FROM (SELECT source, domain, count(*) AS records, CAST(sum(token_count) AS BIGINT) AS tokens
              FROM records GROUP BY source, domain)"""),
    "postings": ("records", f"""
        SELECT term, record_no, count(*) AS tf, any_value(dl) AS dl
        FROM (SELECT record_no, token_count AS dl, unnest(regexp_extract_all(lower(text), {WORD})) AS term FROM records)
        GROUP BY term, record_no"""),
    "vectors": ("records", f"""
        SELECT r.record_no, r.corpus, r.source, CAST(e.label AS BIGINT) AS label,
               CAST(e.embedding AS DOUBLE[]) AS vec, list_dot_product(e.embedding, e.embedding) > 0 AS usable
        FROM records r JOIN embeddings e ON r.doc_id = e.vec_id"""),
    "vocab": ("postings", f"""
        SELECT word, rank, rank / (rank + 500.0::DOUBLE) AS weight, raw,
               [x / sqrt(list_dot_product(raw, raw)) * (rank / (rank + 500.0::DOUBLE)) for x in raw] AS vec
        FROM (SELECT word, rank, CAST(embedding AS DOUBLE[]) AS raw
              FROM (SELECT term AS word, row_number() OVER (ORDER BY cf DESC, term) AS rank
                    FROM (SELECT term, sum(tf) AS cf FROM postings GROUP BY term))
              JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS turn FROM embeddings)
                ON turn = (rank - 1) % (SELECT count(*) FROM embeddings))"""),
    "tag_writes": ("records", """
        SELECT event_id % (SELECT count(*) FROM records) AS record_no,
               CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS tag, ts AS saved_at, event_id
        FROM events"""),
    "last_tags": ("tag_writes", """
        SELECT record_no, tag, saved_at FROM tag_writes
        QUALIFY row_number() OVER (PARTITION BY record_no ORDER BY saved_at DESC, event_id DESC) = 1"""),
    "sampled": ("vectors", """
        SELECT * FROM vectors WHERE usable
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42-' || record_no), record_no) <= 500"""),
    "topic_centers": ("sampled", """
        SELECT topic_id, [x / sqrt(list_dot_product(mean, mean)) for x in mean] AS vec
        FROM (SELECT topic_id, list(m ORDER BY i) AS mean
              FROM (SELECT label AS topic_id, i, avg(x) AS m
                    FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM sampled)
                    GROUP BY label, i) GROUP BY topic_id)"""),
    "assigned": ("records vectors topic_centers", """
        SELECT record_no, topic_id, topic_similarity FROM (
          SELECT v.record_no, CASE WHEN v.usable THEN c.topic_id ELSE -1 END AS topic_id,
                 CASE WHEN v.usable THEN round(list_cosine_similarity(v.vec, c.vec), 6) ELSE 0.0 END AS topic_similarity
          FROM vectors v, topic_centers c
          QUALIFY row_number() OVER (PARTITION BY v.record_no
            ORDER BY CASE WHEN v.usable THEN round(list_cosine_similarity(v.vec, c.vec), 12) END DESC, c.topic_id) = 1)
        UNION ALL
        SELECT record_no, -1, 0.0 FROM records WHERE record_no NOT IN (SELECT record_no FROM vectors)"""),
    "points": ("sampled", "SELECT record_no, round(vec[1], 4) AS x, round(vec[2], 4) AS y FROM sampled"),
    "topic_terms": ("sampled records", f"""
        SELECT record_no, term, count(*) AS tf FROM (
          SELECT record_no, unnest([t for t in regexp_extract_all(lower(excerpt), {RUN})
                                    if regexp_matches(t, {TERM}) AND NOT list_contains({STOP}, t)]) AS term
          FROM (SELECT r.record_no, CASE WHEN length(text) <= 6000 THEN text ELSE
                  substr(text, 1, 2000) || chr(10) || substr(text, length(text) // 2 - 999, 2000) || chr(10)
                  || right(text, 2000) END AS excerpt
                FROM records r JOIN sampled s ON r.record_no = s.record_no))
        GROUP BY record_no, term"""),
    "topic_vocab": ("topic_terms sampled vocab", """
        SELECT term, df, cf FROM (
          SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM topic_terms GROUP BY term
          HAVING count(*) >= 5 AND count(*) <= 0.5 * (SELECT count(*) FROM sampled)) WHERE term IN (SELECT word FROM vocab)"""),
    "topic_words": ("topic_terms topic_vocab sampled", """
        SELECT topic_id, term AS word, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term) AS rank
        FROM (SELECT topic_id, term, round(tf / size * ln(1 + (SELECT avg(size) FROM sizes) / all_tf), 5) AS score
              FROM class_terms JOIN sizes USING (topic_id)
                JOIN (SELECT term, sum(tf) AS all_tf FROM class_terms GROUP BY term) USING (term))
        QUALIFY rank <= 10"""),
    "class_terms": ("topic_terms topic_vocab sampled", """
        SELECT label AS topic_id, term, CAST(sum(tf) AS DOUBLE) AS tf
        FROM topic_terms JOIN sampled USING (record_no) WHERE term IN (SELECT term FROM topic_vocab)
        GROUP BY label, term"""),
    "sizes": ("class_terms", "SELECT topic_id, sum(tf) AS size FROM class_terms GROUP BY topic_id"),
    "topic_names": ("topic_words", """
        SELECT topic_id, string_agg(word, ' · ' ORDER BY rank) FILTER (rank <= 3) AS name,
               string_agg(word, ' ' ORDER BY rank) AS keywords FROM topic_words GROUP BY topic_id"""),
}
VIEWS["topic_words"] = ("class_terms sizes", VIEWS["topic_words"][1])


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        needed, _ = VIEWS[name]
        for other in needed.split():
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return body.strip()
    listed = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    own = body.removeprefix("WITH ") if body.startswith("WITH ") else None
    return f"WITH {listed},\n{own}" if own else f"WITH {listed}\n{body}"
