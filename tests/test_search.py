import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.functions import text as text_fn
from lexigrove.operators import encoding, keyword, similarity
from lexigrove.plans import search

DOCS = [
    (0, "s1", "a", "Books", "the ferry sails to the island", 6),
    (1, "s1", "b", "Books", "island bread, island butter", 4),
    (2, "s2", "c", "News", "the news of the ferry of the island of bread", 10),
    (3, "s2", "d", "News", "", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        DOCS, "record_no bigint, source string, id string, domain string, text string, token_count bigint")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    keyword.write_postings(docs, root + "/p")
    postings = keyword.read_postings(spark, root + "/p")
    keyword.write_term_stats(postings, root + "/t")
    return postings, keyword.read_term_stats(spark, root + "/t"), keyword.collection(docs)


def bm25(terms):
    texts = {n: [w.strip(",") for w in t.split()] for n, _, _, _, t, _ in DOCS}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    scores = {}
    for term in terms:
        df = sum(term in t for t in texts.values())
        for number, words in texts.items():
            tf = words.count(term)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                scores[number] = scores.get(number, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
    return {k: round(v, 6) for k, v in scores.items()}


def as_dict(df):
    return {r["record_no"]: r["score"] for r in df.collect()}


def test_scores_equal_the_formula(index):
    assert as_dict(keyword.bm25(*index, ["ferry", "bread"])) == pytest.approx(bm25(["ferry", "bread"]), abs=2e-6)
    assert as_dict(keyword.bm25(*index, ["absent"])) == {}


def test_postings_rows_do_not_carry_the_word_list(docs):
    """Each exploded row would otherwise copy all words of its record: quadratic in a long text."""
    plan = keyword.postings(docs)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "size(tokens" not in above and "size(tokens" in below
    counted = {(r["term"], r["record_no"]): r["tf"] for r in keyword.term_counts(docs).collect()}
    assert counted == {(r["term"], r["record_no"]): r["tf"] for r in keyword.postings(docs).collect()}


def test_texts_are_dealt_out_before_they_are_indexed(spark, tmp_path):
    """One file holds all records here; tasks must not take texts file by file."""
    rows = spark.range(400, numPartitions=1).select(F.col("id").alias("record_no"), F.lit("of the ferry of").alias("text"))
    rows.write.parquet(f"{tmp_path}/r")
    seen = []
    one = keyword.postings
    keyword.postings = lambda texts: seen.append(texts) or one(texts)
    try:
        keyword.write_postings(spark.read.parquet(f"{tmp_path}/r"), f"{tmp_path}/p")
    finally:
        keyword.postings = one
    assert "hashpartitioning(record_no" in seen[0]._jdf.queryExecution().executedPlan().toString()
    stored = keyword.read_postings(spark, f"{tmp_path}/p")
    assert stored.count() == 1200 and stored.filter("term = 'of'").select("tf", "dl", "positions").distinct().collect() == [(2, 4, [0, 3])]


def test_filter_changes_membership_but_no_score(index, docs):
    found = as_dict(search.keyword_search(*index, docs, "Island ferry", {"domain": "News"}))
    assert found == {2: pytest.approx(bm25(["island", "ferry"])[2], abs=2e-6)}


def test_every_word_and_phrase(index, docs):
    assert set(as_dict(keyword.bm25(*index, ["island", "bread"], require_all=True))) == {1, 2}
    places = {r["record_no"]: r["places"] for r in keyword.phrase(index[0], ["of", "the"]).collect()}
    assert places == {2: 2}
    assert {r["record_no"] for r in keyword.phrase(index[0], ["island", "bread", "island"]).collect()} == {1}


def test_quoted_phrases_score_filter_and_page(index, docs):
    texts = {n: [w.strip(",") for w in t.split()] for n, _, _, _, t, _ in DOCS}
    mean = sum(map(len, texts.values())) / len(texts)

    def expected(words, phrases, every=False, allowed=None):
        found = {}
        for number, said in texts.items():
            parts = [[w] for w in words] + phrases
            counts = [sum(said[i:i + len(p)] == p for i in range(len(said))) for p in parts]
            if (all if every else any)(counts) and (allowed is None or number in allowed):
                total = 0
                for p, tf in zip(parts, counts):
                    weight = sum(math.log(1 + (4 - df + 0.5) / (df + 0.5)) for df in (sum(t in x for x in texts.values()) for t in p))
                    total += weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(said) / mean))
                found[number] = pytest.approx(total, abs=2e-6)
        return found

    def got(text, filters=None, every=False):
        return as_dict(search.keyword_search(*index, docs, text, filters or {}, require_all=every))

    assert got('"the island"') == expected([], [["the", "island"]])
    assert got('bread "of the" "THE Island"') == expected(["bread"], [["of", "the"], ["the", "island"]])
    assert got('ferry "the island"', every=True) == expected(["ferry"], [["the", "island"]], True)
    assert got('"of the" bread', {"domain": "News"}) == expected(["bread"], [["of", "the"]], allowed={2})
    assert got('"the ferry of the island"') == expected([], [["the", "ferry", "of", "the", "island"]]) != {}
    assert got('"island island"') == {} and got('"ferry"') == expected(["ferry"], [])
    with pytest.raises(ValueError):
        got('bread "the island')
    hits = search.keyword_search(*index, docs, '"the island" bread', {})
    page = keyword.search_page(hits, 1, 1).first()
    assert (page["rank"], page["total"], page["has_more"], page["next_offset"]) == (2, 3, True, 2)


def test_page_state(index):
    scored = keyword.bm25(*index, ["island"])
    first = keyword.search_page(scored, 0, 2).collect()
    assert [r["total"] for r in first] == [3, 3] and first[0]["has_more"] and first[0]["next_offset"] == 2
    last = keyword.search_page(scored, 2, 2).collect()
    assert len(last) == 1 and not last[0]["has_more"] and last[0]["next_offset"] == 3


def test_query_opens_only_its_folders(index):
    plan = keyword.for_terms(index[0], ["island"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "folder#" in plan.split("PartitionFilters")[1][:60]


def scanned(df):
    """Output rows of the first Parquet scan of a computed plan."""
    from pyspark.sql import DataFrame

    assert isinstance(df, DataFrame)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            return node.metrics().apply("numOutputRows").value()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


def test_lookup_reads_only_the_spans_of_its_hits(spark, tmp_path):
    from lexigrove.operators import browse, numbering
    from lexigrove.sources.sinks import write_partitioned

    rows = spark.range(0, 50_000).select(
        F.col("id").alias("record_no"), (F.col("id") % 3).cast("string").alias("source"), F.concat(F.lit("text "), "id").alias("text"),
        numbering.span_of(F.col("id"), 100).alias("span"))
    write_partitioned(rows, str(tmp_path / "r"), ["span"], order="record_no")
    stored = spark.read.schema("record_no bigint, source string, text string, span bigint").parquet(str(tmp_path / "r"))
    wanted = [n * 497 + 3 for n in range(100)]
    hits = spark.createDataFrame([(n,) for n in wanted], "record_no bigint")
    found = browse.lookup(stored, hits, 100).select("record_no", "text")
    assert sorted(map(tuple, found.collect())) == [(n, f"text {n}") for n in wanted]
    assert scanned(found) == 100 * len({n // 100 for n in wanted})
    assert browse.lookup(stored, hits.limit(0), 100).isEmpty()
    assert browse.lookup(stored.drop("span"), hits).count() == 100


def test_lookup_of_a_long_candidate_list(spark, work):
    from lexigrove.operators import browse

    hits = spark.range(0, 3000).select(F.col("id").alias("record_no"))
    assert browse.lookup(work.records, hits).select("text").count() == work.records.count()


def test_query_length():
    for wrong in ("x", "y" * 251):
        with pytest.raises(ValueError):
            search.check_query(wrong)


@pytest.fixture(scope="module")
def vocabulary(spark):
    raw = spark.createDataFrame([
        ("Ferry", 1, [0.0, 0.0]), ("ferry", 2, [2.0, 0.0]), ("FERRY", 3, [0.0, 9.0]),
        ("bread", 500, [0.0, 3.0]), ("nil", 4, [0.0, 0.0]), ("island", 1000, [1.0, 1.0]),
    ], "word string, rank bigint, raw array<double>")
    return encoding.weighted_vocabulary(raw)


def test_vocabulary_first_usable_word_wins(vocabulary):
    found = {r["word"]: (r["rank"], r["vec"]) for r in vocabulary.collect()}
    assert set(found) == {"ferry", "bread", "island"}
    assert found["ferry"] == (2, pytest.approx([2 / 502, 0.0]))
    assert found["bread"][1] == pytest.approx([0.0, 0.5])


def test_vectors_of_single_words_are_not_shuffled(spark):
    import re

    raw = spark.createDataFrame([
        (None, 7, [1.0]), (None, 6, [3.0]), ("a", 2, [5.0]), ("A", 2, [4.0]), ("b", 1, [2.0])], "word string, rank bigint, raw array<double>")
    assert {r["word"]: r["rank"] for r in encoding.weighted_vocabulary(raw).collect()} == {None: 6, "a": 2, "b": 1}
    single = encoding.weighted_vocabulary(raw.filter("word = 'b'"))
    assert single.count() == 1
    assert not re.search("Aggregate", single._jdf.queryExecution().optimizedPlan().toString())


def encoded(df):
    return {r["record_no"]: r["vec"] for r in df.collect()}


def test_encoding_with_and_without_broadcast(docs, vocabulary):
    table = {r["word"]: np.array(r["vec"]) for r in vocabulary.collect()}
    expected = {}
    for number, _, _, _, text, _ in DOCS:
        total = sum((table[w.strip(",")] for w in text.split() if w.strip(",") in table), np.zeros(2))
        expected[number] = list(total / max(np.linalg.norm(total), 1e-12))
    for bound in (encoding.VOCABULARY_BYTES, 0):
        got = encoded(encoding.encode_documents(docs, vocabulary, bound=bound))
        assert got.keys() == expected.keys()
        for number, vector in expected.items():
            assert got[number] == pytest.approx(vector, abs=1e-12)
    assert encoding.query_vector("unknown words", vocabulary) is None
    assert encoding.query_vector("Bread", vocabulary) == pytest.approx([0.0, 1.0])


@pytest.mark.parametrize("bound", [0, 80, 160])
def test_only_rare_words_are_joined(spark, docs, vocabulary, bound, monkeypatch):
    """Beyond the bound the most frequent words are broadcast; only the others move, whatever the keys are."""
    ranked = vocabulary.withColumn("rank", F.expr("CASE word WHEN 'ferry' THEN 1 WHEN 'bread' THEN 2 ELSE 3 END"))
    near, far = encoding.split(ranked, 80, bound)
    assert {r["word"] for r in near.collect()} == {"ferry", "bread"} - ({"bread", "ferry"} if bound == 0 else {"bread"} if bound == 80 else set())
    assert near.count() + far.count() == 3
    texts = docs.unionByName(docs).select(F.lit(None).cast("long").alias("record_no"), "text")
    moved = []
    split = text_fn.term_counts
    monkeypatch.setattr(encoding.text_fn, "term_counts", lambda c: moved.append(c) or split(c))
    want, got = (sorted([round(x, 9) for x in r["vec"]] for r in encoding.encode_documents(texts, ranked, bound=b).collect())
                 for b in (encoding.VOCABULARY_BYTES, bound))
    assert got == want and len(got) == 8
    assert [str(c) for c in moved] == ["Column<'rest'>"]
    query = encoding.query_of("bread ferry bread", vocabulary)
    tokens = docs.select("record_no", text_fn.words(F.col("text")).alias("tokens"))
    check_coverage({r["record_no"]: r["coverage"] for r in encoding.concept_coverage(tokens, query, ranked, bound=bound).collect()})


def test_a_large_vocabulary_scatters_no_files(spark, work, monkeypatch):
    import functools
    from lexigrove.plans.workspace import Workspace

    monkeypatch.setattr(encoding, "encode_documents", functools.partial(encoding.encode_documents, bound=0))
    fresh = Workspace(spark, work.folder)
    fresh.__dict__ |= {"records": work.records, "vocabulary": work.vocabulary}
    # On this small table the join has several tasks only without coalescing and broadcasts.
    usual = {"spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "10485760"}
    try:
        for name, value in zip(usual, ("false", "-1")):
            spark.conf.set(name, value)
        files = fresh.encoded.inputFiles()
    finally:
        for name, value in usual.items():
            spark.conf.set(name, value)
    assert len({f.rsplit("/", 1)[0] for f in files}) == len(files)


def test_long_documents_add_parts_by_length(docs, vocabulary):
    whole = encoded(encoding.encode_long_documents(docs, vocabulary, 10_000))
    assert whole[1] == pytest.approx(encoded(encoding.encode_documents(docs, vocabulary))[1])
    parts = encoded(encoding.encode_long_documents(docs, vocabulary, 9))
    assert np.linalg.norm(parts[2]) == pytest.approx(1.0) and parts[3] == [0.0, 0.0]


def test_blocks_of_words_do_not_change_the_sum(docs, vocabulary, monkeypatch):
    import pyarrow as pa

    words = pa.array(["a", "b"])
    table = np.array([[1.0, 0.0], [0.0, 2.0]])
    tokens = pa.array([["a", "b", "b", "z"], [], ["z"], ["a"] * 5, ["b"]])
    monkeypatch.setattr(encoding, "TOKENS_PER_BLOCK", 2)
    assert encoding._fold(tokens, words, table, np.add, 0.0).tolist() == [[1, 4], [0, 0], [0, 0], [5, 0], [0, 2]]
    assert encoding._fold(tokens, words, table, np.maximum, 0.0).tolist() == [[1, 2], [0, 0], [0, 0], [1, 0], [0, 2]]


def test_coverage(docs, vocabulary):
    from lexigrove.functions import text as text_fn

    query = encoding.query_of("bread ferry bread", vocabulary)
    assert query.words == ["bread", "ferry"] and query.counts == [2, 1]
    tokens = docs.select("record_no", text_fn.words(F.col("text")).alias("tokens"))
    for bound in (encoding.VOCABULARY_BYTES, 0):
        got = {r["record_no"]: r["coverage"] for r in encoding.concept_coverage(tokens, query, vocabulary, bound=bound).collect()}
        check_coverage(got)


def check_coverage(got):
    diagonal, weights = 1 / math.sqrt(2), (0.5, 2 / 502)
    assert got[2] == pytest.approx(1.0) and got[3] == 0
    assert got[0] == pytest.approx((weights[0] * diagonal + weights[1] * 1.0) / sum(weights))


def vectors_of(spark, count=600, width=8, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, width))
    rows = []
    for n in range(count):
        v = centers[n % 6] + 0.15 * rng.normal(size=width) if n % 50 else np.zeros(width)
        rows.append((n, f"s{n % 4}", [float(x) for x in v]))
    return spark.createDataFrame(rows, "record_no bigint, source string, vec array<double>"), rows


def cosines(rows, query, allowed=None):
    found = []
    for n, _, v in rows:
        size = np.linalg.norm(v)
        if size and (allowed is None or n in allowed):
            found.append((round(float(np.dot(v, query) / size / np.linalg.norm(query)), 6), n))
    return [(n, s) for s, n in sorted(found, key=lambda x: (-x[0], x[1]))]


def test_exact_search_skips_zero_vectors_and_filters_first(spark):
    vectors, rows = vectors_of(spark)
    query = rows[1][2]
    allowed = spark.range(0, 600, 3).select(F.col("id").alias("record_no"))
    got = similarity.top(similarity.exact_scores(vectors, query, allowed), 20).collect()
    expected = cosines(rows, query, set(range(0, 600, 3)))
    assert [r["record_no"] for r in got] == [n for n, _ in expected[:20]]
    assert similarity.compared(vectors, allowed).first()[0] == len(expected)


@pytest.fixture(scope="module")
def coarse(spark, tmp_path_factory):
    vectors, rows = vectors_of(spark)
    path = str(tmp_path_factory.mktemp("cells") / "c")
    return vectors, rows, search.build_index(vectors, path, sample_size=500, cells=8)


def test_index_with_all_cells_equals_exact(spark, coarse):
    vectors, rows, index = coarse
    query = rows[5][2]
    found = search.index_candidates(index, query, None, probes=99, limit=80)
    got = similarity.rescored(found, vectors, query, 20).collect()
    assert [r["record_no"] for r in got] == [n for n, _ in cosines(rows, query)[:20]]


def test_index_filters_inside_and_recalls(spark, coarse):
    vectors, rows, index = coarse
    query, chosen = rows[7][2], set(range(1, 600, 2))
    allowed = spark.createDataFrame([(n,) for n in chosen], "record_no bigint")
    got = {r["record_no"] for r in search.index_candidates(index, query, allowed, probes=3, limit=60).collect()}
    assert got <= chosen
    best = {n for n, _ in cosines(rows, query, chosen)[:20]}
    assert len(best & got) >= 18


def test_every_vector_is_in_its_best_cell(coarse):
    vectors, rows, index = coarse
    ids, table = similarity.small_table(index.centroids)
    unit = np.asarray(table) / np.linalg.norm(table, axis=1, keepdims=True)
    stored = {r["record_no"]: r["cell"] for r in index.cells.collect()}
    usable = [(n, v) for n, _, v in rows if np.any(v)]
    assert stored.keys() == {n for n, _ in usable}
    for n, v in usable:
        assert (unit @ v)[ids.index(stored[n])] == pytest.approx((unit @ v).max())


def test_codes_lose_little(coarse):
    vectors, rows, _ = coarse
    low, high = similarity.dimension_bounds(vectors, 8)
    coded = similarity.quantize(vectors, low, high)
    query = np.asarray(rows[9][2]) / np.linalg.norm(rows[9][2])
    got = coded.select("record_no", similarity.decoder(query, low, high)(F.col("code")).alias("s")).collect()
    exact = dict(cosines(rows, query))
    assert max(abs(r["s"] - exact[r["record_no"]]) for r in got) < 0.03
    assert coded.filter(F.exists("code", lambda c: (c < 0) | (c > 255))).isEmpty()


def test_product_codes_rank_well(coarse):
    vectors, rows, _ = coarse
    books = similarity.train_product(similarity.training_sample(vectors, 500), 8, 4, 16)
    coded = similarity.product_codes(vectors, books)
    query = [float(x) for x in np.asarray(rows[9][2]) / np.linalg.norm(rows[9][2])]
    scored = similarity.top(coded.select("record_no", similarity.product_score(query, books).alias("score")), 60)
    best = {n for n, _ in cosines(rows, query)[:20]}
    assert len(best & {r["record_no"] for r in scored.collect()}) >= 17


def test_bounded_search_is_exact_and_opens_few_cells(spark, coarse):
    vectors, rows, index = coarse
    few = set(range(1, 600, 5))
    allowed = spark.createDataFrame([(n,) for n in few], "record_no bigint")
    for number, chosen, limit in ((3, None, 10), (3, few, 10), (4, None, 700), (8, few, 119)):
        found = search.bounded_candidates(index, vectors, rows[number][2], None if chosen is None else allowed, limit, first_probes=1)
        got = [(r["record_no"], r["score"]) for r in found.rows.collect()]
        assert got == cosines(rows, rows[number][2], chosen)[:limit]
    assert search.bounded_candidates(index, vectors, rows[3][2], None, 10, first_probes=1).opened < index.centroids.count()
    nothing = allowed.limit(0)
    assert search.bounded_candidates(index, vectors, rows[3][2], nothing, 10).rows.collect() == []


def test_bounded_search_with_many_equal_vectors(spark, tmp_path):
    rows = [(n, "s", [1.0, 2.0, 3.0] if n % 2 else [float(n % 7 + 1), 1.0, -2.0]) for n in range(400)]
    vectors = spark.createDataFrame(rows, "record_no bigint, source string, vec array<double>")
    index = search.build_index(vectors, str(tmp_path / "c"), cells=4)
    found = search.bounded_candidates(index, vectors, [1.0, 2.0, 3.0], None, 30, first_probes=1)
    assert [r["record_no"] for r in found.rows.collect()] == list(range(1, 61, 2))


def test_zone_map_opens_only_cells_with_allowed_rows(spark, coarse, tmp_path):
    vectors, rows, _ = coarse
    # Directions differ by domain, so a domain lies in few cells.
    domains = spark.createDataFrame([(n, f"d{n % 6}") for n, _, _ in rows], "record_no bigint, domain string")
    index = search.build_index(vectors, str(tmp_path / "c"), cells=6, records=domains)
    cells = search.cells_of(index, F.col("domain") == "d2")
    allowed = domains.filter("domain = 'd2'")
    stored = {(r["cell"], r["record_no"]) for r in index.cells.collect()}
    assert set(cells) == {c for c, n in stored if n % 6 == 2} and len(cells) < index.centroids.count()
    found = search.bounded_candidates(index, vectors, rows[2][2], allowed, 15, cells=cells)
    assert found.cells == len(cells)
    assert [r["record_no"] for r in found.rows.collect()] == [n for n, _ in cosines(rows, rows[2][2], set(range(2, 600, 6)))[:15]]


def test_strategy(spark, coarse):
    _, _, index = coarse
    assert search.check_method("exact", None) == "exact" and search.check_method("index", index) == "index"
    for method, given in (("index", None), ("fast", index)):
        with pytest.raises(ValueError):
            search.check_method(method, given)
    index.ready = False
    with pytest.raises(ValueError):
        search.check_method("index", index)
    index.ready = True


def test_self_retrieval_sees_what_the_codes_lose(spark, coarse, tmp_path):
    vectors, _, index = coarse
    row = similarity.self_retrieval(vectors, index, probes=2).first()
    assert row["queries"] == 32 and row["recall"] >= 0.9
    lost = search.VectorIndex(index.centroids, index.cells.filter("record_no % 2 = 0").withColumn(
        "code", F.transform("code", lambda c: (F.lit(255) - c).cast("smallint"))), index.low, index.high)
    assert similarity.self_retrieval(vectors, lost, keep=1).first()["recall"] < 0.5
    with pytest.raises(ValueError):
        search.build_index(vectors, str(tmp_path / "c"), cells=8, least_recall=1.1)


def test_many_queries_equal_single_ones(coarse):
    _, rows, index = coarse
    units = np.asarray([np.asarray(rows[n][2]) / np.linalg.norm(rows[n][2]) for n in (3, 7, 11)])
    chosen = [similarity.probed(u, similarity.small_table(index.centroids), 3) for u in units]
    got = similarity.many_candidates(index.cells, units, chosen, index.low, index.high, 9).collect()
    for q, (u, cells) in enumerate(zip(units, chosen)):
        one = similarity.candidates(index.cells, similarity.decoder(u, index.low, index.high)(F.col("code")), cells, None, 9).collect()
        assert {r["record_no"] for r in got if r["query"] == q} == {r["record_no"] for r in one}


def test_training_sample_is_exact_and_repeatable(spark):
    vectors, rows = vectors_of(spark, 4000)
    a = {r["record_no"] for r in similarity.training_sample(vectors, 300).collect()}
    import hashlib

    usable = [n for n, _, v in rows if any(v)]
    expected = sorted(usable, key=lambda n: (hashlib.md5(f"42-{n}".encode()).hexdigest(), n))[:300]
    assert a == set(expected)
    assert similarity.cell_count(603_000_000) == 16384 and similarity.cell_count(100) == 64
    assert similarity.cell_count(1_100_000) == 1024 and similarity.fit_cell_count(64, 39 * 16) == 16


def test_hybrid_blends_and_breaks_ties_by_number(docs, vocabulary):
    vectors = encoding.encode_documents(docs, vocabulary, keep=["source"])
    found = search.hybrid(vectors, docs, vocabulary, "ferry bread")
    rows = found.rows.collect()
    assert 3 not in {r["record_no"] for r in rows} and rows[0]["record_no"] == 2 and found.compared == 3
    keys = [(-r["score"], r["record_no"]) for r in rows]
    assert keys == sorted(keys)
    with pytest.raises(ValueError):
        search.hybrid(vectors, docs, vocabulary, "nothing known")
    page = search.semantic_page(found, docs, 1, 1).first()
    assert (page["rank"], page["total"], page["compared"], page["has_more"], page["next_offset"]) == (2, 3, 3, True, 2)
    last = search.semantic_page(found, docs, 2, 5).first()
    assert (last["rank"], last["has_more"], last["next_offset"]) == (3, False, 3)
    assert search.semantic_page(found, docs, 3, 5).collect() == []


def test_random_queries_keep_their_page_order(index):
    random.seed(1)
    words = ["ferry", "bread", "island", "the", "of", "news"]
    for _ in range(3):
        terms = random.sample(words, 2)
        got = [r["record_no"] for r in keyword.best(keyword.bm25(*index, terms), 10).collect()]
        assert got == [n for n, _ in sorted(bm25(terms).items(), key=lambda x: (-x[1], x[0]))]
