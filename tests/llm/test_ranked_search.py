"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexigrove.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item_id string, score string, rank string, lane string"
ITEMS = "item_id long, text string, doc_id string, score string, df string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, places=20):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for doc_id, c in counted:
            m = 100 - 25 + ((25 * sum(c.values()) * n_docs) // words)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, math.inf if doc_id is None else doc_id))
        out += [(item_id, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scores)[:places], 1)]
    return sorted(out, key=repr)


def rows():
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(260)]
    docs += [(300 + i, docs[7][1]) for i in range(40)]
    docs += [(400, None), (401, ""), (402, " .,-\n"), (403, "W1-w2_W3 é É"), (404, "w0 " * 30_000 + "w90 w91"), docs[3], docs[3], (None, docs[5][1])]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "unknown word"), (33, docs[3][1]), (34, "w0"), (35, "W3, w3; É"), items[2], (None, "w5 w6"), (36, docs[7][1])]
    return docs, items


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in ranked_search.ranked(d, b, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 500}, {"item_words": 90, "block_bytes": 2000}])
def test_against_brute_force(spark, options):
    docs, items = rows()
    assert found(spark, docs, items, **options) == brute(docs, items)


def test_reads_in_small_steps():
    """The same places for every first read, with many ties."""
    rng = np.random.default_rng(2)
    ids = rng.permutation(500)
    lists = []
    for _ in range(7):
        docs = rng.permutation(500)[:rng.integers(1, 400)]
        lists.append((docs, -np.sort(-rng.integers(1, 9, len(docs)))))
    exact = np.zeros(500, dtype=np.int64)
    for docs, adds in lists:
        exact[docs] += adds
    order = np.lexsort((ids, -exact))[:20]
    for step in (1, 5, 64, 1000):
        best, scores = ranked_search.nra(lists, ids, 20, 1, step)
        assert best.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()
    best, scores = ranked_search.nra(lists, ids, 20, int(exact[order[4]]), 2)
    assert set(best) >= set(order[:4]) and (scores >= exact[order[4]]).all()


def test_empty_tables(spark):
    docs, items = rows()
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None)], items) == []


def test_rows_of_the_index_are_small(spark):
    # A row is copied as a whole, in Spark and in Python: 16 MB of text in one need 330 MB in each Python worker.
    docs = spark.createDataFrame([(i, f"w{i} " * 300_000) for i in range(8)], "doc_id long, text string").coalesce(1)
    blocks = ranked_search.index(docs, ranked_search.Size(8, 8 * 300_000)).collect()
    assert len(blocks) >= 3 and sorted(i for b in blocks for i in b["doc_ids"]) == list(range(8))
    asked = {b"w0", b"w7", b"w8"}
    assert ranked_search.document_frequencies(ranked_search.index(docs, ranked_search.Size(8, 8 * 300_000)), asked) == {b"w0": 1, b"w7": 1}
