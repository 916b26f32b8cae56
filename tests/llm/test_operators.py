"""Operators for training data against brute force, with odd rows in every table."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from lexigrove.llm import (decontamination, graph, graph_search, jaccard_join, line_spread, mixing, notices, pairwise_quality,
                           pseudonyms, ranked_search, suffix_dedup, toxicity)
from lexigrove.llm.shared import SMALL_GROUPS, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, node string, version string, kept string, bucket string"


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def corpus():
    """Near copies, copies, a long text, a shared passage, null and empty texts, a repeated row, null source and id."""
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = words_of(rng, rng.randrange(30, 160))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.randrange(1, 5)):
                near[rng.randrange(len(near))] = "changed"
            texts.append(near)
    passage = words_of(rng, 70)
    texts += [words_of(rng, 20) + passage + words_of(rng, 20) for _ in range(4)]
    texts += [words_of(rng, 6000), ["one"], ["two", "words"], ["Two", "WORDS"], ["é"] * 150]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, rows[0][1]), (904, rows[0][1] + "\n" + rows[1][1])]
    rows += [rows[2], (None, rows[3][1])]
    return [(i, t, "en", None if n % 9 == 8 else f"s{n % 4}", 1, "x", "x", "x", "x", "x", "x") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 ---
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, node string")


def test_nearest_against_brute_force(spark):
    points = np.random.default_rng(1).normal(size=(900, 16)).astype("float32")
    points[500:560] = points[7]
    rows = [(i, p.tolist(), "x", "x") for i, p in enumerate(points)]
    odd = [(1000, None, "x", "x"), (1100, [0.0] * 16, "x", "x"), (1200, [float("nan")] * 16, "x", "x"), (1300, [None] + [1.0] * 15, "x", "x"),
           (1400, [], "x", "x"), (1500, [1.0, 2.0], "x", "x"), (None, points[0].tolist(), "x", "x"), rows[100]]
    found = graph_search.nearest(vectors(spark, rows + odd), F.col("vec_id") % 100 == 0, 10, shard_rows=300).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 100))
    hits = 0
    for q, pairs in got.items():
        far = np.sqrt(((points.astype(float) - points[q].astype(float)) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(900), far))[:10]
        assert len(pairs) == 10 and all(abs(s - far[v]) < 1e-9 for v, s in pairs)
        assert pairs == sorted(pairs, key=lambda p: (p[1], p[0]))
        hits += len(set(best) & {v for v, _ in pairs})
    assert hits >= 0.9 * 90
    # The 61 equal vectors: the smallest ids, not the query's own.
    assert [v for v, _ in got[500]] == [7, *range(501, 510)]


def test_nearest_of_few_and_none(spark):
    few = graph_search.nearest(vectors(spark, [(0, [1.0], "", ""), (1, [3.0], "", ""), (2, [2.0], "", "")]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in few] == [(1, 2, 1.0), (2, 1, 2.0)]
    assert graph_search.nearest(vectors(spark, []), F.col("vec_id") == 0).count() == 0


# --- 2 ---
def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    card, mail = "4041894974608795", "bosbt.42@mail8.example.com"
    text = f"a {card} b {mail}, 42.144.35.254. +1 (988) 555-2485 DE89370400440532013000 1984-02-29 29.02.1984 123-45-6789 end"
    rows = [(1, text), (2, f"{card}\n{mail}"), (3, None), (4, ""), (5, "4041894974608796 256.1.1.1 1985-02-29 000-12-1234 v1.2.3"), (2, f"{card}\n{mail}")]
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_values", F.lit("x"))).collect()}
    new = out[1]["text"].split(" ")
    assert out[1]["n_values"] == 8 and luhn(new[1]) and new[1] != card and len(new[1]) == 16
    assert re.fullmatch(r"[a-z]{5}\.\d\d@mail8\.example\.com,", new[3]) and new[4].rstrip(".") != "42.144.35.254"
    assert all(int(o) < 256 for o in new[4].rstrip(".").split("."))
    iban = new[8]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    assert new[9] == "-".join(reversed(new[10].split(".")))
    assert out[2]["text"] == f"{new[1]}\n{new[3][:-1]}"
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == rows[4][1] and out[5]["n_values"] == 0


@pytest.mark.parametrize("phone", ["+1 (826) 555-4081", "+1-826-555-4081", "+18265554081", "+45 12 34 56 78", "+49 (30) 1234 5678", "+354 123 4567"])
def test_numbers_after_a_phone_are_values_of_their_own(spark, phone):
    others = ["190.137.223.204", "4041894974608795", "4041 8949 7460 8795", "2024-05-17"]
    followed = [f"{phone} {other}" for other in others] + ([f"{phone} 2024"] if not phone.startswith("+354") else [])
    rows = list(enumerate([phone, *others, *followed]))
    out = [r["text"] for r in sorted(pseudonyms.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r["doc_id"])]
    new, alone, after = out[0], out[1:5], out[5:]
    assert new != phone and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", phone) and all(a != b for a, b in zip(alone, others))
    assert after == [f"{new} {other}" for other in alone] + [f"{new} 2024"] * (len(followed) - len(others))


def test_feistel_is_a_permutation(spark):
    pairs = spark.range(189 * 7).select(F.array((F.col("id") / 7).cast("int"), (F.col("id") % 7).cast("int")).alias("s"))
    assert pairs.select(pseudonyms.feistel(F.col("s"), F.array(F.lit(189), F.lit(7)), "t")).distinct().count() == 189 * 7


# --- 3 ---
def test_quality_learns_from_pairs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words_of(rng, 60)) if i % 2 else " ".join(["same"] * 60).upper()) for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(100, None), (1, 1)], "doc_id long, quality int")
    model = pairwise_quality.train(docs, labels)
    out = {r["doc_id"]: r["score"] for r in pairwise_quality.scored(docs, model).collect()}
    assert all((out[i] >= 0.7) == bool(i % 2) for i in range(200)) and 0 <= out[900] == out[901] <= 1
    alike = pairwise_quality.train(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in pairwise_quality.scored(docs, alike).collect()} == {1.0}
    assert pairwise_quality.scored(docs.limit(0), pairwise_quality.train(docs.limit(0), labels)).count() == 0


# --- 4 ---
def test_mix_meets_targets(spark, docs, none):
    rows = mixing.taken(docs, block_words=4, shard_blocks=64).collect()
    assert len(rows) == docs.count() and mixing.taken(none).count() == 0
    sources = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        own = sources.setdefault((r["source_size"], r["target"]), [0, 0])
        own[0] += r["size"]
        own[1] += r["taken"]
    assert all(size == total and abs(taken - target) <= 8 for (size, target), (total, taken) in sources.items())
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.taken(docs, block_words=4, shard_blocks=64).collect()), key=repr)


def test_mixed_blocks_hold_the_words_taken(docs):
    taken = Counter()
    for r in mixing.mix(docs, block_words=4, shard_blocks=64).collect():
        assert len(r["text"].split()) == sum(r["piece_words"])
        for doc, n in zip(r["doc_ids"], r["piece_words"]):
            taken[doc] += n
    expected = Counter()
    for r in mixing.taken(docs, block_words=4, shard_blocks=64).collect():
        expected[r["doc_id"]] += r["taken"]
    assert +taken == +expected


def test_mix_against_streams_cut_in_plain_python(spark, docs):
    """Each slot's text is its source's stream, words 4 at a time, at the block that the slot took; with repeated rows and null ids."""
    sized = mixing.counted(docs)
    made = mixing.plan(sized, block_words=4)
    texts = {(r["doc_id"], r["version"]): re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
             for r in docs.select("doc_id", F.xxhash64("text").alias("version"), "text").collect()}
    stream = {}
    for r in sorted(mixing.streams(sized, mixing.source_table(spark, made), docs.count()).collect(), key=lambda r: r["first"]):
        own = stream.setdefault(made.names[r["source_no"]], [])
        assert len(own) == r["first"]
        own.extend(texts[r["doc_id"], r["version"]])
    rows = mixing.mix(docs, block_words=4, shard_blocks=64).collect()
    assert {name: len(own) for name, own in stream.items()} == {n: s for n, s in zip(made.names, made.sizes) if s}
    assert all(r["text"] == " ".join(stream[r["source"]][4 * r["block"]:4 * r["block"] + 4]) for r in rows)
    # Every slot of every shard is filled once, and no block is taken more often than the rounds allow.
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) == made.quotas.sum()
    assert max(Counter((r["source"], r["block"]) for r in rows).values()) <= mixing.MOST_EPOCHS


def test_shares_stop_at_three_times_the_size():
    target = mixing.shares(np.array([10, 1000, 0, 500]), np.array([5.0, 2.0, 1.0, 5.0]))
    assert target[0] == 30 and target[2] == 0 and abs(target.sum() - 1510) < 1e-9 and (target <= 3 * np.array([10, 1000, 0, 500]) + 1e-9).all()


def test_permutation_of_every_size():
    for size in (1, 2, 3, 17, 100, 1000):
        out = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 99, dtype=np.uint64))
        assert sorted(out) == list(range(size))


# --- 5 ---
def test_lines_on_many_sites_go(spark, none):
    rows = [(i, "menu\nown line %d\n  menu  \n\nrare" % i, f"s{i % 12}") for i in range(24)] + [(30, None, "s1"), (31, "", None), (32, "menu", None), (3, "menu\nown line 3\n  menu  \n\nrare", "s3")]
    rows = [(i, t if i % 12 > 4 or not t else t.replace("\nrare", ""), s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"kept": F.lit(1), "place": F.lit(2), "h1": F.lit(3)})
    out = line_spread.without_boilerplate(docs, 9).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[7]["kept"] == "own line 7\n\nrare" and by_id[7]["n_removed"] == 2 and by_id[7]["n_lines"] == 5
    assert by_id[30]["kept"] is None and by_id[30]["n_lines"] == 0 and by_id[31]["kept"] == "" and by_id[32]["kept"] == ""
    assert line_spread.without_boilerplate(none).count() == 0


# --- 6 ---
def test_notices_against_full_search(spark, none):
    texts = ["Released under the MIT License.", "released undr the mit licence", "THE MIT-LICENSE, mit license", "permit license", "apache\nlicense mit",
             None, "", "this work is licensd under the gnu general public licens, version 3", "xx " * 4000 + "licensed under the apache license version 2.0"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    out = {r["doc_id"]: r for r in notices.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("x"))).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        places = [(n, label) for p, label in notices.BASE.items() for n in range(len(words)) if words[n:n + len(p.split())] == p.split()]
        full = " ".join(words)
        fuzzy = {n.label for n in notices.notices() if not n.base and n.pattern().search(full)}
        r = out[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r["labels"] == ",".join(sorted(fuzzy | {label for _, label in places})) and r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert 0 <= r["score"] <= 1
    assert out[1]["labels"] == "mit" and out[1]["n_base"] == 0 and out[7]["labels"] == "gpl"
    assert notices.scan(none).count() == 0


def test_patterns_find_what_the_scanner_finds():
    scanner = notices.Scanner(notices.notices())
    for hit in scanner.scan("x released under the mitt license y"):
        assert regex.fullmatch(f"(?:{scanner.wanted[hit['notice']].phrase}){{e<=2}}", "released under the mitt license")


def test_base_phrases_end_on_whole_words(spark):
    texts = ["an mit licensed thing", "apache licenses", "general public licensee", "mit license", "mit licensed mit license", "mit license mit licenses"]
    rows = list(enumerate(texts))
    out = {r["doc_id"]: r for r in notices.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        words = text.split()
        places = [n for p in notices.BASE for n in range(len(words)) if words[n:n + len(p.split())] == p.split()]
        r = out[i]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == r["labels"] == ("mit" if places else "") and r["score"] == (1.0 if places else 0.0)


# --- 7 ---
def test_repeated_strings_against_brute_force(docs, none):
    length = 40
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = Counter(b[i:i + length] for _, b in rows for i in range(len(b) - length + 1))
    expected = []
    for doc, b in rows:
        gone = np.zeros(len(b) + 2, dtype=int)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = 1
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        expected.append((doc, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    for large in (50_000, 1):
        found = suffix_dedup.deduplicated(docs, length, 16, large).collect()
        assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(expected, key=repr)
    assert suffix_dedup.deduplicated(none).count() == 0


def test_blind_trie_groups_equal_strings():
    rng = random.Random(1)
    values = [rng.randrange(2 ** 12) for _ in range(3000)]
    trie = suffix_dedup.BlindTrie(12)
    for i, v in enumerate(values):
        trie.add(v, i, values)
    leaves = [[values[i] for i in leaf] for leaf in trie.leaves()]
    assert all(len(set(leaf)) == 1 for leaf in leaves) and [leaf[0] for leaf in leaves] == sorted(set(values))


# --- 8 ---
def test_deobfuscation_and_scores(spark, none):
    rng = random.Random(3)
    plain = ["the", "loser", "stays", "here", "bread", "letter", "cellar", "of", "house", "less", "see"]
    rows = [(i, " ".join(rng.choice(plain[2:]) for _ in range(30)) + (" loser" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(900, "what a l0ser here"), (901, "such a looooser"), (902, "a l o s e r here"), (903, None), (904, ""), (905, "bread 10 houses!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(1, None), (2, 0)], "doc_id long, toxic int")
    out, model = toxicity.toxicity(docs, labels)
    assert model.characters.decode("l0ser") == "loser" and model.characters.decode("looooser") == "loser"
    scores = {r["doc_id"]: r["score"] for r in out.collect()}
    assert all((scores[i] >= 0.7) == (i % 4 == 0) for i in range(400))
    assert all(scores[i] >= 0.7 for i in (900, 901, 902)) and all(scores[i] < 0.7 for i in (903, 904, 905))
    assert toxicity.toxicity(none, labels)[0].count() == 0


def test_words_of_any_length_are_decoded():
    model = toxicity.CharacterModel.of(np.ones(toxicity.SYMBOLS ** 3))
    for n in (1_000, 400_000):
        word = "h4te" + "xyz" * (n // 3)
        bare, *found = toxicity.plain(word, model)
        assert bare == word and found and found[0].startswith("h") and "4" not in found[0] and len(found[0]) == len(word)


# --- 9 ---
def test_contamination_against_brute_force(spark, docs, none):
    rng = random.Random(9)
    texts = [r["text"] for r in docs.collect()]
    cut = [" ".join(t.split()[a:a + n]) for t, a, n in ((texts[0], 3, 20), (texts[5], 0, 13), (texts[40], 25, 40), (texts[2], 5, 12))]
    items = [(i, t) for i, t in enumerate(cut)] + [(10, "one"), (11, None), (12, ""), (13, " ".join(words_of(rng, 30))), (None, cut[0]), (0, cut[0])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = [(i, tuple(w[a:a + 13])) for i, t in items for w in [words(t)] if w for a in range(max(len(w) - 13, 0) + 1)]
    expected = []
    for r in docs.collect():
        own, hit, found = words(r["text"]), set(), set()
        for item, window in windows:
            for a in range(len(own) - len(window) + 1):
                if tuple(own[a:a + len(window)]) == window:
                    hit.update(range(a, a + len(window)))
                    found.add(item)
        expected.append((r["doc_id"], len(own), len(hit), sorted(str(i) for i in found if i is not None), bool(hit) and 20 * len(hit) >= len(own)))
    for part in (decontamination.ITEM_WORDS, 15):
        before, decontamination.ITEM_WORDS = decontamination.ITEM_WORDS, part
        try:
            got = decontamination.matches(docs, benchmark).collect()
        finally:
            decontamination.ITEM_WORDS = before
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=repr) == sorted(expected, key=repr)
        assert all(set(r["items"]) <= set(r["near_items"]) for r in got)
    assert decontamination.matches(none, benchmark).count() == 0
    assert decontamination.matches(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontamination.clean(docs, benchmark).count() == sum(not e[4] for e in expected)


# --- 10 ---
def brute_components(rows):
    sets = {}
    for n, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[n] = {tuple(w[i:i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = {}
    for n in sets:
        groups.setdefault(find(n), []).append(n)
    out = []
    for group in groups.values():
        ids = [rows[n][0] for n in group if rows[n][0] is not None]
        out += [(rows[n][0], len(sets[n]), min(ids, default=None)) for n in group]
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [jaccard_join.HEAVY, 2])
def test_components_against_brute_force(docs, none, heavy):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, jaccard_join.joined(docs, heavy=heavy).collect()), key=repr) == brute_components(rows)
    assert jaccard_join.joined(none).count() == 0


def test_rounds_end_with_the_stars(spark, monkeypatch):
    """Known components are merged, not found again, and no round is made only to see that nothing changes."""
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, name, write=graph.written: rounds.append(name) or write(df, name))

    def found(links, known=None):
        out = graph.components(spark.createDataFrame(links, "a long, b long"), known)
        return {r["node"]: r["component"] for r in out.collect()}, out

    star, known = found([(-3, 7), (5, -3), (5, 7), (7, -3), (20, 10), (10, 30), (4, 4)])
    assert star == {7: -3, 5: -3, 20: 10, 30: 10} and len(rounds) == 1
    both, _ = found([(30, 5)], known)
    assert both == {7: -3, 5: -3, 10: -3, 20: -3, 30: -3} and len(rounds) <= 3
    chain, _ = found([(i, i + 1) for i in range(50)])
    assert chain == {i: 0 for i in range(1, 51)}
    assert found([])[0] == {}


def test_tables_written_by_the_join(docs, monkeypatch):
    # Each table is a job and a set of files. Components take one or two rounds a turn, as they start from those known.
    names = []
    for module in (jaccard_join, graph):
        monkeypatch.setattr(module, "written", lambda df, name, write=module.written: names.append(name) or write(df, name))
    jaccard_join.joined(docs).count()
    turns = jaccard_join.TURNS + 1
    assert names.count("found") == turns and names.count("links") <= 2 * turns


def test_narrow_tables_are_few_files(spark):
    # Each written file starts about six processes where Hadoop has no native code; tables of a few numbers a row need few files.
    confs = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        links = spark.range(2_000).select((2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b"))
        found, ends = graph.components(links), jaccard_join._ends(links)
        assert max(len(found.inputFiles()), len(ends.inputFiles())) <= 8
        assert found.filter("node = component + 1").count() == found.count() == 2_000 and ends.distinct().count() == ends.count() == 4_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def files_of(df):
    return [unquote(urlparse(f).path) for f in df.inputFiles()]


def test_indexes_are_few_files(spark, monkeypatch):
    # Each written file starts about six processes, which count as large as their JVM while they share its memory.
    made = {}
    for module in (decontamination, ranked_search):
        monkeypatch.setattr(module, "written", lambda df, name, write=module.written, **options: made.setdefault(name, write(df, name, **options)))
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(60_000))) for i in range(40)], "doc_id long, text string").repartition(40).localCheckpoint()
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    found = decontamination.matches(docs, bench)
    ranked_search.ranked(docs, bench).count()
    most = 4 * spark.sparkContext.defaultParallelism
    assert found.rdd.getNumPartitions() <= most and found.count() == 40
    for name in ("postings", "impact-lists"):
        files = files_of(made[name])
        assert 1 < len(files) <= most


def test_groups_of_large_rows_are_bounded(spark):
    rows = spark.range(40).coalesce(1).select("id", F.expr("repeat(sha2(cast(id as string), 512), 20000)").alias("text"), F.expr("transform(sequence(1, 500000), x -> cast(pmod(xxhash64(x, id), 1000000007) as int))").alias("numbers"))
    metadata = pq.ParquetFile(files_of(written(rows, "rows", **SMALL_GROUPS))[0]).metadata
    sizes = [metadata.row_group(i).total_byte_size for i in range(metadata.num_row_groups)]
    assert metadata.num_rows == 40 and max(sizes) < 16 << 20


def test_texts_left_by_decontamination_are_few_files(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(120)], "doc_id long, text string").repartition(60).localCheckpoint()
    left = decontamination.clean(docs, spark.createDataFrame([(1, "other")], "item_id long, text string"))
    assert left.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(120))


def test_the_mix_is_few_files(spark, docs):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        made = written(mixing.mix(docs), "mix")
        assert len(made.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism
        assert made.count() == made.select("shard", "slot").distinct().count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_near_copies_meet_once_in_each_order(spark):
    # Eight nodes share 20 elements; node 7 lacks every fifth of them, node 6 shares only the last one.
    places = {n: [t for t in range(20) if not (n == 7 and t % 5 == 0 or n == 6 and t < 19)] for n in range(8)}
    rows = [(o, 2 * t + o, n, 100, 118 - 2 * i, n, *[0] * 4) for n, own in places.items() for o in range(2) for i, t in enumerate(own)]
    placed = spark.createDataFrame(
        rows, "order_no int, token long, node long, n long, most long, component long, " + ", ".join(f"{b} long" for b in jaccard_join.BITMAP))
    # By their places, nodes 0 to 5 and 7 fit at the first ten elements only; node 6 meets no one there.
    pairs = {(r["a"], r["b"]) for r in jaccard_join.cross_pairs(placed, 85).collect()}
    assert pairs == set(combinations([0, 1, 2, 3, 4, 5, 7], 2))
    # 2 * 15 meetings at the first element and 2 * 6 of node 7 at the second: 10 and 8 times as many without looking back.
    assert jaccard_join.meetings(placed, 85).count() == 42


def test_few_texts_besides_the_chosen_ones_are_moved(spark):
    known = spark.range(20_000).select("id", F.xxhash64("id").alias("version"), F.lit("x").alias("text"))
    known = known.unionByName(spark.createDataFrame([(-1, 5, None), (7, None, "y")], "id long, version long, text string"))
    chosen = known.filter("id % 500 = 7 or id = -1").filter("version is not null").select("id", "version", F.col("id").alias("node"))
    left = jaccard_join.likely_chosen(known, chosen)
    assert left.join(chosen, ["id", "version"]).count() == chosen.count() == 41 and left.count() < 100
    assert jaccard_join.likely_chosen(known, chosen.limit(0)).count() == 0


def test_one_document_of_each_component(docs):
    kept = jaccard_join.one_of_each(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    expected = {c for _, n, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]) if n}
    assert kept.columns == docs.columns and set(ids) - {None, 900, 901, 902} <= expected and {900, 901, 902} <= set(ids)
    assert len(expected - set(ids)) <= 1


def test_pipeline_drops_near_copies_of_five_words(spark):
    import corpus_pipeline

    # One changed word of 50: 43 of 51 shingles of four words, 41 of 51 of five; of 40 words 31 of 41 of five.
    long, short = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(40)]
    texts = [long, [*long[:25], "x", *long[26:]], short, [*short[:20], "x", *short[21:]]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()) == [0, 1, 2, 3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()) == [0, 2, 3]


def test_held_out_rows_follow_crc32(spark):
    from lexigrove.llm.shared import remainder

    rows = spark.range(50).select("id", remainder("id", 4).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)
