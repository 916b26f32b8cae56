"""Conversation tries against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lexigrove.llm import prefix_trie
from lexigrove.llm.shared import written

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string, path string, family string, id string, words string, n string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def conversations(seed=11, n=150):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 400), n):
        turns = []
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            turns.append((rng.choice(["user", "assistant", None, ""]), rng.choice(["hello there", "", None, "ok", f"turn {rng.randrange(6)}  of\n{t}"])))
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    # Copies, a very common beginning, a long conversation, a null turn, equal turn numbers, repeated rows, no id.
    for c in range(1000, 1060):
        rows += [(c, 0, "system", "be kind"), (c, 1, "user", f"question {c % 20}"), (c, 2, "assistant", "answer")]
    rows += [(2001, t, "user", f"step {t % 7}") for t in range(3000)] + [(2002, t, "user", f"step {t % 7}") for t in range(2990)]
    rows += [(2010, None, "user", "first"), (2010, 0, "user", "second"), (2010, 0, "user", "second"), (None, 0, "user", "x"), (2011, 0, "user", "w " * 50_000)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - int(np.fmod(c, 20))
        seqs[c] = tuple(own.get(family, [])[:h] + turns[h:])
    members, ends = {}, {}
    for c, s in seqs.items():
        prefix = 0
        for d in range(len(s) + 1):
            prefix = hash((prefix, s[d - 1])) if d else 0
            entry = members.setdefault((d, prefix), {"m": [], "last": s[d - 1] if d else None, "parent": above if d else None})
            entry["m"].append(c)
            above = (d, prefix)
        ends.setdefault(above, []).append(c)
    kids = {}
    for node, e in members.items():
        kids.setdefault(e["parent"], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, reverse=True):
        e = members[node]
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        words = len(WORD.findall(e["last"][1])) if e["last"] else 0
        saved[node] = (len(e["m"]) - 1) * words + sum(saved[k] for k in below)
    return sorted((min(e["m"]), node[0], min(members[e["parent"]]["m"]) if e["parent"] else None, len(e["m"]), len(kids.get(node, [])), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, e in members.items())


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in prefix_trie.prefix_nodes(frame, **options).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("shard_turns", [prefix_trie.SHARD_TURNS, 40])
def test_against_brute_force(spark, shard_turns):
    rows = conversations()
    assert found(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_empty_tables(spark):
    assert found(spark, []) == [] and found(spark, [(None, 0, "user", "x")]) == []
    assert found(spark, [(20, 0, None, None)]) == brute([(20, 0, None, None)])


def test_sequences_as_they_are(spark):
    frame = spark.createDataFrame([(1, 1, "u", "b c"), (1, 0, "u", "a"), (2, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    got = prefix_trie.nodes(written(prefix_trie.sequences(frame), "sequences")).select("conv_id", "depth", "n_convs", "saved_tokens").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 2, 1), (1, 1, 2, 1), (1, 2, 1, 0)]


def test_double_array_finds_only_its_children():
    rng = random.Random(5)
    rows = sorted({tuple(rng.choices(range(1, 40), k=rng.randrange(0, 7))) for _ in range(800)})
    lengths = np.array([len(r) for r in rows])
    flat = np.array([t for r in rows for t in r])
    trie = prefix_trie.DoubleArray(flat, np.cumsum(lengths) - lengths, lengths)
    prefixes = {r[:d] for r in rows for d in range(len(r) + 1)}
    state = {(): 0}
    for prefix in sorted(prefixes, key=len):
        for t in range(1, 41):
            reached = int(trie.child(np.array([state[prefix]]), np.array([t]))[0])
            assert (reached >= 0) == ((*prefix, t) in prefixes)
            if reached >= 0:
                state[(*prefix, t)] = reached
    assert len(set(state.values())) == len(prefixes) <= trie.end < 3 * len(prefixes) + 40
    for active, states in trie.traverse():
        assert (states > 0).all() and len(active) == len(states)
