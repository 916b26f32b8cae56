"""Removal of byte strings that occur more than once, by distributed suffix sorting.

A byte goes when it lies in a string of ``length`` bytes that starts anywhere
else too. All suffixes of the corpus are ordered bucket by bucket, as far as
the order tells which of them share their first ``length`` bytes:

* The bucket of a suffix is the rarest-looking k-gram (smallest hash) of its
  first ``length`` bytes. Suffixes that agree on ``length`` bytes have the same
  one at the same distance, so no bucket needs to see another. Neighbouring
  suffixes share it: a run of them is one row.
* Runs alone in their bucket are unique. Runs whose whole bytes occur twice
  are repeated, whatever else is in the bucket. Only the other runs' suffixes
  are sorted.
* Sorting is deep-shallow: multikey quicksort on words of 8 bytes down to
  ``SHALLOW`` bytes, then a blind trie for each group that still agrees.

Buckets beyond ``LARGE`` runs are dealt out by whole-string digests, which
need no sorting. Texts are shuffled once; the work per task is bounded.

Edge cases: null texts count as empty; texts shorter than ``length`` lose
nothing; overlapping strings count; repeated rows are documents of their own
and so lose everything if long enough; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexigrove.llm.shared import mixed, pieces, written

# --- fixed value: length of a repeated string ---
LENGTH = 200

GRAM = 64
SHALLOW = 48
LARGE = 50_000
SORT_BYTES = 2 << 20
_FACTOR = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all k-grams (k a power of two), by doubling."""
    table = mixed(np.arange(256, dtype=np.uint64), 7)
    hashes, width, factor = table[data], 1, _FACTOR
    while width < gram and len(hashes) > width:
        with np.errstate(over="ignore"):
            hashes = hashes[:-width] * np.uint64(factor) + hashes[width:]
        factor, width = factor * factor & 0xFFFFFFFFFFFFFFFF, width * 2
    return mixed(hashes)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[:len(values) - width + 1], out[width - have:]) if have < width else out


def runs(texts: list, length: int = LENGTH, gram: int = GRAM):
    """Runs of suffixes with one bucket: (document, bucket, first start, number of starts), documents one by one."""
    sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    buffer = b"".join(t for t in texts if t)
    if len(buffer) < length:
        return buffer, *(np.zeros(0, np.int64) for _ in range(4))
    hashes = gram_hashes(np.frombuffer(buffer, dtype=np.uint8), gram)
    bits = np.uint64(int(len(hashes)).bit_length())
    places = np.arange(len(hashes), dtype=np.uint64)
    least = window_minima((hashes >> bits << bits) | places, length - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    counts = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[owner]
    anchors = anchor[start]
    first = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    number = np.diff(np.append(first, len(owner)))
    return buffer, owner[first], hashes[anchors[first]].view(np.int64), start[first], number


def run_table(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_bytes: int = SORT_BYTES) -> DataFrame:
    """All runs: bucket, digest of the run's bytes, document, first start and number of starts."""
    kind = pa.schema([("bucket", pa.int64()), ("digest", pa.int64()), ("id", pa.int64()), ("version", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for part, whole in pieces(batches, "text", most_bytes):
            # A text beyond the bound is worked on in stretches of starts.
            cuts = [(whole, 0)] if len(whole) > 1 else [
                ([whole[0][a:a + most_bytes + length - 1]], a) for a in range(0, max(len(whole[0] or b"") - length + 1, 0), most_bytes)]
            for texts, base in cuts:
                buffer, owner, bucket, start, number = runs(texts, length, gram)
                view = memoryview(buffer)
                digests = np.fromiter((digest(view[a:b]) for a, b in zip(start.tolist(), (start + number + length - 1).tolist())), np.uint64, len(start))
                sizes = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
                inside = start - (np.cumsum(sizes) - sizes)[owner] + base
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket), pa.array(digests.view(np.int64)), part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner)),
                    pa.array((inside << 16) | number)], schema=kind)

    return docs.select("id", "version", "text").mapInArrow(run, "bucket long, digest long, id long, version long, place long")


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key that their rows share only with equal rows."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-1)).cast("long").alias("id"), F.xxhash64("text").alias("version"), "text")


class BlindTrie:
    """A trie of bit positions where strings differ; strings that never do share a leaf.

    Strings are numbers of ``bits`` bits. A node is [bit, child for 0, child
    for 1], a leaf the list of its strings' numbers.
    """

    def __init__(self, bits: int):
        self.bits, self.root = bits, None

    def add(self, value: int, number: int, values: list[int]) -> None:
        if self.root is None:
            self.root = [number]
            return
        node = self.root
        while len(node) == 4:
            node = node[1 + (value >> node[0] & 1)]
        differ = (value ^ values[node[0]]).bit_length() - 1
        if differ < 0:
            node.append(number)
            # A leaf never has four entries, so that it is no inner node.
            if len(node) == 4:
                node.append(number)
            return
        above, node = None, self.root
        while len(node) == 4 and node[0] > differ:
            above, node = node, node[1 + (value >> node[0] & 1)]
        bit = value >> differ & 1
        inner = [differ, node if bit else [number], [number] if bit else node, None]
        if above is None:
            self.root = inner
        else:
            above[1 + (value >> above[0] & 1)] = inner

    def leaves(self) -> Iterator[list[int]]:
        """Groups of equal strings in order of the strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if len(node) == 4:
                stack += [node[2], node[1]]
            else:
                yield node


def deep_shallow(buffer: bytes, starts: np.ndarray, groups: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Flags of the suffixes that share their first ``length`` bytes with another of their group."""
    shallow = min(shallow, length // 8 * 8)
    padded = np.frombuffer(buffer + bytes(8), dtype=np.uint8)
    words = np.ndarray(shape=(len(padded) - 7,), dtype=">u8", buffer=padded.data, strides=(1,))
    repeated = np.zeros(len(starts), dtype=bool)
    live, group = np.arange(len(starts)), groups
    for depth in range(0, shallow, 8):
        # One turn of multikey quicksort: the next 8 bytes split every group at once.
        word = words[starts[live] + depth].astype(np.uint64)
        order = np.lexsort((word, group))
        live, group, word = live[order], group[order], word[order]
        fresh = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])) if len(live) else np.zeros(0, bool)
        number = np.cumsum(fresh) - 1
        together = np.bincount(number, minlength=1)[number] > 1 if len(live) else np.zeros(0, bool)
        live, group = live[together], number[together]
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(live) else np.zeros(0, np.int64)
    places = starts[live].tolist()
    bits = 8 * (length - shallow)
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(live)).tolist()):
        if b - a == 2:
            # Two strings: their trie is one comparison.
            p, q = places[a], places[a + 1]
            if buffer[p + shallow:p + length] == buffer[q + shallow:q + length]:
                repeated[live[a:b]] = True
            continue
        values = [int.from_bytes(buffer[p + shallow:p + length], "big") for p in places[a:b]]
        trie = BlindTrie(bits)
        for number, value in enumerate(values):
            trie.add(value, number, values)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                repeated[live[[a + i for i in leaf]]] = True
    return repeated


def _stretches(flags: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last of each run of flags that crosses no edge."""
    cut = np.zeros(len(flags) + 1, dtype=bool)
    cut[edges] = True
    before = np.append(False, flags)[:-1]
    first = np.flatnonzero(flags & (~before | cut[:-1]))
    after = np.append(flags[1:], False)
    last = np.flatnonzero(flags & (~after | cut[1:])) + 1
    return first, last


def _sorted_runs(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated stretches of starts in the runs of each bucket."""
    kind = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        data = b"".join(r[4] for r in rows)
        sizes = np.array([len(r[4]) for r in rows], dtype=np.int64)
        offsets = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), counts)
        ahead = np.cumsum(counts) - counts
        starts = np.arange(len(owner)) - ahead[owner] + offsets[owner]
        group = np.unique(np.array([r[0] for r in rows], dtype=np.int64), return_inverse=True)[1]
        flags = deep_shallow(data, starts, group[owner], length)
        first, last = _stretches(flags, ahead)
        held = owner[first]
        base = np.array([r[3] for r in rows], dtype=np.int64)[held] - ahead[held]
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][1] for i in held], pa.int64()), pa.array([rows[i][2] for i in held], pa.int64()),
            pa.array(first + base, pa.int64()), pa.array(last + base, pa.int64())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                # Rows come sorted by bucket: solve between two buckets.
                if size > SORT_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    dealt = contexts.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "id", "version", "start", "bytes").mapInArrow(run, "id long, version long, first long, last long")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, singly: bool) -> DataFrame:
    """Bytes of the wanted runs; ``singly``: instead, a digest of each start's string."""
    grouped = wanted.groupBy("id", "version").agg(F.collect_set(F.struct("bucket", "place")).alias("wanted"))
    joined = docs.select("id", "version", "text").join(grouped, ["id", "version"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal rows have the same runs, which are known to repeat: one of them is enough.
        seen = set()
        for part, texts in pieces(batches, "text"):
            out: list[list] = [[] for _ in range(5)]
            for doc, version, text, rows in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, part.column(3).to_pylist()):
                if (doc, version) in seen:
                    continue
                seen.add((doc, version))
                for row in rows:
                    start, number = row["place"] >> 16, row["place"] & 0xFFFF
                    for a, n in ((start + i, 1) for i in range(number)) if singly else ((start, number),):
                        string = text[a:a + n + length - 1]
                        for into, value in zip(out, (row["bucket"], doc, version, a, xxhash.xxh3_128_digest(string) if singly else string)):
                            into.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["bucket", "id", "version", "start", "bytes"])

    return joined.mapInArrow(run, "bucket long, id long, version long, start long, bytes binary")


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """Stretches [first, last) of starts whose strings occur more than once, by document key."""
    table = run_table(docs, length, gram)
    buckets = table.groupBy("bucket").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).filter("n > 1")
    held = written(table.join(buckets, "bucket").select(
        "bucket", "digest", "id", "version", "place", F.expr("low = high").alias("uniform"), "n"), "runs")
    mixed_runs = held.filter("not uniform")
    copies = mixed_runs.groupBy("bucket", "digest").agg(F.count("*").alias("copies"))
    judged = mixed_runs.join(copies, ["bucket", "digest"])
    whole = held.filter("uniform").select("id", "version", "place").unionByName(judged.filter("copies > 1").select("id", "version", "place"))
    start, number = F.shiftright("place", 16), F.col("place").bitwiseAND(0xFFFF)
    known = whole.select("id", "version", start.alias("first"), (start + number).alias("last"))
    # One copy stands for runs that are alike: it may repeat a part of another run.
    open_ = judged.select("bucket", "digest", "id", "version", "place", "copies", "n")
    sample = open_.filter("copies = 1").unionByName(open_.filter("copies > 1").dropDuplicates(["bucket", "digest"]))
    small = _contexts(docs, sample.filter(F.col("n") <= large), length, False)
    sorted_ = _sorted_runs(small, length)
    single = _contexts(docs, sample.filter(F.col("n") > large), length, True)
    alike = single.groupBy("bytes").agg(F.count("*").alias("alike")).filter("alike > 1")
    dealt = single.join(alike, "bytes").select("id", "version", F.col("start").alias("first"), (F.col("start") + 1).alias("last"))
    return known.unionByName(sorted_).unionByName(dealt)


def _removed(stretches: list, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes."""
    out: list[list[int]] = []
    for first, last in sorted(stretches):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length - 1)
        else:
            out.append([first, last + length - 1])
    return [(a, b) for a, b in out]


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """Per document: sizes, removed bytes and runs, digest and bytes of what is left."""
    keyed = _keyed(docs)
    starts = repeated_starts(keyed, length, gram, large).groupBy("id", "version").agg(F.collect_set(F.struct("first", "last")).alias("starts"))
    joined = keyed.join(starts, ["id", "version"], "left").select("doc_id", "text", "starts")
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                      ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            rows = []
            for doc, text, found in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist()):
                text = text or b""
                gone = _removed([(s["first"], s["last"]) for s in found or []], len(text), length)
                edges = [0, *(x for span in gone for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append({"doc_id": doc, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(gone),
                             "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return joined.selectExpr("cast(doc_id as long) AS doc_id", "text", "starts").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
