"""Prefix trie of conversations from double-array tries of sorted shards.

A turn is the 16-byte digest of its role and text; a conversation is the string
of its turns' digests, so neither texts nor single turns are shuffled after the
first grouping. Equal conversations become one sequence with a count (their ids
are hashed while a sorted stream passes by, never gathered). The sequences are
dealt by range, sorted, and cut into shards of about ``SHARD_TURNS`` turns: a
shard holds the conversations of one stretch of prefixes, however common a
prefix is.

In a shard the turns get dense ids and the trie is packed level by level into
the arrays BASE and CHECK: the child of state s by turn t is BASE[s] + t, valid
where CHECK of it is s. Following the arrays gives every sequence's nodes and
their aggregates. A node off the paths of the shard's first and last sequence
lies in no other shard and is final. The nodes on these two paths are merged
globally by the digest of their prefix; sums over their subtrees run along the
paths, each node's own value being added on one of the paths through it, so the
number of jobs does not grow with the depth.

Edge cases: rows without conv_id are left out; null roles and texts are empty; a
null turn number comes first; turns with equal numbers (repeated rows too) all
stay, in the order of their digests. Very long texts are read once, for their
digest and word count. A very long conversation is one row of 20 bytes a turn
and a shard of its own. An empty table has no root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexigrove.llm.shared import written

# --- fixed values: how conversations are rebuilt ---
FAMILY = 20
HEADS = 4

SHARD_TURNS = 500_000
RANGE_TURNS = 64
TURN_BYTES = 16
NONE = hashlib.sha256(b"").hexdigest()

NODES = ("open boolean, path long, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, n_words long, ends_sha256 string")
TYPES = pa.schema([("open", pa.bool_()), ("path", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
                   ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                   ("saved_tokens", pa.int64()), ("n_words", pa.int64()), ("ends_sha256", pa.string())])


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2 * TURN_BYTES))


def _sequence(turns: Column) -> list[Column]:
    """Ordered turns as one byte string and the numbers of their words."""
    return [F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["id"])), "")).alias("turns"), F.transform(turns, lambda t: t["words"]).alias("words")]


def _ordered(conversations: DataFrame, *group: str) -> DataFrame:
    """Each conversation's turns in order: (id, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        _digest(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    return rows.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition("family").groupBy("family", "conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "id", "words"))), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """Conversations as they are: conv_id, turns (16 bytes each), words (of each turn)."""
    return _ordered(conversations).select("conv_id", *_sequence(F.col("turns")))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of their family's first one, as sequences."""
    own = _ordered(conversations)
    first = own.filter(F.col("conv_id") == F.col("family")).select("family", F.slice("turns", 1, HEADS - 1).alias("first"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    # Families are dealt together: the join needs no further shuffle.
    both = own.join(first, "family", "left").withColumn("taken", taken)
    head = F.coalesce(F.slice("first", F.lit(1), F.col("taken")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns") - F.col("taken"), F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("turns")).select("conv_id", *_sequence(F.col("turns")))


def _distinct(stored: DataFrame) -> DataFrame:
    """One row per distinct sequence: its smallest conversation, their number and the digest of their ids."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, least, n = None, None, None, 0
        for batch in batches:
            keys, ids, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for key, conv_id in zip(keys, ids):
                if key != last:
                    if n:
                        out.append((least, n, state.hexdigest()))
                    last, state, least, n = key, hashlib.sha256(b"%d" % conv_id), conv_id, 1
                else:
                    state.update(b",%d" % conv_id)
                    n += 1
            yield pa.RecordBatch.from_arrays(_columns(out, 3, [pa.int64(), pa.int64(), pa.string()]), names=["conv_id", "n", "ends"])
        if n:
            yield pa.RecordBatch.from_arrays(_columns([(least, n, state.hexdigest())], 3, [pa.int64(), pa.int64(), pa.string()]), names=["conv_id", "n", "ends"])

    named = stored.select(_digest(F.col("turns")).alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return stored.join(named.mapInArrow(hashed, "conv_id long, n long, ends string"), "conv_id")


def _columns(rows: list[tuple], width: int, types: list) -> list[pa.Array]:
    columns = list(zip(*rows)) or [()] * width
    return [pa.array(c, t) for c, t in zip(columns, types)]


class DoubleArray:
    """A trie of sequences of dense ids (1 and up), packed into BASE and CHECK. State 0 is the root."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """``flat``: the ids of all sequences, sorted so that equal prefixes are neighbours."""
        self.flat, self.starts, self.lengths = flat, starts, lengths
        self.base = np.zeros(1024, dtype=np.int64)
        self.check = np.full(1024, -1, dtype=np.int64)
        self.check[0], self.end, self.low = 0, 1, 1
        state = np.zeros(len(lengths), dtype=np.int64)
        active, depth = np.arange(len(lengths)), 0
        while True:
            active = active[lengths[active] > depth]
            if not len(active):
                break
            s, t = state[active], flat[starts[active] + depth]
            new = np.ones(len(active), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
            state[active] = self._pack(s[new], t[new])[np.cumsum(new) - 1]
            depth += 1

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _holes(self, wanted: int) -> np.ndarray:
        """Free cells below the end, lowest first, of a window that moves on as it fills."""
        window = min(self.end, self.low + 2 * wanted + 1024)
        free = np.flatnonzero(self.check[self.low:window] < 0) + self.low
        self.low = int(free[0]) if len(free) else window
        return free[:wanted]

    def _pack(self, parents: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Cells for the children (parent, turn); children of one parent are neighbours."""
        heads = np.flatnonzero(np.diff(parents, prepend=-1))
        counts = np.diff(np.append(heads, len(parents)))
        cells = np.empty(len(parents), dtype=np.int64)
        # An only child fits into any free cell.
        alone = heads[counts == 1]
        holes = self._holes(len(alone))
        fresh = len(alone) - len(holes)
        cells[alone] = np.concatenate([holes, np.arange(self.end, self.end + fresh)])
        self.end += fresh
        self._grow(self.end)
        self.base[parents[alone]] = cells[alone] - turns[alone]
        self.check[cells[alone]] = parents[alone]
        for head, count in zip(heads[counts > 1], counts[counts > 1]):
            own = turns[head:head + count]
            least = int(own.min())
            base = self.end - least
            holes = self._holes(64)
            if len(holes):
                tried = (holes - least)[:, None] + own
                self._grow(int(tried.max()) + 1)
                fits = np.flatnonzero((self.check[tried] < 0).all(axis=1))
                if len(fits):
                    base = int(holes[fits[0]]) - least
            self.end = max(self.end, base + int(own.max()) + 1)
            self._grow(self.end)
            cells[head:head + count] = base + own
            self.base[parents[head]] = base
            self.check[base + own] = parents[head]
        return cells

    def child(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The states reached, -1 where there is no such child."""
        cells = self.base[states] + turns
        inside = (cells > 0) & (cells < self.end)
        return np.where(inside & (self.check[np.where(inside, cells, 0)] == states), cells, -1)

    def traverse(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Level by level from depth 1: the sequences that reach it and their states."""
        state, active, depth = np.zeros(len(self.lengths), dtype=np.int64), np.arange(len(self.lengths)), 0
        while True:
            active = active[self.lengths[active] > depth]
            if not len(active):
                return
            state[active] = self.child(state[active], self.flat[self.starts[active] + depth])
            depth += 1
            yield active, state[active]


def _keys(turns: bytes) -> list[bytes]:
    """Digests of all prefixes of a sequence, the empty one first."""
    rolling, out = hashlib.sha256(), []
    out.append(rolling.digest())
    for i in range(0, len(turns), TURN_BYTES):
        rolling.update(turns[i:i + TURN_BYTES])
        out.append(rolling.copy().digest())
    return out


def _shard(rows: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard: (conv_id, turns, words, n, ends) by turns."""
    conv_ids, turns, words, counts, ends = zip(*rows)
    lengths = np.array([len(t) // TURN_BYTES for t in turns])
    starts = np.cumsum(lengths) - lengths
    _, first, ids = np.unique(np.frombuffer(b"".join(turns), f"S{TURN_BYTES}"), return_index=True, return_inverse=True)
    dense = np.argsort(np.argsort(first)) + 1
    trie = DoubleArray(dense[ids].astype(np.int64), starts, lengths)
    member, many = np.array(conv_ids, dtype=np.int64), np.array(counts, dtype=np.int64)
    flat_words = np.concatenate([np.asarray(w, dtype=np.int64) for w in words])

    size = trie.end
    n, least, said = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    depth, children, final = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(len(rows), 0)
    n[0], least[0] = many.sum(), member.min()
    levels = []
    for at, (active, states) in enumerate(trie.traverse()):
        new = np.flatnonzero(np.diff(states, prepend=-1))
        nodes = states[new]
        n[nodes] = np.add.reduceat(many[active], new)
        least[nodes] = np.minimum.reduceat(member[active], new)
        said[nodes] = flat_words[starts[active[new]] + at]
        depth[nodes] = at + 1
        np.add.at(children, trie.check[nodes], 1)
        final[active] = states
        levels.append(nodes)
    leaves = (children == 0).astype(np.int64)
    saved = (n - 1) * said
    ended = {int(s): e for s, e in zip(final, ends)}

    # The paths of the first and the last sequence may go on in other shards.
    open_ = np.zeros(size, dtype=bool)
    open_[0] = True
    paths = []
    for which in sorted({0, len(rows) - 1}):
        path, state = [0], np.zeros(1, np.int64)
        for t in trie.flat[starts[which]:starts[which] + lengths[which]]:
            state = trie.child(state, np.array([t]))
            path.append(int(state[0]))
        open_[path] = True
        paths.append((2 * number + bool(which), path, _keys(turns[which])))
    leaves[open_], saved[open_] = 0, 0
    closed_children = np.zeros(size, np.int64)
    for nodes in reversed(levels):
        nodes = nodes[~open_[nodes]]
        above = trie.check[nodes]
        np.add.at(leaves, above, leaves[nodes])
        np.add.at(saved, above, saved[nodes])
        np.add.at(closed_children, above, 1)

    key_of: dict[int, bytes] = {}
    out = []
    for path_number, path, keys in paths:
        for d, (state, key) in enumerate(zip(path, keys)):
            met = state in key_of
            key_of[state] = key
            # A node on both paths of the shard brings its numbers once.
            out.append((True, path_number, key, keys[d - 1] if d else None, d, int(least[state]), None,
                        *((0, 0, 0, 0) if met else (int(n[state]), int(closed_children[state]), int(leaves[state]), int(saved[state]))),
                        int(said[state]), ended.get(state)))
    yield pa.RecordBatch.from_arrays(_columns(out, len(TYPES), TYPES.types), schema=TYPES)

    nodes = np.concatenate([*levels, np.zeros(0, np.int64)]).astype(np.int64)
    nodes = nodes[~open_[nodes]]
    if len(nodes):
        above = trie.check[nodes]
        hanging = open_[above]
        none = pa.nulls(len(nodes), pa.binary())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.zeros(len(nodes), bool)), pa.nulls(len(nodes), pa.int64()), none,
            pa.array([key_of[int(a)] if h else None for a, h in zip(above, hanging)], pa.binary()), pa.array(depth[nodes]), pa.array(least[nodes]),
            pa.array(least[above], mask=hanging), pa.array(n[nodes]), pa.array(children[nodes]), pa.array(leaves[nodes]), pa.array(saved[nodes]),
            pa.array(said[nodes]), pa.array([ended.get(int(s)) for s in nodes], pa.string())], schema=TYPES)


def _tries(distinct: DataFrame, shard_turns: int) -> DataFrame:
    """Nodes of all shards: final ones, and open ones with what their shard knows of them."""
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                rows.append(row)
                held += len(row[2]) + 1
                if held >= shard_turns:
                    yield from _shard(rows, number)
                    rows, held, number = [], 0, number + 1
        if rows:
            yield from _shard(rows, number)

    # The order of long sequences is told by their first turns; full sequences order the rows of a task.
    dealt = distinct.select("conv_id", "turns", "words", "n", "ends").repartitionByRange(F.substring("turns", 1, RANGE_TURNS * TURN_BYTES))
    return dealt.sortWithinPartitions("turns").mapInArrow(built, NODES)


def _merged(open_: DataFrame) -> DataFrame:
    """Open nodes over all shards, with sums over their subtrees."""
    known = open_.groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"),
        F.max("n_words").alias("n_words"), F.min("path").alias("owner"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    below = known.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("below"))
    known = written(known.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("below", F.lit(0)))
                    .withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
                    .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_words")).drop("below"), "open-nodes")
    upwards = W.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)

    def owned(name: str) -> Column:
        return F.sum(F.when(F.col("owner") == F.col("path"), F.col(name)).otherwise(0)).over(upwards).alias(name)

    sums = (open_.select("path", "key").join(known.select("key", "depth", "owner", "n_leaves", "saved_tokens"), "key")
            .select("key", owned("n_leaves"), owned("saved_tokens")).groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    return written(known.drop("n_leaves", "saved_tokens", "owner").join(sums, "key"), "open-nodes")


def nodes(stored: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of sequences (conv_id, turns, words).

    Per node: its smallest conversation and depth, which name it; its parent's
    smallest conversation; members, children, leaves below, the words of the
    last turn that sharing saves in the subtree, and the digest of the ids of
    the conversations that end there.
    """
    found = written(_tries(_distinct(stored), shard_turns), "trie-nodes")
    merged = _merged(found.filter("open"))
    parents = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
               F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")]
    inner = found.filter("not open and parent is null").select(*columns)
    hanging = found.filter("not open and parent is not null").join(parents, "parent").withColumn("parent_conv_id", F.col("above")).select(*columns)
    upper = merged.join(parents, "parent", "left").withColumn("parent_conv_id", F.col("above")).select(*columns)
    return inner.unionByName(hanging).unionByName(upper)


def prefix_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return nodes(written(rebuilt(conversations), "sequences"), shard_turns)
