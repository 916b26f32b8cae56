"""Exact n-gram Jaccard join and its components, with prefixes under several orders.

Two sets of sizes a <= b with Jaccard similarity of at least t share an element
in the first ``n - ceil(t n) + 1`` of each, under any one order of all
elements. Candidates must share such a prefix element under every one of
several orders. All orders put rare elements first, by a corpus-wide count
sketch of fixed size, and differ in how they order equally rare ones. The first
common element also bounds the overlap by its places: a set with u elements from
there on can only reach t with sets of at most ``u (1 + t) / t - n`` elements.

Work is by class: documents with equal sets are one node. Steps:

1. one pass counts shingles into the sketch and describes each document's set;
2. a second pass sends prefix elements, packed by ranges of their hash, to
   tasks that keep, of each element, the nodes with another one of fitting
   length and place. Elements so frequent that one task could not hold them take
   an unpacked way of their own;
3. what is left meets the bitmaps of its nodes, and elements without a partner
   that passes the bound below are left out;
4. in each element's group, nodes are first paired with one hub; verified links
   give components. A few turns with other hubs join most of what belongs
   together;
5. then all nodes of a group that still lie in different components are paired,
   so that no link between components is missed, and verified. Pairs inside a
   component need no check: they cannot change the result.

Before any verification a pair must pass a bound: the bits in which two parity
bitmaps of the sets differ are at most the elements in which the sets differ.

Node ids are 64-bit digests of sets; verification compares whole sets.

Edge cases: null, empty and blank texts have an empty set and are alone, their
component is their own id; fewer than n words make one shingle; repeated rows
have the same component; a null doc_id is grouped with null as its component
unless a document with an id is linked to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from lexigrove.llm.graph import components
from lexigrove.llm.shared import SPACED_BYTES, discarded, mixed, narrow, pieces, raw, unused, written

WORDS = 4
PERCENT = 85

ORDERS = 2
CELLS = 1 << 21
PARTS = 8
MERGED_TASKS = 64
ENTRIES_PER_BUCKET = 1_000_000
ENTRIES_PER_ROW = 500_000
HEAVY = 1_000_000
ROWS_PER_FILE = 20_000
NEIGHBOURS = 32
HUBS = 2
LANES = 4
TURNS = 3
EARLIER = 3
MARKS = 1 << 24
BITS = 256
BITMAP = [f"bits{i}" for i in range(BITS // 64)]
SPACES = np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8)

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD,
        0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F]
PLACES = 64
HASHED_BYTES = 1 << 20


class Shingler:
    """Sets of n-word shingles as sorted 64-bit hashes, for many texts at once.

    A word's hash is the sum of a random number for each letter and place in
    the word (tabulation); places repeat after 64 letters, mixed with the lap.
    """

    def __init__(self, n: int):
        self.n = n
        self.weights = [np.uint64(w) for w in _ODD]
        self.letters = mixed(np.arange(256 * PLACES, dtype=np.uint64), 40)

    def sets(self, texts: list) -> list[np.ndarray]:
        line = np.frombuffer(b" ".join(t or b"" for t in texts).translate(SPACED_BYTES), dtype=np.uint8)
        word = np.concatenate([[False], ~np.isin(line, SPACES), [False]])
        starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
        codes = self._words(line, starts, ends)
        offsets = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
        bounds = np.searchsorted(starts, offsets)
        shingles = self._joined(codes, self.n)
        out = []
        for first, last in zip(bounds[:-1], bounds[1:]):
            if last - first >= self.n:
                own = np.sort(shingles[first:last - self.n + 1])
                out.append(own[np.append(True, own[1:] != own[:-1])])
            else:
                out.append(self._joined(codes[first:last], last - first) if last > first else np.zeros(0, np.uint64))
        return out

    def _words(self, line: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words, worked out for about a megabyte of letters at a time."""
        lengths = ends - starts
        upto = np.cumsum(lengths)
        out = np.zeros(len(starts), dtype=np.uint64)
        first = 0
        while first < len(starts):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + HASHED_BYTES, side="right")))
            own = lengths[first:last]
            at = upto[first:last] - own - done
            place = np.arange(upto[last - 1] - done) - np.repeat(at, own)
            letter = line[np.repeat(starts[first:last], own) + place].astype(np.int64)
            value = self.letters[letter * PLACES + place % PLACES]
            far = np.flatnonzero(place >= PLACES)
            if len(far):
                with np.errstate(over="ignore"):
                    value[far] = mixed(value[far] + (place[far] // PLACES).astype(np.uint64) * self.weights[0], 41)
            out[first:last] = mixed(np.add.reduceat(value, at), 42)
            first = last
        return out

    def _joined(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n words."""
        count = max(0, len(codes) - n + 1)
        with np.errstate(over="ignore"):
            total = np.full(count, n, dtype=np.uint64)
            for i in range(n):
                total = (total ^ (total >> np.uint64(29))) * self.weights[i % 8] + codes[i:count + i]
        return mixed(total)


def digest(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        return int((mixed(hashes, 1).sum(dtype=np.uint64) ^ np.uint64(len(hashes))).view(np.int64))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of numbers for each set, whose bits tell the parity of the elements that fall on them."""
    out = np.zeros((len(sets), BITS), dtype=np.uint8)
    for row, own in zip(out, sets):
        row[:] = np.bincount((mixed(own, 3) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(out, axis=1).view(np.int64)


def described(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """One row per document (id, text hash, size of the set, node) and, at each task's end, its part of the sketch."""
    kind = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()),
                      *((b, pa.int64()) for b in BITMAP), ("part", pa.int32()), ("task", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, cells = Shingler(n), np.zeros(CELLS, dtype=np.uint32)
        for part, texts in pieces(batches, "text"):
            sets = shingler.sets(texts)
            joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            cells += np.bincount((joined % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            rows = len(sets)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()),
                *(pa.array(x) for x in bitmaps(sets).T), *(pa.nulls(rows, kind.field(i).type) for i in (-3, -2, -1))], schema=kind)
        pack = zstandard.ZstdCompressor(level=3)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([
            {"part": i, "task": task, "counts": pack.compress(c.tobytes())} for i, c in enumerate(np.split(cells.astype(np.uint64), PARTS))], schema=kind)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").mapInArrow(
        run, f"doc_id long, version long, n_shingles long, node long, {', '.join(f'{b} long' for b in BITMAP)}, part int, task long, counts binary")


def rarity(sketch: DataFrame) -> np.ndarray:
    """Level of each cell: 0 for usual counts, one more for each doubling. Sums are taken in tasks; the result has a fixed size."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        tasks: dict[int, int] = {}
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part, task, counts in zip(*(batch.column(i) for i in range(3))):
                added = np.frombuffer(unpack.decompress(counts.as_py()), dtype=np.uint64)
                key = part.as_py()
                totals[key] = totals[key] + added if key in totals else added
                tasks[key] = task.as_py()
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(totals), pa.int32()), "task": pa.array([tasks[k] for k in totals], pa.int64()),
                                          "counts": pa.array([pack.compress(v.tobytes()) for v in totals.values()], pa.binary())})

    kind = "part int, task long, counts binary"
    few = sketch
    if (sketch.agg(F.max("task")).first()[0] or 0) >= MERGED_TASKS:
        some = sketch.withColumn("lot", F.floor(F.col("task") / MERGED_TASKS))
        few = some.repartition("part", "lot").select("part", "task", "counts").mapInArrow(summed, kind)
    rows = few.repartition(PARTS, "part").mapInArrow(summed, kind).collect()
    unpack = zstandard.ZstdDecompressor()
    parts = {r["part"]: np.frombuffer(unpack.decompress(r["counts"]), dtype=np.uint64) for r in rows}
    return np.concatenate([parts.get(i, np.zeros(CELLS // PARTS, np.uint64)) for i in range(PARTS)])


def buckets_for(counts: np.ndarray, percent: int) -> int:
    """Number of ranges in which the prefix elements of the corpus are held one at a time."""
    entries = float(counts.sum()) * ORDERS * (100 - percent) / 100
    return int(max(1, -(-entries // ENTRIES_PER_BUCKET)))


def partnered(token: np.ndarray, n: np.ndarray, most: np.ndarray, percent: int, bits: np.ndarray | None = None) -> np.ndarray:
    """Marks rows with a possible partner; rows come sorted by token and n.

    Two rows of a token are possible partners if each set is at most as large
    as the other one's ``most`` allows and the bitmaps, if given, do not prove
    that they differ too much. Each row is compared with NEIGHBOURS rows on
    either side; rows of larger groups stay if a neighbour's length fits.
    """
    keep = np.zeros(len(token), dtype=bool)
    at = np.arange(max(0, len(token) - 1))
    for d in range(1, NEIGHBOURS + 1):
        at = at[at + d < len(token)]
        at = at[token[at] == token[at + d]]
        if not len(at):
            return keep
        fits = at[(n[at + d] <= most[at]) & (n[at] <= most[at + d])]
        if bits is not None and len(fits):
            differing = np.bitwise_count(bits[fits] ^ bits[fits + d]).sum(axis=1, dtype=np.int64)
            fits = fits[differing * (100 + percent) <= (100 - percent) * (n[fits] + n[fits + d])]
        keep[fits] = keep[fits + d] = True
    far = at[at + NEIGHBOURS + 1 < len(token)]
    large = np.isin(token, np.unique(token[far[token[far] == token[far + NEIGHBOURS + 1]]]))
    near = np.flatnonzero(large[1:] & (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:]))
    keep[near] = keep[near + 1] = True
    return keep


def prefixes(docs: DataFrame, counts: np.ndarray, n: int = WORDS, percent: int = PERCENT, heavy: int = HEAVY) -> DataFrame:
    """Prefix elements that two or more nodes of fitting lengths and places share: (token, node, n, most, heavy).

    ``most`` is the largest size of a set that can be similar enough if the
    element is the first common one.
    """
    mean = max(float(counts.sum()) / CELLS, 1e-9)
    level = np.clip(np.floor(np.log2(np.maximum(counts / mean, 1e-9) * 4 / 3)), 0, 63).astype(np.uint8)
    many = counts >= heavy
    buckets = buckets_for(counts, percent)
    shared = docs.sparkSession.sparkContext.broadcast((level, many))
    packed_kind = pa.schema([("bucket", pa.int32()), ("node", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())),
                             ("own", pa.list_(pa.int32())), ("token", pa.list_(pa.int64())), ("most", pa.list_(pa.int32()))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, many = shared.value
        shingler = Shingler(n)
        held, size, seen = [], 0, set()

        def flush():
            if not held:
                return
            node = np.concatenate([np.full(len(h[2]), h[0], np.int64) for h in held])
            length = np.concatenate([np.full(len(h[2]), h[1], np.int32) for h in held])
            token, most, bucket = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
            for b in np.unique(bucket):
                at = np.flatnonzero(bucket == b)
                first = np.flatnonzero(np.concatenate([[True], node[at][1:] != node[at][:-1]]))
                own = np.diff(np.append(first, len(at)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([b], pa.int32()), pa.array([node[at][first]], packed_kind.field(1).type), pa.array([length[at][first]], packed_kind.field(2).type),
                    pa.array([own], packed_kind.field(3).type), pa.array([token[at]], packed_kind.field(4).type),
                    pa.array([most[at]], packed_kind.field(5).type)], schema=packed_kind)
            held.clear()

        for _, texts in pieces(batches, "text"):
            for own in shingler.sets(texts):
                if not len(own):
                    continue
                node = digest(own)
                if node in seen:
                    continue
                seen.add(node)
                keep = len(own) - -(-percent * len(own) // 100) + 1
                most = ((len(own) - np.arange(keep)) * (100 + percent) // percent - len(own)).astype(np.int32)
                cell = (own % np.uint64(CELLS)).astype(np.int64)
                for order in range(ORDERS):
                    rank = (mixed(own, 10 + order) >> np.uint64(6)) | (level[cell].astype(np.uint64) << np.uint64(58))
                    chosen = np.argsort(rank, kind="stable")[:keep]
                    # The remainder of a token by the number of orders tells its order.
                    token = mixed(own[chosen], 20) // np.uint64(2 * ORDERS) * np.uint64(ORDERS) + np.uint64(order)
                    bucket = (token % np.uint64(buckets)).astype(np.int32)
                    bucket[many[cell[chosen]]] = -1
                    held.append((node, len(own), token.view(np.int64), most, bucket))
                    size += len(chosen)
            if size >= ENTRIES_PER_ROW:
                yield from flush()
                size = 0
                if len(seen) > 1_000_000:
                    seen.clear()
        yield from flush()

    kind = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("most", pa.int32())])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            node, length, own, token, most = (batch.column(n).flatten().to_numpy() for n in ("node", "n", "own", "token", "most"))
            parts.append((token, np.repeat(node, own), np.repeat(length, own), most))
        if not parts:
            return
        rows = [np.concatenate(column) for column in zip(*parts)]
        # One copy of the entries at a time: the batches' own go before they are sorted.
        del parts, batch, node, length, own, token, most
        order = np.lexsort((rows[1], rows[2], rows[0]))
        token, node, length, most = (rows.pop(0)[order] for _ in range(4))
        del order
        fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        token, node, length, most = (x[fresh] for x in (token, node, length, most))
        keep = np.flatnonzero(partnered(token, length.astype(np.int64), most, percent))
        for i in range(0, len(keep), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[keep[i:i + 200_000]]) for x in (token, node, length, most)], schema=kind)

    rows = docs.select("text").mapInArrow(packed, "bucket int, node array<long>, n array<int>, own array<int>, token array<long>, most array<int>")
    light = (rows.filter("bucket >= 0").repartition(buckets, "bucket").mapInArrow(repeated, "token long, node long, n int, most int")
             .withColumn("heavy", F.lit(False)))
    if not many.any():
        return light

    def each(name: str):
        repeats = F.transform(F.arrays_zip(name, "own"), lambda x: F.array_repeat(x[name], x["own"]))
        return F.flatten(repeats).alias(name)

    spread = F.explode(F.arrays_zip("token", each("node"), each("n"), "most"))
    return light.unionByName(rows.filter("bucket < 0").select(spread.alias("x")).select("x.token", "x.node", "x.n", "x.most").distinct()
                             .withColumn("heavy", F.lit(True)))


def likely(rows: DataFrame, buckets: int, percent: int) -> DataFrame:
    """The rows (token, node, n, most, heavy, bitmaps) with a possible partner by length, place and bitmap; heavy tokens stay whole."""
    names = [c for c in rows.columns if c != "heavy"]
    kind = ", ".join(f"{c} long" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        columns = {c: table.column(c).to_numpy() for c in names}
        order = np.lexsort((columns["n"], columns["token"]))
        columns = {c: x[order] for c, x in columns.items()}
        bits = np.stack([columns[b] for b in BITMAP], axis=1).view(np.uint64)
        keep = np.flatnonzero(partnered(columns["token"], columns["n"], columns["most"], percent, bits))
        for i in range(0, len(keep), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(columns[c][keep[i:i + 200_000]]) for c in names], names=names)

    wide = [F.col(c).cast("long") for c in names]
    light = rows.filter("not heavy").select(wide).repartition(buckets, "token").mapInArrow(run, kind)
    return light.unionByName(rows.filter("heavy").select(wide))


def _lengths_fit():
    """Whether each of the rows a and b allows for the other's length."""
    return (F.col("a_n") <= F.col("b_most")) & (F.col("b_n") <= F.col("a_most"))


def _may_link(a: str, b: str, percent: int):
    """False for pairs that the bitmaps prove to differ too much. ``a`` and ``b``: prefixes of columns n and bits."""
    differing = sum((F.bit_count(F.col(f"{a}{x}").bitwiseXOR(F.col(f"{b}{x}"))) for x in BITMAP), F.lit(0))
    return differing * (100 + percent) <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))


def _prefixed(prefix: str, *names: str) -> list:
    return [F.col(c).alias(prefix + c) for c in (*names, "n", "most", *BITMAP)]


def hub_pairs(placed: DataFrame, sets: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each node with the nearest of its groups' hubs that lie in other components, if they share an element under all orders.

    ``placed``: order_no, token, node, n, most, bitmaps and component; ``sets``: node
    and its tokens by order. Sizes and bitmaps are tested while rows meet their
    group's hub. The hub is the first by a hash of node, turn and one of a few
    lanes of tokens, so that the groups of one cluster agree on few hubs.
    """
    order = F.struct(F.xxhash64(F.lit(turn), F.pmod("token", F.lit(ORDERS * LANES)), "node"), "node")
    hubs = (placed.groupBy("order_no", "token").agg(F.min_by(F.struct(*_prefixed("b_", "node", "component")), order).alias("hub"))
            .select("order_no", "token", "hub.*"))
    differing = sum((F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in BITMAP), F.lit(0))
    # A node has no more hubs than elements.
    near = F.sort_array(F.collect_set(F.struct(differing.alias("differing"), "b_node")))
    chosen = written(narrow(placed.select("order_no", "token", *_prefixed("a_", "node", "component")).join(hubs, ["order_no", "token"])
                     .filter((F.col("a_component") != F.col("b_component")) & _lengths_fit() & _may_link("a_", "b_", percent))
                     .groupBy("a_node").agg(F.slice(near, 1, HUBS).alias("near")).select("a_node", F.explode("near.b_node").alias("b_node"))
                     .select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()), "chosen")
    sets = sets.join(_ends(chosen), "node", "left_semi")
    meeting = chosen.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("a_tokens")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("tokens").alias("b_tokens")), "b")
    shared = [F.arrays_overlap(F.col("a_tokens")[i], F.col("b_tokens")[i]) for i in range(ORDERS)]
    return meeting.filter(F.forall(F.array(*shared), lambda x: x)).select("a", "b")


def tokens_of(shared: DataFrame) -> DataFrame:
    """The shared prefix tokens of each node by order: (node, tokens), at most a prefix of its set under each order."""
    by_order = [F.collect_list(F.when(F.col("order_no") == i, F.col("token"))) for i in range(ORDERS)]
    return shared.groupBy("node").agg(F.array(*by_order).alias("tokens"))


def across(placed: DataFrame) -> DataFrame:
    """The rows of elements whose nodes lie in several components; the others can link nothing any more."""
    several = placed.groupBy("order_no", "token").agg(F.min("component").alias("least"), F.max("component").alias("largest")).filter("least <> largest")
    return placed.join(several.select("order_no", "token"), ["order_no", "token"], "left_semi")


def meetings(placed: DataFrame, percent: int) -> DataFrame:
    """Nodes of different components that share an element and may be similar enough: (order_no, a_node, b_node).

    Near copies share many elements, and all but their first common one tell
    nothing new. Each row knows the few elements of its node before its own: two
    rows with one of them in common are left out, as their nodes meet there too,
    with earlier places and so with looser bounds. The first meeting always stays.
    """
    per = placed.groupBy("order_no", "token", "component").agg(F.count("*").alias("n_nodes"))
    main = (per.groupBy("order_no", "token").agg(F.max_by("component", F.struct("n_nodes", "component")).alias("main"), F.count("*").alias("kinds"))
            .filter("kinds > 1").select("order_no", "token", "main"))
    # A later place has a smaller ``most``.
    earlier = W.partitionBy("order_no", "node").orderBy(F.desc("most")).rowsBetween(-EARLIER, -1)
    inside = written(placed.join(main, ["order_no", "token"]).withColumn("before", F.collect_list("token").over(earlier)), "groups")
    left = inside.filter("component <> main").select("order_no", "token", *_prefixed("a_", "node", "component", "before"))
    right = inside.select("order_no", "token", "main", *_prefixed("b_", "node", "component", "before"))
    return (left.join(right, ["order_no", "token"])
            .filter((F.col("a_component") != F.col("b_component")) & ((F.col("b_component") == F.col("main")) | (F.col("a_node") < F.col("b_node")))
                    & _lengths_fit() & _may_link("a_", "b_", percent) & ~F.arrays_overlap("a_before", "b_before"))
            .select("order_no", "a_node", "b_node"))


def cross_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of different components that share a prefix element under every order and may be similar enough."""
    return (meetings(placed, percent).groupBy(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
            .agg(F.count_distinct("order_no").alias("orders")).filter(F.col("orders") == ORDERS).select("a", "b"))


def likely_chosen(known: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose id and version are among the chosen ones, and few others: a bitmap of fixed size tells most of the rest."""
    cells = [F.pmod(F.xxhash64(F.lit(i), "id", "version"), F.lit(MARKS)).cast("long") for i in range(2)]
    words = (chosen.select(F.explode(F.array(*cells)).alias("cell")).groupBy(F.shiftright("cell", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(cell % 64 AS INT)))").alias("bits")).toArrow())
    bitmap = np.zeros(MARKS // 64, dtype=np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = known.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    @F.arrow_udf(T.BooleanType())
    def marked(first: pa.Array, second: pa.Array) -> pa.Array:
        found = np.ones(len(first), dtype=bool)
        for column in (first, second):
            cell = column.to_numpy(zero_copy_only=False)
            found &= (shared.value[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pa.array(found)

    return known.filter(marked(*cells))


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of the chosen nodes: (node, text). ``chosen``: node with the id and text hash of one of its documents."""
    known = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("version"), "text")
    # A node is chosen with one id and version, so repeated rows go without another shuffle.
    return likely_chosen(known, chosen).join(chosen, ["id", "version"]).dropDuplicates(["id", "version"]).select("node", "text")


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs, written: few of them are broadcast by Spark's own threshold, so other nodes are not shuffled."""
    return written(narrow(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "ends")


def verified(pairs: DataFrame, texts: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets are similar enough, compared as a whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for part, rights in pieces(batches, "b_text"):
            firsts, seconds = part.column(0).to_pylist(), part.column(1).to_pylist()
            texts = dict(zip(seconds, rights)) | dict(zip(firsts, raw(part.column(2)).to_pylist()))
            own = dict(zip(texts, shingler.sets(list(texts.values()))))
            keep = []
            for a, b in zip(firsts, seconds):
                one, other = own[a], own[b]
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(other) - both))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = texts.join(_ends(pairs), "node", "left_semi")
    one, other = texts.toDF("a", "a_text"), texts.toDF("b", "b_text")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def placed(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, heavy: int = HEAVY) -> DataFrame:
    """Per document: doc_id, text hash, size of its set and the root of its component."""
    stats = written(described(docs, n), "shingles")
    rows = stats.filter("part is null").select("doc_id", "version", "n_shingles", "node", *BITMAP)
    counts = rarity(stats.filter("part is not null").select("part", "task", "counts"))
    every = written(prefixes(docs, counts, n, percent, heavy), "prefixes")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), "version")).alias("first")
    nodes = written(narrow(rows.filter("n_shingles > 0").groupBy("node").agg(first, *(F.min(b).alias(b) for b in BITMAP))
                    .join(_under_all_orders(every), "node", "left_semi").select("node", *BITMAP, "first.id", "first.version")), "nodes")
    shared = written(likely(every.join(nodes.select("node", *BITMAP), "node"), buckets_for(counts, percent), percent)
                     .withColumn("order_no", _order_no()), "elements")
    sets = written(tokens_of(shared.join(_under_all_orders(shared), "node", "left_semi")), "tokens")
    # Written, so that Spark knows its size: a small choice is broadcast by Spark's own threshold, a large one shuffles the texts it may need.
    chosen = written(narrow(nodes.select("node", "id", "version").join(sets, "node", "left_semi")), "named")
    texts = written(texts_of(docs, chosen), "texts")
    discarded(every, chosen)
    member = tried = None
    for turn in range(TURNS + 1):
        if not turn:
            at = shared.withColumn("component", F.col("node"))
        else:
            # Nodes without a smaller one in reach are their components' roots.
            at = shared.drop("component").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
            # What is left of a small table needs few tasks and files; a large one keeps its partitions.
            at = written(across(at).coalesce(max(1, -(-shared.count() // ROWS_PER_FILE))), "elements")
            discarded(shared)
            shared = at
        pairs = hub_pairs(at, sets, turn, percent) if turn < TURNS else cross_pairs(at, percent)
        pairs = written(narrow(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = written(narrow(verified(pairs, texts, n, percent)), "found")
        if turn == 0 or not found.isEmpty():
            member = components(found, member)
    discarded(shared, sets, texts)
    return (rows.join(member.withColumnRenamed("component", "root"), "node", "left")
            .select("doc_id", "version", "n_shingles", F.coalesce("root", "node").alias("root")))


def joined(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, heavy: int = HEAVY) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    rows = placed(docs, n, percent, heavy)
    least = rows.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return (rows.join(least, "root", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest id of each component, and all documents without words."""
    key = unused([*docs.columns, "n_shingles", "root", "first"], "_id", "_version")
    rows = placed(docs, n, percent).select(F.coalesce("doc_id", F.lit(-1)).alias(key[0]), F.col("version").alias(key[1]), "n_shingles", "root")
    first = rows.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    kept = first.unionByName(rows.filter("n_shingles = 0").select(*key).distinct())
    keyed = docs.select("*", F.coalesce("doc_id", F.lit(-1)).alias(key[0]), F.xxhash64("text").alias(key[1]))
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def _order_no():
    """The number of a token's order, which its remainder tells."""
    return F.pmod("token", F.lit(ORDERS)).cast("int")


def _under_all_orders(rows: DataFrame) -> DataFrame:
    """The nodes with elements under every order."""
    return rows.groupBy("node").agg(F.count_distinct(_order_no()).alias("orders")).filter(F.col("orders") == ORDERS).select("node")
