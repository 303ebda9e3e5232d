"""N-gram Jaccard self-join: rare-first prefix filtering, and the components of what it links.

A document's set holds its different shingles of five words; documents with equal sets are one
node from the start. Two nodes link when 100 * intersection >= 80 * union.

1. Each task hashes the shingles of its documents and deals them out by shingle. Where they meet,
   the nodes that hold a shingle are counted, and those that only one node holds go: no link can
   rest on them. A shingle that a task sees ``hot`` times or more is counted there and crosses as
   one count, and the sum comes back as one, while its places stay with their nodes. So no task gets all places of a
   common passage. Nodes travel as small numbers of the chunk that a task gathered, so what is
   shuffled is a few bytes for each shingle, however many buckets there are.
2. At its chunk, what is left of a set is put in order, rare first: by the number of nodes that hold
   a shingle, then by hash. A node with too few shared
   shingles for any link is done.
3. Prefix filter: linked nodes share a shingle among the first n - ceil(0.8 n) + 1 of their sets
   in this order, so the prefixes are joined on shingles. The pairs of a shingle are not listed:
   of those who share it, the smallest node is the pivot, and all who share shingles with one
   pivot are its canopy. Any two nodes that share a prefix shingle share a canopy.
4. A canopy is verified in blocks of at most about ``block`` nodes and ``BLOCK_SHINGLES`` shingles: first each node against the pivot, then within the block
   those pairs that are not connected yet; each passes length, prefix, positional and suffix filter, then is
   counted exactly, once. What connects nothing new is not looked at: components stay exact, and a
   family of thousands of near copies costs about one pass.
5. Nodes of a larger canopy that the pivot's component does not hold are at last tried against
   all its other blocks, block by block.

link_counts() goes on to count each document's links. There all pairs of a canopy are verified, block against block, each pair once: in the
smallest canopy that holds both. Only sums leave a task.

Defined results. A-Z count as a-z; null text counts as empty. A text with one to four words is one
shingle; one without words has an empty set, and links with nothing: its component is its own doc_id.
Component ids are the smallest doc_id, nulls last. Repeated rows are copies. An empty table gives an
empty result; other columns are not read. Shingles and sets are told apart by 64- and 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, bucket_of, documents, free_names, from_numbers, map_batches, numbers, packed_planes, plain, saved, slices, text_buffer, unblobs, unpacked_planes
from .components import components
from .words import mixed, words

WIDTH = 5
#: Shingles that a task gathers before it deals them out.
GATHER = 1_000_000
HOT_GROUPS = 1000
#: Shingles of a bucket where their nodes are counted, and of a block of a canopy.
PER_BUCKET, BLOCK_SHINGLES = 1_500_000, 2_000_000
BIG = np.int32(1 << 30)


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    h, text = words(raw, at)
    bounds = np.searchsorted(text, np.arange(len(at)))
    grams = np.zeros(len(h), np.uint64)
    n = len(h) - WIDTH + 1
    if n > 0:
        x = np.full(n, WIDTH, np.uint64)
        for k in range(WIDTH):
            x = x * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
        grams[:n] = mixed(x)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s >= WIDTH:
            yield np.unique(grams[s : e - WIDTH + 1])
        elif e > s:
            x = np.uint64(e - s)
            for k in range(s, e):
                x = x * np.uint64(0xD6E8FEB86659FD93) + h[k]
            yield mixed(np.array([x], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def needed(n):
    """The least overlap with any set: ceil(0.8 n)."""
    return (4 * n + 4) // 5


class Sets:
    """One row for each document: n_shingles and what stands for its set (null if empty)."""

    def __init__(self, passed: list[str]):
        self.passed = passed

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [(len(s), key_of(s) if len(s) else None) for s in shingle_sets(*text_buffer(b.column("text")))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in self.passed), pa.array([n for n, _ in sets], pa.int64()), pa.array([k for _, k in sets], pa.binary())], [*self.passed, "n_shingles", "node"])


class Deal:
    """Deals the shingles of a task's nodes out by hash. A task's nodes come in chunks, and are numbers in them.

    kind 0: hot shingles of a chunk and their counts; 1: hot places, for the chunk itself; 2: all other places;
    3: the chunk's nodes, for itself. Places and shingles are sorted by shingle.
    """

    def __init__(self, buckets: int, hot: int):
        self.buckets, self.hot = buckets, hot

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        chunk, seen, keys, sets, size = TaskContext.get().partitionId() << 24, set(), [], [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                for s in shingle_sets(*text_buffer(b.column("text"))):
                    if not len(s) or (key := key_of(s)) in seen:
                        continue
                    seen.add(key)
                    keys.append(key)
                    sets.append(s)
                    size += len(s)
                if size >= GATHER:
                    yield from self.dealt(chunk, keys, sets)
                    chunk, keys, sets, size = chunk + 1, [], [], 0
        if keys:
            yield from self.dealt(chunk, keys, sets)

    def dealt(self, chunk: int, keys: list[bytes], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = np.array([len(s) for s in sets])
        grams, node = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(grams, kind="stable")
        grams, node = grams[order], node[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        count = np.diff(np.append(first, len(grams)))
        is_hot = np.repeat(count >= self.hot, count)
        own = chunk % self.buckets
        rows = [(own, 3, chunk, blobs(b"".join(keys), numbers(n)))]
        if is_hot.any():
            rows.append((own, 1, chunk, places(grams[is_hot], node[is_hot], np.zeros(0))))
            hot, n_hot = grams[first[count >= self.hot]], count[count >= self.hot]
            where = bucket_of(hot, self.buckets)
            rows += [(k, 0, chunk, blobs(hot[where == k].tobytes(), numbers(n_hot[where == k]))) for k in np.unique(where).tolist()]
            grams, node = grams[~is_hot], node[~is_hot]
        cuts = np.searchsorted(bucket_of(grams, self.buckets), np.arange(self.buckets + 1))
        rows += [(k, 2, chunk, places(grams[a:z], node[a:z], np.zeros(0))) for k, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < z]
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 64]], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["bucket", "kind", "chunk", "payload"])


def places(grams: np.ndarray, node: np.ndarray, weight: np.ndarray) -> bytes:
    """Ascending shingles as differences, the node of each, and perhaps a weight."""
    return blobs(packed_planes(np.diff(grams, prepend=np.uint64(0))), numbers(node), numbers(weight.astype(np.int64)))


def from_places(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, node, weight = unblobs(payload)
    return np.cumsum(unpacked_planes(steps, "u8"), dtype=np.uint64), from_numbers(node), from_numbers(weight)


class Count:
    """Counts the nodes of each shingle of a bucket, and sends those that more than one place has back to their chunks, with the count; of a chunk's hot shingles (kind 0) the counts alone.

    A node that stands in several chunks counts in each; so its shingles may weigh more, but no link is lost by that.
    """

    def __call__(self, table: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        rows = list(zip(table.column("kind").to_pylist(), table.column("chunk").to_pylist(), table.column("payload").to_pylist(), strict=True))
        out = [(c, k, p) for k, c, p in rows if k in (1, 3)]
        hot = [(c, *unblobs(p)) for k, c, p in rows if k == 0]
        hot_grams, hot_counts = [np.frombuffer(g, np.uint64) for _, g, _ in hot], [from_numbers(n) for _, _, n in hot]
        chunks, parts = [c for k, c, _ in rows if k == 2], [from_places(p)[:2] for k, _, p in rows if k == 2]
        if parts or hot:
            # A hot shingle of a chunk is one entry that counts for many.
            grams = np.concatenate([*(g for g, _ in parts), *hot_grams])
            many = np.concatenate([np.ones(sum(len(g) for g, _ in parts), np.int64), *hot_counts])
            order = np.argsort(grams, kind="stable")
            g = grams[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            by_place = np.empty(len(g), np.int64)
            by_place[order] = np.repeat(np.add.reduceat(many[order], first), np.diff(np.append(first, len(g))))
            at = 0
            for c, (own, node) in zip(chunks, parts, strict=True):
                w = by_place[at : at + len(own)]
                more = w > 1
                if more.any():
                    out.append((c, 1, places(own[more], node[more], w[more])))
                at += len(own)
            for (c, own, _), n in zip(hot, hot_counts, strict=True):
                out.append((c, 0, blobs(own, numbers(by_place[at : at + len(n)]))))
                at += len(n)
        return pa.table({"chunk": pa.array([r[0] for r in out], pa.int64()), "kind": pa.array([r[1] for r in out], pa.int32()), "payload": pa.array([r[2] for r in out], pa.binary())})


def order_sets(table: pa.Table) -> pa.Table:
    """The nodes of a chunk that can have a link, with their shared shingles in order, rare first."""
    rows = list(zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True))
    keys, n = unblobs(next(p for k, p in rows if k == 3))
    n = from_numbers(n)
    hot = [unblobs(p) for k, p in rows if k == 0]
    hot_grams, hot_counts = (np.concatenate([np.frombuffer(g, np.uint64) for g, _ in hot]), np.concatenate([from_numbers(c) for _, c in hot])) if hot else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    by = np.argsort(hot_grams)

    def weighed(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, node, weight = from_places(payload)
        return g, node, weight if len(weight) == len(g) else hot_counts[by[np.searchsorted(hot_grams, g, sorter=by)]]

    parts = [weighed(p) for k, p in rows if k == 1]
    grams, node, weight = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    shared = np.bincount(node, minlength=len(n))
    can = shared >= needed(n)
    some = can[node]
    grams, node, weight = grams[some], node[some], weight[some]
    order = np.lexsort((grams, weight, node))
    grams = grams[order]
    ends = np.cumsum(np.where(can, shared, 0))
    who = np.flatnonzero(can)
    sets = [grams[ends[k] - shared[k] : ends[k]].tobytes() for k in who.tolist()]
    return pa.table({"node": pa.array([keys[16 * k : 16 * k + 16] for k in who.tolist()], pa.binary()), "n": pa.array(n[who], pa.int32()), "grams": pa.array(sets, pa.binary())})


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shared shingle in a node's prefix."""
    for b in batches:
        keys, grams = [], []
        for key, n, blob in zip(b.column("node").to_pylist(), b.column("n").to_pylist(), b.column("grams").to_pylist(), strict=True):
            g = np.frombuffer(blob, np.uint64)
            own = g[: max(0, n - needed(n) + 1 - (n - len(g)))]
            keys += [key] * len(own)
            grams.append(own)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(keys, pa.binary())], ["gram", "node"])


class Block:
    """The sets of a block: shingles as small numbers, set after set, and what the filters need."""

    def __init__(self, n: np.ndarray, sets: list[np.ndarray]):
        self.n = n.astype(np.int64)
        flat = np.concatenate(sets)
        self.size = np.array([len(s) for s in sets])
        self.at = np.cumsum(self.size) - self.size
        self.vocabulary, self.flat = np.unique(flat, return_inverse=True)
        # Position in the whole set: shingles of one node only come before the shared ones.
        self.place = (np.arange(len(flat)) - np.repeat(self.at, self.size) + np.repeat(self.n - self.size, self.size)).astype(np.int32)
        length = np.repeat(self.n - needed(self.n) + 1, self.size)
        self.in_prefix = self.place < length
        self.parts = np.zeros((len(sets), 16), np.int32)
        np.add.at(self.parts, (np.repeat(np.arange(len(sets)), self.size), (flat >> np.uint64(60)).astype(np.int64)), 1)
        self.where = np.full(len(self.vocabulary), BIG, np.int32)

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of others that x links with."""
        n, m = self.n[x], self.n[others]
        others = others[(5 * np.minimum(n, m) >= 4 * np.maximum(n, m))]  # length filter
        if not len(others):
            return others
        own = slice(self.at[x], self.at[x] + self.size[x])
        ids = self.flat[own]
        self.where[ids] = self.place[own]
        try:
            lengths = self.size[others]
            ends = np.cumsum(lengths)
            index = np.arange(ends[-1]) + np.repeat(self.at[others] - (ends - lengths), lengths)
            here = self.where[self.flat[index]]
            common = here < BIG
            both = common & self.in_prefix[index] & (here < n - needed(n) + 1)
            starts = ends - lengths
            i = np.minimum.reduceat(np.where(both, here, BIG), starts)  # prefix filter: the first shingle that both prefixes hold
            j = np.minimum.reduceat(np.where(both, self.place[index], BIG), starts)
            m = self.n[others]
            least = -(-4 * (n + m) // 9)
            good = (i < BIG) & (1 + np.minimum(n - i - 1, m - j - 1) >= least)  # positional filter
            good &= np.minimum(self.parts[x], self.parts[others]).sum(1) >= least  # suffix filter: by parts of the hash range
            good &= np.add.reduceat(common, starts, dtype=np.int64) >= least
        finally:
            self.where[ids] = BIG
        return others[good]


class Union:
    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()

    def join(self, x: int, found: np.ndarray) -> np.ndarray:
        """Connects x with found; those that were not connected yet, one for each component."""
        names, first = np.unique(self.label[found], return_index=True)
        new = names != self.label[x]
        self.label[np.isin(self.label, names)] = self.label[x]
        return found[first[new]]


def verify_block(table: pa.Table) -> pa.Table:
    """The links that connect a block of a canopy: its nodes with the pivot (the first row in order), then with each other."""
    table = table.sort_by([("is_pivot", "descending"), ("node", "ascending")])
    keys = table.column("node").to_pylist()
    block = Block(table.column("n").to_numpy(), [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()])
    union, a, b = Union(np.arange(len(keys))), [], []
    for x in range(len(keys)):
        rest = x + 1 + np.flatnonzero(union.label[x + 1 :] != union.label[x])  # earlier ones have tried x
        if not len(rest):
            continue
        for y in union.join(x, block.linked(x, rest)).tolist():
            a.append(keys[x])
            b.append(keys[y])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def verify_grid(table: pa.Table) -> pa.Table:
    """The links between nodes outside the pivot's component (left) and another block of the canopy (right)."""
    left = table.column("is_left").to_numpy(zero_copy_only=False)
    if left.all() or not left.any():
        return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    keys = table.column("node").to_pylist()
    names: dict[bytes, int] = {}
    labels = np.array([names.setdefault(r, len(names)) for r in table.column("root").to_pylist()])
    block = Block(table.column("n").to_numpy(), [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()])
    union, a, b = Union(labels), [], []
    right = np.flatnonzero(~left)
    for x in np.flatnonzero(left).tolist():
        rest = right[union.label[right] != union.label[x]]
        if len(rest):
            for y in union.join(x, block.linked(x, rest)).tolist():
                a.append(keys[x])
                b.append(keys[y])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def shared_sets(docs: DataFrame, buckets: int, hot: int) -> DataFrame:
    """node, n, grams of every node that can have a link."""
    dealt = map_batches(docs.select("text"), Deal(buckets, hot), "bucket int, kind int, chunk bigint, payload binary")
    counted = dealt.groupBy("bucket").applyInArrow(plain(Count()), "chunk bigint, kind int, payload binary")
    sets = counted.groupBy("chunk").applyInArrow(plain(order_sets), "node binary, n int, grams binary")
    return saved(sets.dropDuplicates(["node"]), "shared-sets")


def links(sets: DataFrame, block: int = 1024) -> DataFrame:
    """sets: shared_sets(). a, b: links that connect all nodes that are connected."""
    rows = map_batches(sets, prefixes, "gram bigint, node binary")
    pivots = rows.groupBy("gram").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    canopy = rows.join(pivots, "gram").where("node <> pivot").select("pivot", "node").distinct()
    canopy = saved(canopy.join(sets.select("node", F.expr("octet_length(grams) div 8").alias("shingles")), "node").select("pivot", "node", "shingles"), "canopies")
    blocks = canopy.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.sum("shingles").alias("all")).select("pivot", F.expr(f"cast(greatest(ceil(size / {block}), ceil(all / {BLOCK_SHINGLES})) as int)").alias("blocks"))
    members = canopy.join(blocks, "pivot").select("pivot", "node", "blocks", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("block"), F.lit(False).alias("is_pivot"))
    heads = blocks.select("pivot", F.col("pivot").alias("node"), "blocks", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(True).alias("is_pivot"))
    full = members.unionByName(heads).join(sets, "node")
    near = saved(full.groupBy("pivot", "block").applyInArrow(plain(verify_block), "a binary, b binary"), "near-links")
    wide = blocks.where("blocks > 1")
    if not wide.head(1):
        return near
    # Canopies of several blocks: what the pivot's component does not hold, against all other blocks.
    comp = components(near)
    part = canopy.join(wide, "pivot").select("pivot", "node", "shingles", "blocks", F.expr("cast(pmod(xxhash64(node), blocks) as int)").alias("block"))
    part = part.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lead = comp.select(F.col("node").alias("pivot"), F.col("root").alias("lead"))
    part = saved(part.join(lead, "pivot", "left").withColumn("out", F.col("root") != F.coalesce("lead", "pivot")), "wide-canopies")
    outside = part.where("out").groupBy("pivot").agg(F.count(F.lit(1)).alias("k"), F.sum("shingles").alias("all")).select("pivot", F.expr(f"cast(greatest(ceil(k / {block}), ceil(all / {BLOCK_SHINGLES})) as int)").alias("groups"))
    part = part.join(outside, "pivot")
    right = part.select("pivot", "node", "root", "block", F.explode(F.expr("sequence(0, groups - 1)")).alias("group"), F.lit(False).alias("is_left"))
    left = part.where("out").withColumn("own", F.col("block")).select("pivot", "node", "root", F.explode(F.expr("filter(sequence(0, blocks - 1), b -> b <> own)")).alias("block"), F.expr("cast(pmod(xxhash64(node, 1), groups) as int)").alias("group"), F.lit(True).alias("is_left"))
    grid = left.unionByName(right).join(sets, "node")
    far = grid.groupBy("pivot", "block", "group").applyInArrow(plain(verify_grid), "a binary, b binary")
    return near.unionByName(saved(far, "far-links"))


def jaccard_groups(docs: DataFrame, buckets: int | None = None, hot: int = 64, block: int = 1024) -> DataFrame:
    """docs: doc_id, text. One row each: row_hash, doc_id, n_shingles, node, component_id, copies (rows with an equal set), keep (of each component's rows, one)."""
    own = saved(map_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), Sets(["doc_id", "text_hash"]), "doc_id bigint, text_hash bigint, n_shingles bigint, node binary"), "sets")
    # Buckets grow with the data, not with the cluster: chunks send a row to each.
    buckets = buckets or max(12, int(own.agg(F.sum("n_shingles")).first()[0] or 0) // PER_BUCKET)
    comp = components(links(shared_sets(docs, buckets, hot), block))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("first")
    classes = own.where("node is not null").groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"))
    classes = classes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = classes.groupBy("root").agg(F.min("first").alias("first"))
    labels = saved(classes.select("node", "root", "copies").join(roots, "root").select("node", "copies", "first"), "labels")
    hot_size = max(1000, -(-own.count() // HOT_GROUPS))
    big = labels.where(F.col("copies") >= hot_size)  # at most HOT_GROUPS rows, as copies sum to the rows
    some = own.where("node is not null")
    out = some.join(F.broadcast(big), "node").unionByName(some.join(F.broadcast(big.select("node")), "node", "left_anti").join(labels.where(F.col("copies") < hot_size), "node"))
    out = out.select("doc_id", "text_hash", "n_shingles", "copies", F.col("first.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("keep"))
    none = own.where("node is null").select("doc_id", "text_hash", "n_shingles", F.lit(1).cast("bigint").alias("copies"), F.col("doc_id").alias("component_id"), F.lit(True).alias("keep"))
    return out.unionByName(none)


def verify_pairs(table: pa.Table) -> pa.Table:
    """Two blocks of a canopy against each other (or one against itself): of each node how many rows it links with here. A pair that a smaller canopy holds is counted there."""
    keys = table.column("node").to_pylist()
    side = table.column("side").to_numpy()
    pivot, copies = table.column("pivot")[0].as_py(), table.column("copies").to_numpy()
    block = Block(table.column("n").to_numpy(), [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()])
    lower = [[p for p in own if p < pivot] for own in table.column("pivots").to_pylist()]
    names = {p: k for k, p in enumerate(sorted({p for own in lower for p in own}))}
    of = np.repeat(np.arange(len(keys)), [len(own) for own in lower])
    which = np.array([names[p] for own in lower for p in own], np.int64)
    at = np.concatenate([[0], np.cumsum([len(own) for own in lower])])
    out, mark = np.zeros(len(keys), np.int64), np.zeros(len(names) + 1, bool)
    one = side.max() == side.min()
    right = np.flatnonzero(side == side.max())
    for x in np.flatnonzero(side == side.min()).tolist():
        rest = right[right > x] if one else right
        if at[x] < at[x + 1]:
            mark[which[at[x] : at[x + 1]]] = True
            elsewhere = np.bincount(of[mark[which]], minlength=len(keys)) > 0
            mark[which[at[x] : at[x + 1]]] = False
            rest = rest[~elsewhere[rest]]
        if len(rest):
            found = block.linked(x, rest)
            out[x] += copies[found].sum()
            out[found] += copies[x]
    some = np.flatnonzero(out)
    return pa.table({"node": pa.array([keys[k] for k in some.tolist()], pa.binary()), "links": pa.array(out[some], pa.int64())})


def link_counts(docs: DataFrame, buckets: int | None = None, hot: int = 64, block: int = 1024) -> DataFrame:
    """docs: doc_id, text. One row each: doc_id, n_shingles, n_links: other rows that it links with, copies included.

    All pairs of different sets that share a prefix shingle are verified, so a family of n unlike near copies takes n * n / 2 comparisons, dealt over blocks."""
    own = saved(map_batches(docs.select("doc_id", "text"), Sets(["doc_id"]), "doc_id bigint, n_shingles bigint, node binary"), "sets")
    buckets = buckets or max(12, int(own.agg(F.sum("n_shingles")).first()[0] or 0) // PER_BUCKET)
    copies = saved(own.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies")), "copies")
    sets = shared_sets(docs, buckets, hot)
    rows = map_batches(sets, prefixes, "gram bigint, node binary")
    pivots = rows.groupBy("gram").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    canopy = saved(rows.join(pivots, "gram").select("pivot", "node").distinct(), "canopies")
    lists = canopy.groupBy("node").agg(F.collect_list("pivot").alias("pivots"))  # at most as many as a prefix has shingles
    node = sets.join(lists, "node").join(copies, "node").withColumn("shingles", F.expr("octet_length(grams) div 8"))
    node = saved(node, "nodes")
    size = canopy.join(node.select("node", "shingles"), "node").groupBy("pivot").agg(F.count(F.lit(1)).alias("k"), F.sum("shingles").alias("all"))
    size = size.select("pivot", F.expr(f"cast(greatest(ceil(k / {block}), ceil(all / {BLOCK_SHINGLES})) as int)").alias("blocks"))
    part = canopy.join(size, "pivot").withColumn("side", F.expr("cast(pmod(xxhash64(node, 7), blocks) as int)"))
    cell = F.explode(F.expr("transform(sequence(0, blocks - 1), b -> struct(least(b, side) AS low, greatest(b, side) AS high))"))
    part = part.select("pivot", "node", "side", cell.alias("cell")).select("pivot", "node", "side", "cell.low", "cell.high")
    found = part.join(node, "node").groupBy("pivot", "low", "high").applyInArrow(plain(verify_pairs), "node binary, links bigint")
    links_ = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = saved(copies.join(links_, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "link-counts")
    out = own.where("node is not null").join(of, "node").select("doc_id", "n_shingles", "n_links")
    return out.unionByName(own.where("node is null").select("doc_id", "n_shingles", F.lit(0).cast("bigint").alias("n_links")))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; all columns kept."""
    keep_id, keep_hash = free_names(docs.columns, "keep_id", "keep_hash")
    keep = jaccard_groups(docs).where("keep").select(F.col("doc_id").alias(keep_id), F.col("text_hash").alias(keep_hash)).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep[keep_id]) & (F.xxhash64(docs["text"]) == keep[keep_hash]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "copies")
