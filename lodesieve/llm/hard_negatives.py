"""Hard-negative mining over a GNAT-style tree of multiway hyperplane splits.

Vectors are whole numbers and a score is an inner product. An anchor's positives are its best other rows of the same label; the
negatives of a positive are the best rows of other labels whose score lies in a window given by the positive's score.

1. The tree is fitted on at most ``SAMPLE`` rows, those with the least hash of their id. A node has up to ``FANOUT`` split points that are
   far from each other; a row goes to the nearest one's subtree. All rows of the table go down the tree, and make blocks of
   at most ``BLOCK`` rows of one leaf. Of all rows, too, come the ranges: for each split point and each sibling subtree the least and the largest
   distance to its rows, and each subtree's least and largest norm.
2. As d(q, x)^2 = |q|^2 + |x|^2 - 2 q.x, a window of scores is an annulus around the anchor. A subtree goes if
   for some split point p the distances that d(q, p) and p's range allow do not meet the annulus.
3. An anchor first searches the leaf that it would lie in itself. What it finds there narrows its windows from below to the
   last score that still counts; then the leaves that are left are searched, once for positives and once for negatives. A leaf is exact: all
   scores of its rows are computed, blocks of rows against packs of anchors, dealt by leaf and then both by salt.

The result is exact whatever the sample: recall is one.

Defined results. Rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter vectors count as
filled up with zeros. Repeated rows are rows of their own, but none with the anchor's id is its positive or negative; each anchor row gives its rows. Scores are exact: a
vector whose squared norm is 2^45 or more is an error. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blobs, both, map_batches, saved, unblobs

SAMPLE, FANOUT, LEAF_ROWS, DEPTH, BLOCK = 8192, 8, 1024, 4, 512
#: Anchors of a pack, and blocks and packs of a group.
PACK, BLOCKS, PACKS = 64, 8, 8
LIMIT = 1 << 45
WIDE = 1 << 60
FOUND = "anchor bigint, w int, other_id bigint, score bigint"


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column, filled up with zeros."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, column.value_lengths().to_numpy(zero_copy_only=False)))
    out = np.zeros((len(column), dims))
    size = np.diff(ends)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(ends[:-1], size)] = values
    if len(out) and (out * out).sum(1).max() >= LIMIT:
        raise ValueError("a vector's squared norm is 2^45 or more")
    return out


def squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, exact, of each row of x to each point."""
    return (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T)


class Tree:
    """points[n]: the split points of node n; child[n]: for each the node below, or -1 - leaf. Ranges are set once all rows are known."""

    def __init__(self, sample: np.ndarray, total: int, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT, depth: int = DEPTH):
        self.points: list[np.ndarray] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.share = total / max(1, len(sample))
        self.root = self.grown(sample, leaf_rows, fanout, depth)

    def grown(self, rows: np.ndarray, leaf_rows: int, fanout: int, depth: int) -> int:
        points = far_apart(rows, fanout) if depth and len(rows) * self.share > leaf_rows and len(rows) > 2 * fanout else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        n = len(self.points)
        self.points.append(points)
        self.child.append([])
        nearest = squares(rows, points).argmin(1)
        self.child[n] += [self.grown(rows[nearest == j], leaf_rows, fanout, depth - 1) for j in range(len(points))]
        return n

    def down(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, float, float]]]:
        """Each row's leaf, and the ranges of these rows: node, split point (-1: norms), subtree, least and largest square."""
        leaf, ranges, norm = np.zeros(len(x), np.int64), [], (x * x).sum(1)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            if n < 0:
                leaf[rows] = -1 - n
                continue
            d = squares(x[rows], self.points[n])
            nearest = d.argmin(1)
            for j, below in enumerate(self.child[n]):
                some = nearest == j
                if some.any():
                    own = d[some]
                    ranges += [(n, i, j, a, z) for i, (a, z) in enumerate(zip(own.min(0).tolist(), own.max(0).tolist(), strict=True))]
                    ranges.append((n, -1, j, float(norm[rows[some]].min()), float(norm[rows[some]].max())))
                    todo.append((below, rows[some]))
        return leaf, ranges

    def set_ranges(self, ranges: list[tuple[int, int, int, float, float]]) -> None:
        """Subtrees without rows get ranges that meet nothing."""
        self.near = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.far = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        self.norms = [np.array([[np.inf] * len(p), [-np.inf] * len(p)]) for p in self.points]
        for n, i, j, a, z in ranges:
            if i < 0:
                self.norms[n][:, j] = a, z
            else:
                self.near[n][i, j], self.far[n][i, j] = np.sqrt(a), np.sqrt(z)

    def alive(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and the rows of q that can have a score from low to high with some row there."""
        norm = (q * q).sum(1)
        todo = [(self.root, np.flatnonzero(low <= high))]
        while todo:
            n, rows = todo.pop()
            if not len(rows):
                continue
            if n < 0:
                yield -1 - n, rows
                continue
            d = np.sqrt(squares(q[rows], self.points[n]))
            for j, below in enumerate(self.child[n]):
                least, most = self.norms[n][:, j]
                if least > most:
                    continue
                near, far = self.near[n][:, j], self.far[n][:, j]
                at_least = np.maximum(near - d, d - far).max(1)  # what the split points say of d(q, x)
                at_most = (d + far).min(1)
                inner = np.sqrt(np.maximum(0, norm[rows] + least - 2 * high[rows]))
                outer2 = norm[rows] + most - 2 * low[rows]
                outer = np.sqrt(np.maximum(0, outer2))
                slack = 1e-6 + 1e-9 * (at_most + outer)
                todo.append((below, rows[(outer2 >= 0) & (at_least <= outer + slack) & (at_most >= inner - slack)]))


def far_apart(rows: np.ndarray, k: int) -> np.ndarray:
    """Up to k different rows, each far from those before."""
    if not len(rows):
        return rows
    chosen = [0]
    least = squares(rows, rows[:1])[:, 0]
    while len(chosen) < k and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squares(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


class Assign:
    """Rows with their leaf."""

    def __init__(self, tree: Tree, dims: int):
        self.tree, self.dims = tree, dims

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf, _ = self.tree.down(matrix(b.column("v"), self.dims))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *b.columns], ["leaf", *b.schema.names])


class Blocks:
    """Sorted rows as blocks of a leaf, with the ranges of each."""

    def __init__(self, tree: Tree, dims: int):
        self.tree, self.dims = tree, dims

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            leaf, x = b.column("leaf").to_numpy(), matrix(b.column("v"), self.dims)
            ids, label = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])).tolist()
            for a, z in zip(cuts, [*cuts[1:], len(leaf)], strict=True):
                for s in range(a, z, BLOCK):
                    part = slice(s, min(z, s + BLOCK))
                    _, ranges = self.tree.down(x[part])
                    payload = blobs(ids[part].tobytes(), label[part].tobytes(), x[part].astype(np.int32).tobytes())
                    names = ["node", "point", "subtree", "least", "largest"]
                    kind = pa.list_(pa.struct([("node", pa.int32()), ("point", pa.int32()), ("subtree", pa.int32()), ("least", pa.float64()), ("largest", pa.float64())]))
                    yield pa.RecordBatch.from_arrays([pa.array([leaf[a]], pa.int32()), pa.array([payload], pa.binary()), pa.array([[dict(zip(names, r, strict=True)) for r in ranges]], kind)], ["leaf", "payload", "ranges"])


class Visit:
    """Packs of anchors for the leaves that they search. home: the leaf that an anchor would lie in; else all others that can hold rows in its windows.

    Comes in: anchor, vec_id, label, v, low, high (a list of windows)."""

    def __init__(self, tree: Tree, dims: int, home: bool):
        self.tree, self.dims, self.home = tree, dims, home

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, PACK):
                b = whole.slice(s, PACK)
                q = matrix(b.column("v"), self.dims)
                name, ids, label = (b.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
                low, high = (pad(b.column(c), fill) for c, fill in (("low", WIDE), ("high", -WIDE)))
                own, _ = self.tree.down(q)
                some = (low <= high).any(1)
                if self.home:
                    visits = [(k, np.flatnonzero((own == k) & some)) for k in np.unique(own[some]).tolist()]
                else:
                    open_ = low <= high
                    least, most = np.where(open_, low, WIDE).min(1), np.where(open_, high, -WIDE).max(1)
                    visits = [(k, rows[own[rows] != k]) for k, rows in self.tree.alive(q, least.astype(float), most.astype(float))]
                visits = [(k, rows) for k, rows in visits if len(rows)]
                payload = [blobs(*(x[rows].tobytes() for x in (name, ids, label, q.astype(np.int32), low, high))) for _, rows in visits]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in visits], pa.int32()), pa.array(payload, pa.binary())], ["leaf", "payload"])


def pad(column: pa.Array, fill: int) -> np.ndarray:
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(size), int(size.max(initial=1))), fill, np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Search:
    """Packs of anchors against blocks of a leaf: of each window the k best rows of the anchor's label (same) or of others."""

    def __init__(self, same: bool, k: int, dims: int):
        self.same, self.k, self.dims = same, k, dims

    def __call__(self, packs: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        parts = [unblobs(p) for p in blocks.column("payload").to_pylist()]
        if parts:
            ids, label = (np.concatenate([np.frombuffer(p[k], np.int64) for p in parts]) for k in (0, 1))
            x = np.concatenate([np.frombuffer(p[2], np.int32) for p in parts]).reshape(-1, self.dims).astype(float)
            for p in packs.column("payload").to_pylist():
                name, own, own_label, q, low, high = unblobs(p)
                name, own, own_label, low, high = (np.frombuffer(y, np.int64) for y in (name, own, own_label, low, high))
                scores = (np.frombuffer(q, np.int32).reshape(-1, self.dims).astype(float) @ x.T).astype(np.int64)
                low, high = low.reshape(len(name), -1), high.reshape(len(name), -1)
                can = ((label[None, :] == own_label[:, None]) == self.same) & (ids[None, :] != own[:, None])
                for r in range(len(name)):
                    some = np.flatnonzero(can[r] & (scores[r] >= low[r].min()))
                    some = some[np.lexsort((ids[some], -scores[r, some]))]
                    s = scores[r, some]
                    for w in np.flatnonzero(low[r] <= high[r]).tolist():
                        at = int(np.searchsorted(-s, -high[r, w]))
                        to = min(at + self.k, int(np.searchsorted(-s, -low[r, w], side="right")))
                        if at < to:
                            out.append((name[r], w, ids[some[at:to]], s[at:to]))
        sizes = [len(o[2]) for o in out]
        return pa.table({
            "anchor": pa.array(np.repeat(np.array([o[0] for o in out], np.int64), sizes)), "w": pa.array(np.repeat(np.array([o[1] for o in out], np.int32), sizes)),
            "other_id": np.concatenate([o[2] for o in out] or [np.zeros(0, np.int64)]), "score": np.concatenate([o[3] for o in out] or [np.zeros(0, np.int64)]),
        })


class Index:
    """All rows, in blocks by leaf. rows: vec_id, label, v."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS):
        total, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        self.dims = max(1, dims or 0)
        # The tree is fitted on a bounded sample; all rows are indexed.
        some = rows.select("v", F.xxhash64("vec_id", F.lit(13)).alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample)
        self.tree = Tree(matrix(pa.array([r["v"] for r in some.collect()], pa.list_(pa.int64())), self.dims), total, leaf_rows)
        with_leaf = map_batches(rows, Assign(self.tree, self.dims), "leaf int, vec_id bigint, label bigint, v array<bigint>")
        dealt = with_leaf.repartitionByRange("leaf", "vec_id").sortWithinPartitions("leaf", "vec_id")
        kind = "leaf int, payload binary, ranges array<struct<node int, point int, subtree int, least double, largest double>>"
        self.blocks = saved(map_batches(dealt, Blocks(self.tree, self.dims), kind), "leaf-blocks")
        ranges = self.blocks.select(F.explode("ranges").alias("r")).groupBy("r.node", "r.point", "r.subtree").agg(F.min("r.least"), F.max("r.largest"))
        self.tree.set_ranges([tuple(r) for r in ranges.collect()])  # as many as the tree has, whatever the rows
        count = self.blocks.groupBy("leaf").agg(F.count(F.lit(1)).alias("k"))  # at most one row for each leaf
        self.salts = saved(count.select("leaf", F.expr(f"cast(ceil(k / {BLOCKS}) as int)").alias("salts")), "leaf-salts")

    def search(self, anchors: DataFrame, home: bool, same: bool, k: int) -> DataFrame:
        """anchors: anchor, vec_id, label, v, low, high. FOUND: of each window and group of blocks the k best rows."""
        packs = saved(map_batches(anchors.select("anchor", "vec_id", "label", "v", "low", "high"), Visit(self.tree, self.dims, home), "leaf int, payload binary"), "anchor-packs")
        wide = packs.groupBy("leaf").agg(F.expr(f"cast(ceil(count(1) / {PACKS}) as int)").alias("wide"))
        cells = F.broadcast(self.salts.join(wide, "leaf"))
        row = F.monotonically_increasing_id()
        left = packs.withColumn("row", row).join(cells, "leaf").select("leaf", F.expr("cast(pmod(xxhash64(row), wide) as int)").alias("y"), F.explode(F.expr("sequence(0, salts - 1)")).alias("x"), "payload")
        right = self.blocks.select("leaf", "payload").withColumn("row", row).join(cells, "leaf").select("leaf", F.expr("cast(pmod(xxhash64(row), salts) as int)").alias("x"), F.explode(F.expr("sequence(0, wide - 1)")).alias("y"), "payload")
        return saved(left.groupBy("leaf", "x", "y").cogroup(right.groupBy("leaf", "x", "y")).applyInArrow(both(Search(same, k, self.dims)), FOUND), "found")

    def best(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """Of each anchor's windows the k best rows: anchor, w, rank, other_id, score."""
        near = self.search(anchors, True, same, k)
        top = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "other_id")
        # Where k rows are known, what has a lower score than the last of them does not count.
        last = near.withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k).select("anchor", F.struct("w", "score").alias("s")).groupBy("anchor").agg(F.map_from_entries(F.collect_list("s")).alias("last"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("last", i.cast("int")), x)))
        narrowed = anchors.join(last, "anchor", "left").withColumn("low", F.when(F.col("last").isNull(), F.col("low")).otherwise(raised))
        both_ = near.unionByName(self.search(narrowed, False, same, k))
        return both_.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """rows: vec_id, label, v (whole numbers). anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor's
    positives the negatives with low * positive_score <= 100 * negative_score <= high * positive_score."""
    rows = saved(rows.select("vec_id", F.col("label").cast("bigint").alias("label"), "v"), "vectors")
    index = Index(rows, sample, leaf_rows)
    anchors = saved(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    wide = anchors.withColumn("low", F.array(F.lit(-WIDE))).withColumn("high", F.array(F.lit(WIDE)))
    found = saved(index.best(wide, True, positives), "positives")
    pair = F.struct("rank", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))  # at most as many as there are positives
    floor = lambda x: x - F.pmod(x, F.lit(100))
    hundredth = lambda x: (floor(x) / 100).cast("bigint")  # noqa: E731  exact below 2^53, and scores are below 2^45
    lows = F.transform("pairs", lambda p: hundredth(p["positive_score"] * low + 99))
    highs = F.transform("pairs", lambda p: hundredth(p["positive_score"] * high))
    narrow = anchors.join(windows, "anchor").withColumn("low", lows).withColumn("high", highs)
    mined = index.best(narrow.drop("pairs"), False, negatives)
    of = found.select("anchor", (F.col("rank") - 1).alias("w"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = mined.join(of, ["anchor", "w"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """embeddings: vec_id, embedding, label. Rows that take part, with v: floor(256 x) of each component."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return good.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""
