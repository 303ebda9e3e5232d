"""SimHash near-dedup by fuzzy keys of the Golay code.

A fingerprint has a bit for each of 64: whether over half of the text's shingle hashes have it. Two
fingerprints link when at most three bits differ. Links are found by keys, not by pairs:

1. Different fingerprints are the nodes; copies are one from the start.
2. A fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of the binary Golay code [23, 12, 7],
   filled up with zeros. The code is perfect: every word has one codeword within three bits, and so an index of 12 bits.
   A segment's *own* index is that of the word itself; its *near* indices, six at most, are those of all words within one bit of
   it. If a segment differs in one bit at most, one's own index is among the other's near ones.
3. Pigeonhole: three errors over three segments leave (a) one segment without error and another with one at most, or
   (b) one error in each. For (a) there is a key for each ordered pair of segments, the one's bits and the other's index:
   6 own keys of 33 bits and more. For (b) an error lies in one half of a segment, so the key is the first segment's
   index and a half of each of the others: 4 own keys. Near indices make that 60 keys at most.
4. Keys are sorted by ranges, and those that one fingerprint alone has go there; the others are joined and verified by counting bits. Keys of many fingerprints are
   cut into blocks, and pairs of blocks are verified apart. Within one, what is connected already is not tried again, so a family
   gives about as many links as it has members, not as many as it has pairs.
5. The components of these links are those of all links.

Defined results. Null text counts as empty; a text without words has fingerprint zero, linked like any other. Component ids are the
smallest doc_id of the component, nulls last. Repeated rows are copies. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, map_batches, saved, slices, text_buffer, with_labels
from .components import components
from .words import LOWER, word_bounds

WIDTH, SEED, NEAR = 3, 42, 3
#: Bits of the segments, lowest first, and where each begins.
BITS, AT = (22, 21, 21), (0, 22, 43)
#: Shingles whose bits are counted at once.
COUNT = 1 << 14
#: Runs of at most so many fingerprints are tried pair by pair.
SHORT = 24
KEYS = "key bigint, fp bigint, own boolean"


def golay() -> np.ndarray:
    """For each word of 23 bits the index of its codeword: the upper 12 bits of the word without its error."""
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 divides x^23 - 1

    def remainder(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for k in range(22, 10, -1):
            v ^= np.where(v >> k & 1, generator << (k - 11), 0)
        return v

    one = 1 << np.arange(23, dtype=np.int64)
    pairs = one[:, None] | one[None, :]
    triples = pairs[:, :, None] | one[None, None, :]
    errors = np.unique(np.concatenate([[0], triples.ravel()]))  # all of at most three bits: 2,048, one for each remainder
    error_of = np.zeros(1 << 11, np.int64)
    error_of[remainder(errors)] = errors
    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    words = np.arange(1 << 23, dtype=np.int64)
    return ((words ^ error_of[low[words & 4095] ^ high[words >> 12]]) >> 11).astype(np.uint16)


_index: list[np.ndarray] = []


def index() -> np.ndarray:
    if not _index:
        _index.append(golay())
    return _index[0]


def near_indices(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Six columns: the indices of all words within a bit of each segment, the own one first; and whether a column holds a new one."""
    code = index()
    own = code[segment]
    around = np.sort(code[segment[:, None] ^ (1 << np.arange(bits))[None, :]], axis=1)
    new = around != own[:, None]
    new[:, 1:] &= around[:, 1:] != around[:, :-1]
    place = np.cumsum(new, axis=1)
    out, full = np.zeros((len(segment), 6), np.uint64), np.zeros((len(segment), 6), bool)
    out[:, 0], full[:, 0] = own, True
    r, c = np.nonzero(new)
    out[r, place[r, c]], full[r, place[r, c]] = around[r, c], True
    return out, full


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, the fingerprint that each is of (a number), and whether it is an own key."""
    fp = fp.view(np.uint64)
    segment = [(fp >> np.uint64(a) & np.uint64((1 << b) - 1)).astype(np.int64) for a, b in zip(AT, BITS, strict=True)]
    near = [near_indices(s, b) for s, b in zip(segment, BITS, strict=True)]
    keys, of, own = [], [], []

    def add(kind: int, exact: np.ndarray, j: int) -> None:
        codes, full = near[j]
        head = np.uint64(kind) << np.uint64(60) | exact.astype(np.uint64) << np.uint64(12)
        r, c = np.nonzero(full)
        keys.append(head[r] | codes[r, c])
        of.append(r)
        own.append(c == 0)

    for k, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        add(k, segment[i], j)
    for k in range(4):
        halves = [(s >> 11 if k >> n & 1 else s & 2047) for n, s in enumerate(segment[1:])]
        add(6 + k, halves[0] << 11 | halves[1], 0)
    return np.concatenate(keys).view(np.int64), np.concatenate(of), np.concatenate(own)


def fingerprints(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each text."""
    import xxhash

    h = xxhash.xxh64_intdigest
    starts, ends, text = word_bounds(raw, at)
    out = np.zeros(len(at) - 1, np.uint64)
    if not len(starts):
        return out
    # Words with a blank after each: a shingle is a stretch of this.
    size = ends - starts
    to = np.cumsum(size + 1) - (size + 1)
    flat = np.full(int(to[-1] + size[-1] + 1), 32, np.uint8)
    spots = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    flat[np.repeat(to - starts, size) + spots] = LOWER[raw[spots]]
    octets = flat.tobytes()
    first = np.searchsorted(text, np.arange(len(at)))
    past = (to + size).tolist()
    begin = to.tolist()
    for k in np.flatnonzero(np.diff(first)).tolist():
        a, z = int(first[k]), int(first[k + 1])
        width = min(WIDTH, z - a)
        n = z - a - width + 1
        set_bits = np.zeros(64, np.int64)
        for s in range(a, a + n, COUNT):
            e = min(a + n, s + COUNT)
            hashes = np.array([h(octets[x:y], SEED) for x, y in zip(begin[s:e], past[s + width - 1 : e + width - 1], strict=True)], "<u8")
            set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0]
    return out


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(*text_buffer(b.column("text"))).view(np.int64))], ["doc_id", "fp"])


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            fp = b.column("fp").to_numpy()
            keys, of, own = keys_of(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[of]), pa.array(own)], ["key", "fp", "own"])


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows those whose key another row has too. A partition's first and last key may go on in its neighbours; they stay."""
    held, first = None, None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.RecordBatch.from_arrays([pa.concat_arrays([h, c]) for h, c in zip(held[0].columns, b.columns, strict=True)], b.schema.names)
        key = b.column("key").to_numpy()
        first = key[0] if first is None else first
        keep = key == first
        same = key[1:] == key[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        if held is not None:
            keep[0] |= held[1]
        held = b.slice(b.num_rows - 1), keep[-1]  # whether the last one stays is known by the next batch
        yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
    if held is not None:
        yield held[0]


class Verify:
    """Verifies the runs of rows with one key and pair of blocks; rows come sorted. side: the block that a row is of."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "low", "high", "side", "fp", "own")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = np.logical_and.reduce([x[:-1] == x[-1] for x in now[:3]])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0  # the last run may go on
            held = [x[cut:] for x in now]
            if cut:
                yield self.links([x[:cut] for x in now])
        if held is not None:
            yield self.links(held)

    def links(self, rows: list[np.ndarray]) -> pa.RecordBatch:
        key, low, high, side, fp, own = rows
        fp = fp.view(np.uint64)  # of negative numbers bitwise_count() counts the bits of the absolute value
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        run, sizes = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(key)))
        short = (sizes <= SHORT)[run]
        found = []
        for d in range(1, int(min(SHORT, sizes.max()))):
            x = np.flatnonzero((run[d:] == run[:-d]) & short[d:])
            y = x + d
            good = (own[x] | own[y]) & (np.bitwise_count(fp[x] ^ fp[y]) <= NEAR) & ((side[x] != side[y]) | (low[x] == high[x]))
            found.append((fp[x[good]], fp[y[good]]))
        at = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes > SHORT).tolist():
            part = slice(int(at[k]), int(at[k] + sizes[k]))
            found.append(spanning(fp[part], own[part], side[part], bool(low[at[k]] == high[at[k]])))
        a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def spanning(fp: np.ndarray, own: np.ndarray, side: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that links of this run connect: within one block, or from one block to another."""
    label, a, b = np.arange(len(fp)), [], []
    for x in range(len(fp) - 1):
        rest = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
        if not one:
            rest = rest[side[rest] != side[x]]
        rest = rest[np.bitwise_count(fp[rest] ^ fp[x]) <= NEAR]
        if not own[x]:
            rest = rest[own[rest]]
        if len(rest):
            names, first = np.unique(label[rest], return_index=True)
            label[np.isin(label, names)] = label[x]
            a += [fp[x]] * len(names)
            b += fp[rest[first]].tolist()
    return np.array(a, np.uint64), np.array(b, np.uint64)


def links(nodes: DataFrame, block: int = 2048) -> DataFrame:
    """nodes: fp, different ones. a, b: links that connect all nodes that are connected."""
    keys = map_batches(nodes, key_rows, KEYS).repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    keys = saved(map_batches(keys, shared_rows, KEYS), "simhash-keys")
    # A link needs an own key of the one among the other's.
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("own").alias("own")).where("k > 1 AND own").select("key", F.expr(f"cast(ceil(k / {block}) as int)").alias("blocks"))
    rows = saved(keys.join(shared, "key"), "simhash-shared")
    plain = rows.where("blocks = 1").select("key", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("side"), "fp", "own")
    side = rows.where("blocks > 1").withColumn("side", F.expr("cast(pmod(xxhash64(fp), blocks) as int)"))
    pair = F.explode(F.expr("transform(sequence(0, blocks - 1), b -> struct(least(b, side) AS low, greatest(b, side) AS high))"))
    wide = side.select("key", "side", "fp", "own", pair.alias("pair")).select("key", "pair.low", "pair.high", "side", "fp", "own")
    dealt = plain.unionByName(wide).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "fp")
    out = saved(map_batches(dealt, Verify(), "a bigint, b bigint").distinct(), "simhash-links")
    drop(keys, rows)
    return out


def simhash_groups(docs: DataFrame, block: int = 2048) -> DataFrame:
    """docs: doc_id, text. One row each: doc_id, fp, fingerprint (16 hex digits), copies (rows with an equal one), component_id."""
    own = saved(map_batches(docs.select("doc_id", "text"), fingerprint_rows, "doc_id bigint, fp bigint"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id")).alias("first")
    nodes = saved(own.groupBy("fp").agg(first, F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    comp = components(links(nodes.select("fp"), block))
    nodes = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = nodes.groupBy("root").agg(F.min("first").alias("least"))
    labels = saved(nodes.select("fp", "root", "copies").join(roots, "root").select("fp", "copies", F.col("least.doc_id").alias("component_id")), "simhash-labels")
    return with_labels(own, labels, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "copies", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id", "copies")
