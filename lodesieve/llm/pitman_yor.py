"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Each word is a context with a restaurant of its own, whose customers are the words that follow it
in the training documents; all of these share one parent, the restaurant of single words, whose
base is uniform over the known words and one unknown. The tables of the contexts are the customers of the parent.

Seating is sampled by Gibbs at both levels. In a sweep all customers of one word in one restaurant stand
up and are seated again, given the others' tables and the parent's probability of the word as the parent's
seating of the sweep before gives it; then the parent is seated anew, given the contexts' tables. Of a word with
at most ``CUT`` customers the number of tables is drawn from its exact distribution (by generalised Stirling
numbers); those of a more frequent word are seated one after another, with Metropolis steps that make up for
what that order favours, and where its tables are many as well, their number is drawn from the normal distribution that these numbers tend to. Dishes of a restaurant are sampled side by side, given
its tables of the sweep before. The start is one table for each word of a context. After ``burn`` sweeps the
predictive probabilities of ``samples`` sweeps are averaged.

The contexts' concentration is sampled once a sweep (by auxiliary variables, prior Gamma(1, 1)); the discounts are
those that counts of one and two give, n1 / (n1 + 2 n2), of pairs, and of the contexts of a word.

How it runs. Documents become chunks: rows with a dictionary of word hashes, the chunk's different pairs, and the sequence
of their numbers, written once and bucketed by chunk. Words are counted, and numbered in the order of their hashes, where their ranges meet. Each chunk sends its pairs to the bucket that holds the context; a
bucket adds up all chunks' counts and keeps its pairs, written once and bucketed likewise. It names its words' numbers to the parent's buckets
once; in a sweep it sends these the tables of its words, and they send customers and tables of each word back, all in that order. At
the end it sends each chunk the probabilities of its pairs, in the order asked. So nothing is held by the driver but
totals, a hot word is one entry of each chunk, and what is shuffled grows with the input alone.

The followers of a context with more than ``split`` customers are dealt over several buckets, by ranges of their hashes. Its parts'
tables are added up with the parent's customers, and each part gets the exact sum of the sweep before: the
model is the same wherever a restaurant is cut.

Defined results. A-Z count as a-z; null text counts as empty: one token, the end. A null id counts as the
empty text in the fold. Repeated rows count as often as they stand. Without training documents all
words are unknown. An empty table gives an empty result; other columns are not read. Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, both, bucket_of, documents, fold, from_numbers, map_batches, new_path, numbers, plain, saved, slices, text_buffer, unblobs
from .words import mixed, word_hash, words

#: Tokens of a chunk, at least, but for a task's last.
CHUNK = 1_500_000
#: Training and other tokens for each bucket of pairs, and for each bucket of words; known words for each bucket of the parent.
PER_BUCKET, PER_WORDS, PER_PARENT = 1_500_000, 1_500_000, 1_000_000
#: Up to so many customers of a word, its tables are drawn from their exact distribution.
CUT = 100
#: From so many likely tables on, a more frequent word's number of tables is drawn from the normal distribution about it.
MANY = 25
END = np.uint64(word_hash("<end of text>"))
#: target, source: numbers of chunks or buckets; sums: what the driver adds up.
MESSAGE = "target bigint, kind int, source bigint, payload binary, sums array<double>"
MESSAGE_TYPES = {"target": pa.int64(), "kind": pa.int32(), "source": pa.int64(), "payload": pa.binary(), "sums": pa.list_(pa.float64())}
WORDS, STATE, PLACES, NAMES, TABLES, PARENT, PROBABILITIES = range(7)
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
SCORE_TYPES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def messages(rows: list[dict]) -> pa.Table:
    return pa.table({c: pa.array([r.get(c) for r in rows], t) for c, t in MESSAGE_TYPES.items()})


def of_kind(table: pa.Table, kind: int) -> tuple[list[int], list[bytes]]:
    """Sources and payloads of the messages of a kind, in the order of their sources."""
    rows = np.flatnonzero(table.column("kind").to_numpy() == kind)
    source = table.column("source").to_numpy()[rows]
    order = np.argsort(source)
    return source[order].tolist(), [table.column("payload")[k].as_py() for k in rows[order].tolist()]


# Chunks -------------------------------------------------------------------------------------

class Chunks:
    """Documents as chunks. A chunk's tokens are the words of its documents, each with an end after it."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 24, 0
        ids, held, hashes, sizes, total = [], [], [], [], 0
        for whole in batches:
            for b in slices(whole, "text"):
                h, text = words(*text_buffer(b.column("text")))
                n = np.bincount(text, minlength=b.num_rows)
                at = np.arange(len(h)) + text
                tokens = np.full(len(h) + b.num_rows, END, np.uint64)
                tokens[at] = h
                ids += b.column("doc_id").to_pylist()
                held.append(b.column("held_out").to_numpy(zero_copy_only=False))
                hashes.append(tokens)
                sizes.append(n + 1)
                total += len(tokens)
                if total >= CHUNK:
                    yield self.row(base + count, ids, held, hashes, sizes)
                    count, ids, held, hashes, sizes, total = count + 1, [], [], [], [], 0
        if ids:
            yield self.row(base + count, ids, held, hashes, sizes)

    def row(self, chunk: int, ids: list, held: list, hashes: list, sizes: list) -> pa.RecordBatch:
        names, tokens = np.unique(np.append(np.concatenate(hashes), END), return_inverse=True)
        tokens = tokens[:-1]
        held, sizes = np.concatenate(held), np.concatenate(sizes)
        end = int(np.searchsorted(names, END))
        context = np.concatenate([[end], tokens[:-1]])  # a text begins after an end
        pair, of = np.unique(context * len(names) + tokens, return_inverse=True)
        context, word = pair // len(names), pair % len(names)
        trains = np.repeat(~held, sizes)
        count = np.bincount(of[trains], minlength=len(pair))
        known = np.bincount(word, count, len(names)).astype(np.int64)
        columns = (
            blobs(names.tobytes(), numbers(known)), blobs(numbers(np.bincount(context, minlength=len(names))), numbers(word), numbers(count)),
            blobs(np.array([d or 0 for d in ids], np.int64).tobytes(), np.array([d is not None for d in ids], np.uint8).tobytes(), held.astype(np.uint8).tobytes(), numbers(sizes), numbers(of)),
        )
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([c], pa.binary()) for c in columns), pa.array([len(of)], pa.int64())], ["chunk", "words", "pairs", "docs", "n_tokens"])


@dataclass
class Segments:
    """The pairs of a chunk by the part of a context's restaurant that they belong to, in the order of requests.

    name, size, context, part, parts: of the segments; index: the pair at each place of the requests; cuts: where the segments of each bucket begin."""

    name: np.ndarray
    size: np.ndarray
    context: np.ndarray
    part: np.ndarray
    parts: np.ndarray
    index: np.ndarray
    cuts: np.ndarray


def segments(names: np.ndarray, follow: np.ndarray, word: np.ndarray, known: np.ndarray, split: int, buckets: int) -> Segments:
    """known: the training counts of the chunk's words; a word has as many customers as a context as it has places."""
    context = np.repeat(np.arange(len(names)), follow)
    parts = 1 + known // split
    # Words are sorted by hash, so the high 32 bits ascend within a context, and parts are stretches.
    part = (names[word] >> np.uint64(32)).astype(np.int64) * parts[context] >> 32
    new = np.concatenate([[True], (context[1:] != context[:-1]) | (part[1:] != part[:-1])])
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(context)))
    name = names[context[heads]]
    name = np.where(part[heads] > 0, mixed(name + part[heads].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), name)
    bucket = bucket_of(name, buckets)
    order = np.argsort(bucket, kind="stable")
    past = np.cumsum(size[order])
    index = np.repeat(heads[order] - (past - size[order]), size[order]) + np.arange(len(context))
    own = context[heads][order]
    return Segments(name[order], size[order], own, part[heads][order], parts[own], index, np.searchsorted(bucket[order], np.arange(buckets + 1)))


# Seating ------------------------------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after a shift by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - shift


def seat(count: np.ndarray, weight: np.ndarray, slope: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Proposes seatings of many dishes, customer after customer. By the Chinese-restaurant rule a new table weighs weight + slope * tables of
    the dish, and its tables together weigh customers - discount * tables. The tables of each dish, and the logarithm of the
    seating's weight by that rule over its probability here.

    The waits for the next new table are drawn. A table that stands early takes from the weight of all later customers, so of the nth of c customers
    a new table is drawn with its weight times (n / c) ** discount: then all seatings have about the same quotient.
    """
    tables, log_w = np.ones(len(count), np.int64), np.zeros(len(count))
    live = np.flatnonzero(count > 1)
    c, w, s = count[live].astype(float), weight[live], slope[live]
    n, t, total = np.ones(len(live)), np.ones(len(live), np.int64), np.zeros(len(live))
    while len(live):
        new = w + s * t
        rate, before = new / (discount * c**discount), n**discount
        wait = np.floor(np.minimum(before + rng.exponential(size=len(live)) / rate, (2 * c) ** discount) ** (1 / discount))
        last = np.clip(wait, n, c)
        opens = last < c
        log_q = -rate * (last**discount - before)
        log_q[opens] += np.log(-np.expm1(-(rate * ((last + 1) ** discount - last**discount))[opens]))
        total += log_gamma(last - discount * t) - log_gamma(n - discount * t) - log_q
        total[opens] += np.log(new[opens])
        n, t = last + opens, t + opens
        done = n >= c
        if done.any():
            tables[live[done]], log_w[live[done]] = t[done], total[done]
            go = ~done
            live, c, w, s, n, t, total = live[go], c[go], w[go], s[go], n[go], t[go], total[go]
    return tables, log_w


def stirling_ratios(discount: float, top: int = CUT) -> np.ndarray:
    """[c, t]: S(c, t + 1) / S(c, t) of the generalised Stirling numbers, S(c + 1, t) = S(c, t - 1) + (c - discount * t) S(c, t)."""
    out = np.zeros((top + 1, top + 1))
    row = np.full(top + 2, -np.inf)
    row[1] = 0.0
    for c in range(1, top + 1):
        if c > 1:
            up = np.full(top + 2, -np.inf)
            t = np.arange(1, c + 1)
            with np.errstate(divide="ignore"):
                up[t] = np.logaddexp(row[t - 1], np.log(np.maximum(c - 1 - discount * t, 0)) + row[t])
            row = up
        out[c, 1:c] = np.exp(row[2 : c + 1] - row[1:c])
    return out


def likely_tables(count: np.ndarray, weight: np.ndarray, slope: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the tables of a frequent word with many of them.

    S(c, t) is c! / (t! discount^t) times the coefficient of x^c in (1 - (1 - x)^discount)^t. At the coefficient's saddle point x = 1 - y,
    S(c, t + 1) / S(c, t) is (1 - y^discount) / ((t + 1) discount) up to one part in t; the numbers are most likely where this times a new table's weight is 1.
    """
    d = discount
    t_of = lambda y: count * (1 - y**d) * y ** (1 - d) / (d * -np.expm1(np.log(y)))
    ratio = lambda y, t: np.log((1 - y**d) / ((t + 0.5) * d)) + np.log(weight + slope * t)
    low, high = np.full(len(count), -690.0), np.full(len(count), -1e-9)
    for _ in range(60):
        mid = (low + high) / 2
        y = np.exp(mid)
        more = ratio(y, t_of(y)) > 0
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    y, y2 = np.exp(low), np.exp(low) * (1 - 1e-4)
    t, t2 = t_of(y), t_of(y2)
    bend = (ratio(y2, t2) - ratio(y, t)) / (t2 - t)
    return t, np.sqrt(1 / np.maximum(-bend, 1 / count.astype(float) ** 2))


def draw_tables(count: np.ndarray, weight: np.ndarray, slope: np.ndarray, discount: float, ratios: np.ndarray, rng: np.random.Generator, steps: int = 4) -> np.ndarray:
    """The tables of dishes with these customers, given all else (weight and slope as in seat()); no table without a customer."""
    tables = np.minimum(count, 1)
    some = np.flatnonzero((count > 1) & (count <= CUT))
    if len(some):
        some = some[np.argsort(-count[some], kind="stable")]
        c, w, s = count[some], weight[some], slope[some]
        t, mass, total = np.ones(len(some), np.int64), np.ones(len(some)), np.ones(len(some))
        live = np.searchsorted(-c, -np.arange(c[0] + 1), side="left")  # of t: dishes with more customers
        for k in range(1, int(c[0])):
            n = int(live[k])
            mass[:n] *= ratios[c[:n], k] * (w[:n] + k * s[:n])
            total[:n] += mass[:n]
            t[:n][rng.random(n) * total[:n] < mass[:n]] = k + 1
        tables[some] = t
    big = np.flatnonzero(count > CUT)
    if len(big):
        mean, deviation = likely_tables(count[big], weight[big], slope[big], discount)
        many = mean >= MANY
        drawn = np.round(mean[many] + deviation[many] * rng.standard_normal(int(many.sum())))
        tables[big[many]] = np.clip(drawn, 1, count[big[many]]).astype(np.int64)
        big = big[~many]
    if len(big):
        got, log_w = seat(count[big], weight[big], slope[big], discount, rng)
        for _ in range(steps):
            new, new_w = seat(count[big], weight[big], slope[big], discount, rng)
            take = np.log(rng.random(len(big))) < new_w - log_w
            got, log_w = np.where(take, new, got), np.where(take, new_w, log_w)
        tables[big] = got
    return tables


def auxiliary(customers: np.ndarray, tables: np.ndarray, strength: float, discount: float, rng: np.random.Generator, block: int = 1 << 20) -> list[float]:
    """Of many restaurants: minus the sum of the logarithms of Beta(strength + 1, customers - 1), and how many of their further tables were opened for the concentration's sake."""
    x = -float(np.log(np.maximum(rng.beta(strength + 1, customers[customers > 1] - 1.0), 1e-300)).sum())
    y, ends = 0, np.cumsum(np.maximum(tables - 1, 0))
    for at in range(0, int(ends[-1]) if len(ends) else 0, block):
        place = np.arange(at, min(at + block, int(ends[-1])))
        r = np.searchsorted(ends, place, side="right")
        nth = place - (ends[r] - np.maximum(tables[r] - 1, 0)) + 1
        y += int((rng.random(len(place)) * (strength + discount * nth) < strength).sum())
    return [x, float(y)]


# The exchanges ------------------------------------------------------------------------------

class AskWords:
    """Each chunk sends the training counts of its words."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("words").to_pylist(), strict=True):
                names, counts = unblobs(payload)
                names, counts = np.frombuffer(names, np.uint64), from_numbers(counts)
                out = [{"target": k, "kind": WORDS, "source": chunk, "payload": blobs(names[a:z].tobytes(), numbers(counts[a:z]))} for k, a, z in cut_at(names, self.buckets)]
                yield messages(out).combine_chunks().to_batches()[0]


def cut_at(names: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Bucket, begin and end of sorted names: buckets are ranges of the hash."""
    cuts = np.searchsorted(bucket_of(names, buckets), np.arange(buckets + 1)).tolist()
    return [(k, a, z) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < z]


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Parts of (names, counts): the sums by name, and the places of each part's names among them."""
    names, of = np.unique(np.concatenate([n for n, _ in parts]), return_inverse=True)
    sums = np.bincount(of, np.concatenate([c for _, c in parts]), len(names)).astype(np.int64)
    return sums, np.split(of, np.cumsum([len(n) for n, _ in parts])[:-1])


class CountWords:
    """The training count of each word, and its place in the bucket, in the order asked. sums: the bucket's tokens, known words, and words."""

    def __call__(self, table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        chunks, payloads = of_kind(table, WORDS)
        count, places = added([(np.frombuffer(n, np.uint64), from_numbers(c)) for n, c in map(unblobs, payloads)])
        rows = [{"target": c, "kind": WORDS, "source": bucket, "payload": blobs(numbers(count[p]), steps(p))} for c, p in zip(chunks, places, strict=True)]
        rows[0]["sums"] = [float(count.sum()), float((count > 0).sum()), float(len(count))]
        return messages(rows)


def known_words(right: pa.Table, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Training count and number of each of a chunk's words. offsets: the first number of each bucket."""
    sources, payloads = of_kind(right, WORDS)
    parts = [unblobs(p) for p in payloads]
    return np.concatenate([from_numbers(c) for c, _ in parts]), np.concatenate([from_steps(w) + offsets[k] for k, (_, w) in zip(sources, parts, strict=True)])


class AskPairs:
    """Each chunk sends its pairs to the buckets of their contexts.

    Of each segment the number of its context, its part, how many words follow, the context's customers and parts; the
    numbers of the words that follow; of each pair its word and training count."""

    def __init__(self, buckets: int, split: int, offsets: list[int]):
        self.buckets, self.split, self.offsets = buckets, split, offsets

    def __call__(self, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for chunk, own, pairs in zip(left.column("chunk").to_pylist(), left.column("words").to_pylist(), left.column("pairs").to_pylist(), strict=True):
            names = np.frombuffer(unblobs(own)[0], np.uint64)
            follow, word, count = map(from_numbers, unblobs(pairs))
            known, number = known_words(right, self.offsets)
            g = segments(names, follow, word, known, self.split, self.buckets)
            word, count = word[g.index], count[g.index]
            edge = np.concatenate([[0], np.cumsum(g.size)])
            for k, (a, z) in enumerate(zip(g.cuts[:-1].tolist(), g.cuts[1:].tolist(), strict=True)):
                if a < z:
                    p, c = slice(edge[a], edge[z]), g.context[a:z]
                    here, of = np.unique(word[p], return_inverse=True)
                    payload = blobs(steps(number[c]), numbers(g.part[a:z]), numbers(g.size[a:z]), numbers(known[c]), numbers(g.parts[a:z]), steps(number[here]), numbers(of), numbers(count[p]))
                    out.append({"target": k, "kind": PLACES, "source": chunk, "payload": payload})
        return messages(out)


class Merge:
    """A bucket's pairs, each once (STATE); where those that a chunk asked for stand among them (PLACES); and NAMES, the numbers of its words and of its contexts in parts, for the parent's buckets, of ``size`` numbers each. sums: pairs seen once and twice."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, table: pa.Table) -> pa.Table:
        bucket = table.column("target")[0].as_py()
        chunks, payloads = of_kind(table, PLACES)
        parts = [unblobs(p) for p in payloads]
        whole = lambda k, read=from_numbers: np.concatenate([read(p[k]) for p in parts])
        root, piece, sizes = whole(0, from_steps), whole(1), whole(2)
        _, first, seg = np.unique(root << 20 | piece, return_index=True, return_inverse=True)
        customers, pieces = whole(3)[first], whole(4)[first]
        lists = [from_steps(p[5]) for p in parts]
        vocabulary, word = np.unique(np.concatenate(lists), return_inverse=True)
        heads = np.cumsum([0, *map(len, lists)])
        key = np.repeat(seg, sizes) * len(vocabulary)
        key += word[np.concatenate([from_numbers(p[6]) + h for p, h in zip(parts, heads, strict=False)])]
        pair, of = np.unique(key, return_inverse=True)
        del key
        count = np.bincount(of, whole(7)).astype(np.int64)
        cut = np.flatnonzero(pieces > 1)  # in the order of their contexts' numbers
        roots, piece = root[first[cut]], piece[first[cut]]
        payload = blobs(
            numbers(np.bincount(pair // len(vocabulary), minlength=len(first))), numbers(customers), numbers(cut), numbers(piece), steps(vocabulary), steps(roots), numbers(pair % len(vocabulary)), numbers(count),
        )
        rows = [{"target": bucket, "kind": STATE, "source": bucket, "payload": payload, "sums": [float((count == 1).sum()), float((count == 2).sum())]}]
        at = 0
        for chunk, p in zip(chunks, parts, strict=True):
            n = int(from_numbers(p[2]).sum())
            rows.append({"target": bucket, "kind": PLACES, "source": chunk, "payload": steps(of[at : at + n])})
            at += n
        for k, w, r in by_parent(vocabulary, roots, self.size):
            rows.append({"target": k, "kind": NAMES, "source": bucket, "payload": blobs(steps(vocabulary[w] - k * self.size), steps(roots[r] - k * self.size))})
        return messages(rows)


def by_parent(words_: np.ndarray, roots: np.ndarray, size: int) -> list[tuple[int, slice, slice]]:
    """The parent's buckets that ascending numbers belong to, and which of the words and roots."""
    most = max([-1, *words_[-1:].tolist(), *roots[-1:].tolist()]) // size + 1
    w, r = (np.searchsorted(x, np.arange(most + 1) * size).tolist() for x in (words_, roots))
    return [(k, slice(w[k], w[k + 1]), slice(r[k], r[k + 1])) for k in range(most) if w[k] < w[k + 1] or r[k] < r[k + 1]]


def steps(places: np.ndarray) -> bytes:
    """Places, mostly ascending, by their differences."""
    step = np.diff(places, prepend=0)
    return numbers(2 * np.abs(step) + (step < 0))


def from_steps(payload: bytes) -> np.ndarray:
    code = from_numbers(payload)
    return np.cumsum(np.where(code & 1, -(code >> 1), code >> 1))


@dataclass
class Totals:
    """What holds for all restaurants in a sweep. round: its number; n_all, n_kinds: training tokens and known words; customers, tables: of the parent."""

    round: int
    n_all: int
    n_kinds: int
    strength: float
    discount: float
    top_strength: float
    top_discount: float
    customers: float
    tables: float


class State:
    """A bucket's restaurants."""

    def __init__(self, left: pa.Table, size: int):
        (self.bucket,), (payload,) = of_kind(left, STATE)
        follow, customers, cut, piece, words_, roots, word, count = unblobs(payload)
        self.follow, self.customers, self.cut, self.piece, self.word, self.count = map(from_numbers, (follow, customers, cut, piece, word, count))
        self.words, self.roots, self.size = from_steps(words_), from_steps(roots), size
        self.seg = np.repeat(np.arange(len(self.follow)), self.follow)

    def ask(self, tables: np.ndarray) -> list[dict]:
        """Messages to the parent: the tables of each word, and of each part of a context in parts."""
        sums = np.bincount(self.word, tables, len(self.words)).astype(np.int64)
        own = np.bincount(self.seg, tables, len(self.follow)).astype(np.int64)[self.cut]
        return [{"target": k, "kind": PARENT, "source": self.bucket, "payload": blobs(numbers(sums[w]), numbers(own[r]))} for k, w, r in by_parent(self.words, self.roots, self.size)]

    def answer(self, payloads: list[bytes], tables: np.ndarray, t: Totals) -> tuple[np.ndarray, np.ndarray]:
        """The parent's probability of each word, and the tables of each segment's context."""
        parts = [unblobs(p) for p in payloads]
        customers, own = (np.concatenate([from_numbers(p[k]) for p in parts]) for k in (0, 1))
        top = (customers - t.top_discount * own + (t.top_strength + t.top_discount * t.tables) / (t.n_kinds + 1)) / (t.top_strength + t.customers)
        in_all = np.bincount(self.seg, tables, len(self.follow))
        in_all[self.cut] = np.concatenate([from_numbers(p[2]) for p in parts])
        return top, in_all


class Sweep:
    """One sweep of a bucket: TABLES of its pairs, and messages to the parent. sums: see auxiliary(). Round 0 only sets the start."""

    def __init__(self, totals: Totals, size: int):
        self.totals, self.size = totals, size

    def __call__(self, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return messages([])
        s, t, sums = State(left, self.size), self.totals, [0.0, 0.0]
        tables = np.minimum(s.count, 1)
        if t.round:
            rng = np.random.default_rng([9, t.round, s.bucket])
            old = from_numbers(of_kind(right, TABLES)[1][0])
            top, in_all = s.answer(of_kind(right, PARENT)[1], old, t)
            own = np.ones(len(s.follow), bool)
            own[s.cut] = s.piece == 0  # of a context in parts, the first one speaks
            own &= s.customers > 0
            sums = auxiliary(s.customers[own], in_all[own].astype(np.int64), t.strength, t.discount, rng)
            many = np.flatnonzero(s.count > 1)
            p = top[s.word[many]]
            others = in_all[s.seg[many]] - old[many]
            tables[many] = draw_tables(s.count[many], (t.strength + t.discount * others) * p, t.discount * p, t.discount, stirling_ratios(t.discount), rng)
        return messages([{"target": s.bucket, "kind": TABLES, "source": s.bucket, "payload": numbers(tables), "sums": sums}, *s.ask(tables)])


class SeatParent:
    """Seats a range of words in the parent's restaurant; adds up the tables of contexts in parts. Answers stand in the order asked. sums: customers, tables, words with one and with two customers."""

    def __init__(self, totals: Totals, size: int):
        self.totals, self.size = totals, size

    def __call__(self, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return messages([])
        bucket, t = left.column("target")[0].as_py(), self.totals
        sources, payloads = of_kind(right, PARENT)
        places = {s: tuple(map(from_steps, unblobs(p))) for s, p in zip(*of_kind(left, NAMES), strict=True)}
        customers, in_parts = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for s, p in zip(sources, payloads, strict=True):
            words_, parts = map(from_numbers, unblobs(p))
            customers[places[s][0]] += words_  # a bucket asks for a word once
            np.add.at(in_parts, places[s][1], parts)
        rng, n = np.random.default_rng([1009, t.round, bucket]), len(customers)
        # The base is the same for all words, known or not; all tables but a word's own are about all.
        base = np.full(n, (t.top_strength + t.top_discount * max(t.tables - 1, 0)) / (t.n_kinds + 1))
        tables = draw_tables(customers, base, np.full(n, t.top_discount / (t.n_kinds + 1)), t.top_discount, stirling_ratios(t.top_discount), rng)
        rows = [{"target": s, "kind": PARENT, "source": bucket, "payload": blobs(numbers(customers[p]), numbers(tables[p]), numbers(in_parts[r]))} for s, (p, r) in ((s, places[s]) for s in sources)]
        rows[0]["sums"] = [float(customers.sum()), float(tables.sum()), float((customers == 1).sum()), float((customers == 2).sum())]
        return messages(rows)


class Predict:
    """The averaged probability (its decimal logarithm) of each pair that a chunk asked for. right: TABLES and PARENT of each sample; the sample is in the source's place over 2**32."""

    def __init__(self, totals: list[Totals], size: int):
        self.totals, self.size = totals, size

    def __call__(self, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return messages([])
        s, prob = State(left, self.size), 0.0
        sample = right.column("source").to_numpy() >> 32
        for k, t in enumerate(self.totals):
            own = right.filter(pa.array(sample == k))
            tables = from_numbers(of_kind(own, TABLES)[1][0])
            top, in_all = s.answer(of_kind(own, PARENT)[1], tables, t)
            more = (t.strength + t.discount * in_all)[s.seg] * top[s.word]
            prob = prob + (s.count - t.discount * tables + more) / (t.strength + s.customers)[s.seg]
        log_p = np.log10(prob / len(self.totals)).astype(np.float32)
        chunks, payloads = of_kind(left, PLACES)
        return messages([{"target": c, "kind": PROBABILITIES, "source": s.bucket, "payload": log_p[from_steps(p)].tobytes()} for c, p in zip(chunks, payloads, strict=True)])


class Score:
    """Scores the documents of a chunk."""

    def __init__(self, buckets: int, split: int, offsets: list[int], n_all: int, n_kinds: int):
        self.buckets, self.split, self.offsets, self.n_all, self.n_kinds = buckets, split, offsets, n_all, n_kinds

    def __call__(self, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for own, pairs, docs in zip(*(left.column(c).to_pylist() for c in ("words", "pairs", "docs")), strict=True):
            names = np.frombuffer(unblobs(own)[0], np.uint64)
            follow, word, _ = map(from_numbers, unblobs(pairs))
            ids, has_id, held, sizes, of = unblobs(docs)
            sizes, of = from_numbers(sizes), from_numbers(of)
            known, _ = known_words(right, self.offsets)
            g = segments(names, follow, word, known, self.split, self.buckets)
            log_p = np.empty(len(word))
            log_p[g.index] = np.concatenate([np.frombuffer(p, np.float32) for p in of_kind(right, PROBABILITIES)[1]])
            tokens = word[of]
            base = np.log10((known + 0.5) / (self.n_all + 0.5 * (self.n_kinds + 1)))
            starts = np.cumsum(sizes) - sizes
            add = lambda a: np.add.reduceat(a, starts)
            doc_id = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(has_id, np.uint8) == 0)
            held = np.frombuffer(held, np.uint8).astype(bool)
            out.append(pa.table({"doc_id": doc_id, "held_out": held, "n_tokens": sizes, "n_known": add((known[tokens] > 0).astype(np.int64)), "base_score": add(base[tokens]), "score": add(log_p[of])}))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], v) for k, v in SCORE_TYPES.items()})


def from_counts(one: float, two: float) -> float:
    """A discount from the numbers of things seen once and twice."""
    return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5


def bucketed(df: DataFrame, name: str, by: str, parts: int, *kinds: str) -> DataFrame:
    """df as a table in the shared folder, whose files are bucketed: groups by that column need no shuffle."""
    spark = df.sparkSession
    w = df.write.format("parquet").bucketBy(parts, by).option("path", new_path(spark, name))
    (w.partitionBy(*kinds) if kinds else w).saveAsTable(name)
    return spark.table(name)


def score_documents(docs: DataFrame, held_out, burn: int = 2, samples: int = 3, split: int = 500_000, top_strength: float = 1.0, seed: int = 9) -> DataFrame:
    """docs: doc_id, text; held_out: a column, whether a document is kept from training (null: it is not).

    One row each: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. split: customers from which a context is dealt over buckets; it does not change the model."""
    spark = docs.sparkSession
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    run = uuid.uuid4().hex
    made = map_batches(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), Chunks(), "chunk bigint, words binary, pairs binary, docs binary, n_tokens bigint")
    chunks = bucketed(made, f"lodesieve_chunks_{run}", "chunk", parts)
    # Buckets grow with the data, not with the cluster: messages are as many as chunks times buckets, or buckets times the parent's.
    tokens = int(chunks.agg(F.sum("n_tokens")).first()[0] or 0)
    buckets, by_word = max(12, tokens // PER_BUCKET), max(12, tokens // PER_WORDS)
    words_ = saved(map_batches(chunks.select("chunk", "words"), AskWords(by_word), MESSAGE).groupBy("target").applyInArrow(plain(CountWords()), MESSAGE), "words")
    n_all, n_kinds, n_words = added_up(words_, 3)
    # One number for each bucket: as many as there are.
    counts = {r["source"]: int(r["n"]) for r in words_.where("sums IS NOT NULL").select("source", F.element_at("sums", 3).alias("n")).collect()}
    offsets = np.cumsum([0, *(counts.get(k, 0) for k in range(by_word))]).tolist()
    size = max(1, min(PER_PARENT, -int(-n_words // 6)))
    asked = chunks.select("chunk", "words", "pairs").groupBy("chunk").cogroup(words_.groupBy("target")).applyInArrow(both(AskPairs(buckets, split, offsets)), MESSAGE)
    state = bucketed(asked.groupBy("target").applyInArrow(plain(Merge(size)), MESSAGE), f"lodesieve_state_{run}", "target", parts, "kind").select(*MESSAGE_TYPES)
    pairs = state.where(F.col("kind") == STATE)
    names = state.where(F.col("kind") == NAMES)
    discount = from_counts(*added_up(pairs, 2))
    rng = np.random.default_rng(seed)
    t = Totals(0, int(n_all), int(n_kinds), 1.0, discount, top_strength, 0.5, 0.0, float(n_kinds))
    right, kept = spark.createDataFrame([], MESSAGE), []
    for k in range(burn + samples + 1):
        t = Totals(k, t.n_all, t.n_kinds, t.strength, discount, top_strength, t.top_discount, t.customers, t.tables)
        swept = saved(pairs.groupBy("target").cogroup(right.groupBy("target")).applyInArrow(both(Sweep(t, size)), MESSAGE), f"sweep-{k}")
        asked = swept.where(F.col("kind") == PARENT)
        seated = saved(names.groupBy("target").cogroup(asked.groupBy("target")).applyInArrow(both(SeatParent(t, size)), MESSAGE), f"parent-{k}")
        customers, tables, one, two = added_up(seated, 4)
        if k == 0:
            t.top_discount = from_counts(one, two)
        else:
            x, y = added_up(swept.where(F.col("kind") == TABLES), 2)
            t.strength = float(rng.gamma(1 + y) / (1 + x))
        t.customers, t.tables = customers, tables
        right = swept.where(F.col("kind") == TABLES).unionByName(seated)
        if k > burn:
            place = F.lit(len(kept)).cast("bigint") * F.lit(1 << 32)
            kept.append((right.withColumn("source", F.col("source") + place), Totals(**vars(t))))
    all_samples = kept[0][0]
    for r, _ in kept[1:]:
        all_samples = all_samples.unionByName(r)
    answers = state.where(F.col("kind") != NAMES).groupBy("target").cogroup(all_samples.groupBy("target")).applyInArrow(both(Predict([x for _, x in kept], size)), MESSAGE)
    scored = chunks.groupBy("chunk").cogroup(words_.unionByName(answers).groupBy("target")).applyInArrow(both(Score(buckets, split, offsets, int(n_all), int(n_kinds))), SCORES)
    scored = saved(scored, "scores")
    for name in ("chunks", "state"):
        spark.sql(f"DROP TABLE lodesieve_{name}_{run}")  # the files stay in the shared folder
    return scored.withColumn("train_tokens", F.lit(int(n_all)).cast("bigint")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def added_up(rows: DataFrame, n: int) -> list[float]:
    return [float(x or 0) for x in rows.agg(*[F.sum(F.try_element_at("sums", F.lit(k + 1))) for k in range(n)]).first()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(documents(spark, sf_dir), fold("doc_id", 5) == 1)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
