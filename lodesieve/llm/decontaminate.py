"""Benchmark decontamination by template canonicalisation.

Words lose their case and the punctuation around them. Numbers (also spelled ones), names (capitalised words inside
a sentence) and units (after a number) become typed placeholders <num>, <name>, <unit>; what stood
there is the slot's value. Neighbouring names, or numbers, are one slot: a name of two words may stand for one of one. Windows of ``width`` template
words are hashed and joined, documents to benchmark items. Windows with fewer plain words than placeholders say too little as templates and are
hashed by value. A capitalised word that begins a sentence may be a plain word or a name, so a window that holds
such words has a second hash that takes them for names.

A match is a seed: on its diagonal (place in the document less place in the item) all words are
compared, those that only windows of mostly placeholders hold by value. An item is found if ``least``
words in a row, or all of a shorter item, match and are consistent: each value of the item stands
for one value in the document, and different names for different ones (different numbers may well become equal). A longer row that is not consistent
counts only for what in it is the same word for word, ``least`` words at least. So a copy is caught, and also
the question with other numbers and names, but not a text that only shares a form. Items with fewer
than ``SHORTEST`` words are found where they stand word for word.

A bit for each hash of the benchmark (its last ``gate_bits`` bits) goes to the tasks, which drop windows that can match none before
the join. The gate has the same size for any benchmark, and lets more through for a large one; what is found is the same.

Defined results. Null text counts as empty. Ids are passed through, null and repeated ones too; each row is judged by its own
text. Repeated items count once each by item_id; items with different texts, but one id or none, are searched
for each by itself. A null item_id counts in n_items, but is not listed. Empty tables give no match. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, free_names, map_batches, saved, slices, text_buffer
from .words import LOWER, mixed, span_hashes, word_bounds, word_hash

UNITS = ("km", "m", "cm", "mm", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "foot", "feet", "ft", "inch", "inches", "kg", "g", "mg", "lb", "lbs", "oz", "ton", "tons", "pound", "pounds", "l", "ml", "liter", "liters", "litre", "litres", "hour", "hours", "h", "minute", "minutes", "min", "second", "seconds", "s", "ms", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees", "mph", "km/h", "kmh", "w", "kw", "v", "hz", "khz", "mhz", "gb", "mb", "kb", "eur", "usd")
NUM, NAME, UNIT = (np.uint64(word_hash(f"<{k}>")) for k in ("num", "name", "unit"))
UNIT_HASH = np.sort(np.array([word_hash(u) for u in UNITS], np.uint64))
NUMBERS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million")
NUMBER_HASH = np.sort(np.array([word_hash(n) for n in NUMBERS], np.uint64))
#: Items shorter than this are searched for word for word.
SHORTEST = 5
DIGIT, SIGN, EDGE, STOP = (np.zeros(256, bool) for _ in range(4))
DIGIT[48:58] = True
SIGN[[*b"0123456789.,:/%+-$"]] = True
EDGE[[*b".,;:!?\"'()[]{}<>*_#$%&"]] = True
STOP[[*b".!?:"]] = True
#: Kind of a capitalised word that begins a sentence: plain, but possibly a name.
OPENER = 4
STEP = 0xD6E8FEB86659FD93
#: What is added to the size where a window is hashed by value.
BY_VALUE = 1 << 32
HITS = "array<struct<pos:int,size:int,hash:bigint>>"
HIT_TYPE = pa.list_(pa.struct([("pos", pa.int32()), ("size", pa.int32()), ("hash", pa.int64())]))


def template(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template word, value and kind (0: plain word, 1: number, 2: unit, 3: name, 4: plain, but begins a sentence with a capital) of each word, the number of its text, and how many words of it these are. Words that are signs only are left out; neighbouring names, or numbers, are one."""
    starts, ends, text = word_bounds(raw, at)
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = STOP[raw[ends - 1]]
    wide = np.zeros(len(raw), bool)  # the second byte of an upper-case letter of Latin-1
    wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low = LOWER[raw] + 32 * wide.astype(np.uint8)
    plain = ~EDGE[raw]
    place = np.arange(len(raw))
    after = np.minimum.accumulate(np.where(plain, place, len(raw))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(plain, place, -1))
    s, e = after[starts], before[ends - 1] + 1
    real = s < e
    first = np.concatenate([[True], text[1:] != text[:-1]])
    opens = first | np.concatenate([[True], stop[:-1]])  # begins a sentence
    s, e, text, opens = s[real], e[real], text[real], opens[real]
    if not len(s):
        return template(raw[:0], at[:1])
    value = span_hashes(low, s, e)
    upper = (raw[s] >= 65) & (raw[s] <= 90) | (raw[s] == 0xC3) & np.append(wide, False)[s + 1]
    head = DIGIT[raw[s]] | ((raw[s] == 43) | (raw[s] == 45)) & DIGIT[raw[np.minimum(s + 1, len(raw) - 1)]] & (e - s > 1)
    number = head | np.isin(value, NUMBER_HASH)
    follows = np.concatenate([[False], number[:-1] & (text[1:] == text[:-1])])
    unit = follows & np.isin(value, UNIT_HASH) if follows.any() else follows
    name = upper & ~opens & ~number & ~unit
    kind = np.select([number, unit, name, upper & opens & ~number & ~unit], [1, 2, 3, OPENER], 0).astype(np.int8)
    # A run of names (the first may begin a sentence), or of numbers, is one slot, and its value that of all its words.
    more = np.concatenate([[False], (text[1:] == text[:-1]) & ((kind[1:] == 3) & (kind[:-1] >= 3) | (kind[1:] == 1) & (kind[:-1] == 1))])
    begin = np.flatnonzero(~more)
    wide = np.diff(np.append(begin, len(value)))
    if more.any():
        place = np.arange(len(value)) - np.repeat(begin, wide)
        whole = np.add.reduceat(value * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1)), begin)
        value = np.where(wide > 1, mixed(whole), value[begin])
        kind, text = kind[begin], text[begin]
    word = np.select([kind == 1, kind == 2, kind == 3], [NUM, UNIT, NAME], value)
    return word, value, kind, text, wide


def slots(kind: np.ndarray) -> np.ndarray:
    return (kind > 0) & (kind < OPENER)


def windows(word: np.ndarray, value: np.ndarray, kind: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of size words in one text: of the template if it says enough, else of the values. A window that holds openers is there twice; one of an item of fewer than SHORTEST words by its values."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = np.flatnonzero(text[:n] == text[size - 1 :])

    def hashes(of: np.ndarray, at: np.ndarray, start: int) -> np.ndarray:
        h = np.full(len(at), start, np.uint64)
        for k in range(size):
            h = h * np.uint64(STEP) + of[at + k]
        return h

    if size < SHORTEST:
        return own, mixed(hashes(value, own, size + BY_VALUE))
    opener = kind == OPENER
    count, opens = (np.concatenate([[0], np.cumsum(x)]) for x in (slots(kind), opener))
    also = own[opens[own + size] > opens[own]]
    at = np.concatenate([own, also])
    h = np.concatenate([hashes(word, own, size), hashes(np.where(opener, NAME, word), also, size)])
    n_slots = count[at + size] - count[at]
    n_slots[len(own) :] += opens[also + size] - opens[also]
    dense = np.flatnonzero(2 * n_slots > size)
    h[dense] = hashes(value, at[dense], size + BY_VALUE)
    return at, mixed(h)


def packed(value: np.ndarray, kind: np.ndarray, wide: np.ndarray, strict: np.ndarray | None = None) -> np.ndarray:
    """Value and kind of each word in one number, whether it is compared by value only, and how many words it stands for (15 at most)."""
    low = kind.astype(np.uint64) | np.minimum(wide, 15).astype(np.uint64) << np.uint64(4)
    return value & ~np.uint64(255) | (low if strict is None else low | strict.astype(np.uint64) << np.uint64(3))


def covered(good: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places that a window holds; good: where windows begin, size: their sizes."""
    begin = np.flatnonzero(good)
    edge = np.zeros(len(good) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, np.minimum(begin + size[begin], len(good)), -1)
    return np.cumsum(edge)[:-1] > 0


def window_starts(equal: np.ndarray, slot: np.ndarray, size: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Where size words begin that are all equal, with no more slots than half; left: words from here to the end of the text."""
    place = np.arange(len(equal))
    end = np.minimum(place + size, len(equal))
    alike, open_ = (np.concatenate([[0], np.cumsum(x)]) for x in (equal, slot))
    return (left >= size) & (alike[end] - alike[place] == size) & (2 * (open_[end] - open_[place]) <= size)


def stretches(good: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal stretch of good places of one number."""
    if not len(good):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = number[1:] == number[:-1]
    begin, end = good.copy(), good.copy()
    begin[1:] &= ~(good[:-1] & same)
    end[:-1] &= ~(good[1:] & same)
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def consistent(a: np.ndarray, b: np.ndarray, name: np.ndarray) -> bool:
    """Whether each value of a stands beside one value of b only, and for names the other way too."""
    pairs = set(zip(a.tolist(), b.tolist(), strict=True))
    if len(pairs) != len(set(a.tolist())):
        return False
    names = set(zip(a[name].tolist(), b[name].tolist(), strict=True))
    return len(names) == len(set(b[name].tolist()))


class Compare:
    """Words in a row that match, for each seed's diagonal, or null. item, doc: packed words side by side; the item's word count and window size."""

    def __init__(self, width: int, least: int):
        self.width, self.least = width, least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                yield self.one(b.slice(at, 200))

    def one(self, b: pa.RecordBatch) -> pa.RecordBatch:
        sides = [[np.frombuffer(x, "<u8") for x in b.column(c).to_pylist()] for c in ("item_words", "doc_words")]
        length = np.array([len(x) for x in sides[0]], np.int64)
        number = np.repeat(np.arange(len(length)), length)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(number))
        a, d = (np.concatenate(x) for x in sides)
        all_words = b.column("n_words").to_numpy()
        size = np.minimum(all_words, self.width)[number]
        (va, ka, strict), (vd, kd, _) = ((x >> np.uint64(8), (x & np.uint64(7)).astype(np.int8), (x & np.uint64(8)) > 0) for x in (a, d))
        past = np.concatenate([[0], np.cumsum((a >> np.uint64(4) & np.uint64(15)).astype(np.int64))])
        same = va == vd
        sa, sd = slots(ka), slots(kd)
        template_same = np.where(sa | sd, ka == kd, same)
        maybe_name = (ka >= 3) & (kd >= 3)
        alike = same | template_same | maybe_name
        slot = sa | sd | maybe_name & ~same
        held = same | alike & ~strict & covered(window_starts(alike, slot, size, left), size)
        best = np.zeros(len(length), np.int64)

        def take(good: np.ndarray, more: bool, check: np.ndarray | None) -> None:
            begin, end = stretches(good, number)
            end = end + (size[begin] - 1 if more else 0)
            long = (past[end] - past[begin] >= self.least) | (end - begin >= all_words[number[begin]])
            for x, z in zip(begin[long].tolist(), end[long].tolist(), strict=True):
                k, words = number[x], past[z] - past[x]
                if words <= best[k]:
                    continue
                if check is not None and not same[x:z].all():
                    p = np.flatnonzero(check[x:z]) + x
                    if not consistent(va[p], vd[p], ka[p] >= 3):
                        continue
                best[k] = words

        take(same, False, None)
        take(held, False, slot)
        take(window_starts(template_same, sa, size, left), True, sa)
        return pa.RecordBatch.from_arrays([b.column("row"), b.column("item_id"), pa.array(best, mask=best == 0)], ["row", "item_id", "words"])


class Match:
    """Yields one row for each text: its windows, those only that can match if a gate is given, and its packed words if it has windows."""

    def __init__(self, sizes: list[int], gate: np.ndarray | None, passed: list[str], whole: bool = False):
        self.sizes, self.gate, self.passed, self.whole = sizes, gate, passed, whole

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield self.one(b)

    def one(self, b: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = text_buffer(b.column("text"))
        word, value, kind, text, wide = template(raw, at)
        bounds = np.searchsorted(text, np.arange(b.num_rows + 1))
        rows: list[list] = [[] for _ in range(b.num_rows)]
        for size in self.sizes:
            begin, h = windows(word, value, kind, text, size)
            if self.gate is not None and len(h):
                bit = (h & np.uint64(8 * len(self.gate) - 1)).astype(np.int64)
                near = np.flatnonzero(self.gate[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                begin, h = begin[near], h[near]
            for p, x in zip(begin.tolist(), h.view(np.int64).tolist(), strict=True):
                d = int(text[p])
                if self.whole and bounds[d + 1] - bounds[d] < size:
                    continue
                rows[d].append({"pos": p - int(bounds[d]), "size": size, "hash": x})
        strict = None
        if self.gate is None:
            own = np.minimum(np.diff(bounds), max(self.sizes, default=1))[text]
            strict = ~covered(window_starts(np.ones(len(text), bool), slots(kind), own, bounds[text + 1] - np.arange(len(text))), own)
        whole = packed(value, kind, wide, strict).astype("<u8")
        words = [whole[bounds[d] : bounds[d + 1]].tobytes() if r else None for d, r in enumerate(rows)]
        n_words = pa.array(np.diff(bounds), pa.int64())
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in self.passed), n_words, pa.array(words, pa.binary()), pa.array(rows, HIT_TYPE)], [*self.passed, "n_words", "words", "hits"])


def benchmark_windows(items: DataFrame, width: int) -> DataFrame:
    """item, item_id, n_words, words, hits: every window of every different item; an item shorter than width is one window. item: its number."""
    sizes = list(range(1, width + 1))
    once = items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id())
    rows = map_batches(once, Match(sizes, None, ["item", "item_id"]), f"item bigint, item_id bigint, n_words bigint, words binary, hits {HITS}")
    return rows.withColumn("hits", F.filter("hits", lambda w: (w["size"] == width) | (w["size"] == F.col("n_words")))).where(F.size("hits") > 0)


def gate_of(bench: DataFrame, bits: int) -> np.ndarray:
    """A bit for the last bits of each hash: as many bytes as 2**bits bits take, however many hashes there are."""
    place = F.col("hash").bitwiseAND((1 << bits) - 1)
    rows = bench.select(F.shiftright(place, 12).alias("page"), place.bitwiseAND(4095).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    gate = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in rows:
        page = np.frombuffer(bytes(r["bits"]), np.uint8)[:512]
        gate[512 * r["page"] : 512 * r["page"] + 512] |= page[: len(gate) - 512 * r["page"]]
    return gate


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 8, least: int = 13, gate_bits: int = 25) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. One row for each document: row, doc_id, text_hash, contaminated, n_items, items, max_words. gate_bits: 3 at least."""
    whole = saved(benchmark_windows(items, width), "benchmark-windows")
    bench = whole.select("item", F.explode("hits").alias("w")).select("item", F.col("w.pos").alias("item_pos"), F.col("w.size").alias("size"), F.col("w.hash").alias("hash"))
    # At most width sizes.
    sizes, gate = sorted(r["size"] for r in bench.select("size").distinct().collect()), gate_of(bench, gate_bits)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("text_hash"), "text")
    passed = ["doc_id", "row", "text_hash"]
    found = saved(map_batches(rows, Match(sizes, gate, passed), f"doc_id bigint, row bigint, text_hash bigint, n_words bigint, words binary, hits {HITS}"), "document-windows")
    hit = found.select("row", F.explode("hits").alias("w")).select("row", F.col("w.pos").alias("pos"), F.col("w.hash").alias("hash"))
    seed = hit.join(bench.select("item", "item_pos", "hash"), "hash").select("row", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    pair = seed.join(whole.select("item", "item_id", "n_words", F.col("words").alias("item_words")), "item").join(found.where("words IS NOT NULL").select("row", F.col("n_words").alias("doc_length"), F.col("words").alias("doc_words")), "row")
    first, past = F.greatest(F.col("diagonal"), F.lit(0)), F.least(F.col("diagonal") + F.col("n_words"), "doc_length")
    cut = lambda words, at: F.substring(words, (8 * at + 1).cast("int"), (8 * (past - first)).cast("int"))
    pair = pair.select("row", "item_id", "n_words", cut("item_words", first - F.col("diagonal")).alias("item_words"), cut("doc_words", first).alias("doc_words"))
    good = map_batches(pair, Compare(width, least), "row bigint, item_id bigint, words bigint").where("words IS NOT NULL")
    by_item = good.groupBy("row", "item_id").agg(F.max("words").alias("words"))
    by_doc = by_item.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), F.max("words").alias("max_words"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    out = found.select("doc_id", "row", "text_hash").join(by_doc, "row", "left")
    return out.select("row", "doc_id", "text_hash", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("max_words", F.lit(0)).alias("max_words"))


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated rows, all columns kept."""
    bad_id, bad_hash = free_names(docs.columns, "bad_id", "bad_hash")
    bad = decontaminate(docs, items).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[bad_id]) & (F.xxhash64(docs["text"]) == bad[bad_hash]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents; all others were looked at, and are clean."""
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("contaminated").select("doc_id", "contaminated", "n_items", "items", "max_words")
