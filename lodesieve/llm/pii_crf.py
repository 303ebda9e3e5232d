r"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field adds what they miss: spelled-out mail addresses
(name at host dot com), bracketed ones and IPs, phone numbers without +, cards cut by dots or
slashes. It has the labels O and B-, I- of the four kinds, features of the word and of its two
neighbours (shape, digits, a few words, whether digits pass Luhn or are IP parts), and is
trained here, by gradient ascent on the likelihood, from the small labelled table that
labelled_sentences() writes down. Both training and decoding are numpy.

Decoding is exact Viterbi over whole texts, in batches, but only where a label other than O can win:
a word is O on the best path if no run of other labels through it could make up, in scores and
transitions, for O all along; such words cut the chain, and what lies between is decoded alone.

Emission scores depend on shapes alone, so they are computed once for each different shape;
shapes and words are found on the bytes of many texts at once.

Defined results. Null text counts as empty: no spans. A span of the field that overlaps a base
span is dropped, as base ones stay. Ids are passed through, null and repeated ones too; other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, slices, text_buffer
from .words import LOWER, mixed, span_hashes, word_bounds, word_hash

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"

# Base spans ---------------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match starts where digits do
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def octet(part: str) -> bool:
    """Whether digits, however many, are 255 at most."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    r"""Leftmost [A-Za-z0-9._%+-]+@DOMAIN: from each @ back to the last match, so that long words take no square of their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
            done = m.end()
        else:
            done = at + 1  # no match holds an @ that none could use
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, z) for a, z in emails(text)]
    for m in IP.finditer(text):
        if all(map(octet, m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=order)


def order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


# Shapes -------------------------------------------------------------------------------------

#: Words that tell something by themselves.
LEXICON = ("at", "dot", "[at]", "(at)", "[dot]", "(dot)", "{at}", "{dot}", "com", "org", "net", "edu", "phone", "tel", "tel:", "call", "fax", "mobile", "card", "visa", "ip", "host", "server", "mail", "email", "e-mail", "contact", "version", "order", "invoice", "isbn", "id", "year", "page")
CLASS = np.arange(256, dtype=np.uint8)
CLASS[65:91] = ord("X")
CLASS[97:123] = ord("x")
CLASS[128:] = ord("x")
CLASS[48:58] = ord("9")
LEX_EDGE = np.zeros(256, bool)
LEX_EDGE[[*b".,;:!?\"'"]] = True
#: Words of the lexicon by what is left of them without such signs.
LEX_HASH = np.sort(np.array(sorted({word_hash(w.strip(".,;:!?\"'")) for w in LEXICON}), np.uint64))
LEX_LONGEST = max(map(len, LEXICON))
LEX_GATE = np.zeros(1 << 16, bool)
LEX_GATE[(LEX_HASH & np.uint64(0xFFFF)).astype(np.int64)] = True


def shape(word: str) -> str:
    """Letters as X or x, runs of them as one; digits as 9, each of them; other signs as they are."""
    c = bytes(CLASS[np.frombuffer(word.encode(), np.uint8)]).decode("latin-1")
    return re.sub(r"x+", "x", re.sub(r"X+", "X", c))


def features(word: str) -> list[str]:
    """What the field knows of a word. Only words with a digit or sign inside, and those of the lexicon, have more than a coarse shape."""
    s = shape(word)
    core = s.strip(".,;:!?\"'")
    low = word.lower().strip(",;:!?\"'").rstrip(".")
    out = ["bias"]
    if low in LEXICON:
        out += ["word=" + low, "lexical"]
    n = core.count("9")
    if not n:
        if core.isalpha():
            return [*out, "alpha"]
        joined_ = re.search(r"[Xx][\[({][Xx]+[\])}][Xx]", core)
        return [*out, "signs=" + ("[x]" if joined_ else "@" if "@" in core else "[.]" if "[.]" in core or "(.)" in core else "other")]
    parts = re.split(r"9+", core)
    out += ["digits=" + str(min(n, 20)), "shape=" + core[:40], "lead=" + core[:1], "tail=" + core[-1:], "seps=" + "".join(sorted(set("".join(parts))))[:6]]
    raw = re.findall(r"[0-9]+", word)
    if len(raw) == 4 and all(len(p) <= 3 and octet(p) for p in raw) and re.fullmatch(r"9+(\[\.\]|\(\.\)|\[dot\]|\.)9+(\[x\]|\[\.\]|\(\.\)|\.)9+(\[x\]|\[\.\]|\(\.\)|\.)9+", core.replace("[x]", "[.]")):
        out.append("quad")
    if 13 <= n <= 19:
        out.append("luhn" if luhn("".join(raw)) else "noluhn")
    if "x" not in core.lower():
        out.append("numeric")
    return out


# The field ----------------------------------------------------------------------------------

class Field:
    """weights: features x labels for the word itself, the word before and the word after; transitions."""

    def __init__(self, names: list[str]):
        self.names = {n: k for k, n in enumerate(names)}
        L = len(LABELS)
        self.own, self.before, self.after = (np.zeros((len(names), L)) for _ in range(3))
        self.move, self.start = np.zeros((L, L)), np.zeros(L)
        self.allowed = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
        self.first = np.array([not b.startswith("I-") for b in LABELS])

    def scores(self, word_features: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word, its scores as itself, as the one before and as the one after."""
        out = np.zeros((3, len(word_features), len(LABELS)))
        for k, names in enumerate(word_features):
            own = [self.names[n] for n in names if n in self.names]
            out[0, k], out[1, k], out[2, k] = self.own[own].sum(0), self.before[own].sum(0), self.after[own].sum(0)
        return out[0], out[1], out[2]

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.allowed, self.move, -1e9), np.where(self.first, self.start, -1e9)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """rows: words and labels of each sentence. Adam on the mean log-likelihood, full batch, sentences padded."""
    feats = [[features(w) for w in words] for words, _ in rows]
    names = sorted({n for f in feats for w in f for n in w})
    field = Field(names)
    T, N, V, L = max(len(w) for w, _ in rows), len(rows), len(names), len(LABELS)
    x, y, real = np.zeros((N, T + 2, V)), np.zeros((N, T), int), np.zeros((N, T), bool)
    for n, (f, (_, labels)) in enumerate(zip(feats, rows, strict=True)):
        for t, w in enumerate(f):
            x[n, t + 1, [field.names[k] for k in w]] = 1
            y[n, t], real[n, t] = LABELS.index(labels[t]), True
    params = [field.own, field.before, field.after, field.move, field.start]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for r in range(1, rounds + 1):
        score = x[:, 1:-1] @ field.own + x[:, :-2] @ field.before + x[:, 2:] @ field.after
        move, start = field.moves()
        alpha, beta = np.zeros((N, T, L)), np.zeros((N, T, L))
        alpha[:, 0] = start + score[:, 0]
        for t in range(1, T):
            alpha[:, t] = np.where(real[:, t, None], log_sum(alpha[:, t - 1, :, None] + move, 1) + score[:, t], alpha[:, t - 1])
        for t in range(T - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], log_sum(move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = log_sum(alpha[:, -1], 1)
        prob = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + move + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        gold = np.eye(L)[y] * real[..., None]
        gold_pair = gold[:, :-1, :, None] * gold[:, 1:, None, :]
        d = (gold - prob) / N
        grads = [np.einsum("ntv,ntl->vl", xs, d) for xs in (x[:, 1:-1], x[:, :-2], x[:, 2:])] + [(gold_pair - pair).sum((0, 1)) / N, (gold[:, 0] - prob[:, 0]).sum(0) / N]
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            g = g - decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return field


def viterbi(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best labels of padded chains (chains x words x labels). end: what each label gets as a chain's last."""
    N, T, L = scores.shape
    best, back = start + scores[:, 0], np.zeros((N, T, L), np.int8)
    last = np.where((lengths == 1)[:, None], best + end, -np.inf)
    for t in range(1, T):
        step = best[:, :, None] + move
        back[:, t] = step.argmax(1)
        best = step.max(1) + scores[:, t]
        last = np.where((lengths == t + 1)[:, None], best + end, last)
    out = np.zeros((N, T), np.int8)
    label = last.argmax(1)
    rows = np.arange(N)
    for t in range(T - 1, -1, -1):
        here = t < lengths
        out[here, t] = label[here]
        label = np.where(here & (t > 0), back[rows, t, label], label)
    return out


# The labelled table -------------------------------------------------------------------------

#: Sentences with marked parts, {kind|words}; # stands for any digit, ~ for some name, ^ for a number that passes Luhn.
TEMPLATES = """
write to {email|~ at ~ dot com} today
and {email|~ [at] ~ [dot] org} or
mail {email|~ (at) ~ (dot) net} .
Kontakt: {email|~ at ~ dot de} bitte
de {email|~##~ at ~# dot ~ dot com} le
ou {email|~.## at ~# dot ~ dot fr} et
the {email|~[at]~[dot]com} is
reach {email|~@~.com} now
los {email|~.##@~#.~.com} que
call {phone|(###) ###-####} now
tel: {phone|###-###-####} or
phone {phone|### ### ####} the
Tel {phone|0## / #######} und
call {phone|###.###.####} la
numero {phone|+# (###) ###-####} de
ruf {phone|+## ### #######} an
in {phone|+# ###-###-####} of
the {phone|(###) ###-####} , and
server {ip|###[.]##[.]##[.]##} and
from {ip|1##.2#.1##.##} to
host {ip|##.1##.2#.1##.} The
ip {ip|1##(.)1##(.)#(.)#} le
card {card|^} and
visa {card|^} the
los {card|^} de
und {card|^} der
card {card|^4.} or
card {card|^/} or
the and of with no data in it
The end. And so on, as that was.
und die der mit von zu ein
los que de la para con un
le la et de les des un pour
at the dot of the end
looked at the dot and came
he was at home , dot by dot
we met at noon com and org
in #### the year ####
page ### of ####
costs ##.## or #,### of
order ######## and
invoice ############ is
number ################ in
isbn ###-#-##-######-# by
version #.#.# of
version ##.#.#.### with
from ####-##-## to ####-##-##
at ##:## and ##:##:##
about ###,### and ##% of
a $## and #### or ##
id ########-#### and
x-### y## ~-## z
ratio ##/## and ###/###
(####) and (##) of
### ### and ## ##
*** the $$$ and &&& of %%% ###
de%%% los### que&&& ez$$$ un***
the. And%%% so.%%% as,*** the
x-y and/or (the) [of] "in"
THIS,!! AS,!! THE.!! WH!! at!! dot!!
the (and) of [in] at (a) dot [b]
~!! ~!! ~!!
"""
NAMES = ("anna", "bob", "mail", "hostel", "kim", "pia", "onth", "example", "thre", "oskar")


def labelled_sentences(copies: int = 6) -> list[tuple[list[str], list[str]]]:
    """The labelled table: each template, several times over, with digits and names put in by rule."""
    rng, out = np.random.default_rng(8), []

    def fill(t: str) -> str:
        t = re.sub(r"#", lambda m: str(rng.integers(0, 10)), t)
        t = re.sub(r"~", lambda m: NAMES[rng.integers(0, len(NAMES))], t)

        def number(m: re.Match) -> str:
            d = "4" + "".join(map(str, rng.integers(0, 10, 14)))
            d += next(c for c in "0123456789" if luhn(d + c))
            sep = {"4.": ".", "/": "/"}.get(m.group(1) or "", "")
            return sep.join(d[k : k + 4] for k in range(0, 16, 4)) if sep else d

        return re.sub(r"\^(4\.|/)?", number, t)

    for line in TEMPLATES.strip().split("\n"):
        for _ in range(copies):
            words, labels = [], []
            for part in re.split(r"(\{[^}]*\})", line):
                kind, _, inner = part[1:-1].partition("|") if part.startswith("{") and "|" in part else ("", "", part)
                for k, w in enumerate(fill(inner).split()):
                    words.append(w)
                    labels.append(("B-" if k == 0 else "I-") + kind if kind else "O")
            out.append((words, labels))
    return out


# Decoding texts -----------------------------------------------------------------------------

class Tagger:
    """The field as arrays by shape number. Shape 0 is the edge of a text."""

    def __init__(self, field: Field):
        self.field = field
        self.move, start = field.moves()
        L = len(LABELS)
        self.start = start
        # What a run of labels other than O can gain in moves over a run of O: when it begins, goes on, and ends.
        stay = self.move[0, 0]
        self.enter = max(self.move[0, 1:].max() - stay, start[1:].max() - start[0])
        self.go_on = self.move[1:, 1:].max() - stay
        self.leave = max(self.move[1:, 0].max() - stay, 0.0)
        self.begin = np.flatnonzero([n.startswith("B-") for n in LABELS])
        self.known = np.zeros(1, np.uint64)
        self.table = np.zeros((3, 1, L))
        self.plain = {}

    def numbers(self, keys: np.ndarray, word_at) -> np.ndarray:
        """The number of each word's features. word_at(k): the text of word k."""
        slot = np.searchsorted(self.known, keys)
        slot[slot == len(self.known)] = 0
        new = np.flatnonzero(self.known[slot] != keys)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            rows = self.field.scores([features(word_at(int(new[k]))) for k in first])
            known = np.concatenate([self.known, fresh])
            by = np.argsort(known, kind="stable")
            self.known = known[by]
            self.table = np.stack([np.concatenate([a, b])[by] for a, b in zip(self.table, rows, strict=True)])
            slot = np.searchsorted(self.known, keys)
        return slot

    def tag(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the words that are not O: label, number of the text, start and end byte."""
        starts, ends, text = word_bounds(raw, at)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 4
        keys = self.keys(raw, starts, ends)
        n = self.numbers(keys, lambda k: raw[starts[k] : ends[k]].tobytes().decode("utf-8", "replace"))
        first = np.concatenate([[True], text[1:] != text[:-1]])
        last = np.append(first[1:], True)
        before, after = np.concatenate([[0], n[:-1]]), np.append(n[1:], 0)
        own, pre, post = self.table
        score = own[n] + np.where(first[:, None], 0, pre[before]) + np.where(last[:, None], 0, post[after])
        # A word is open if some run B ... through it could beat O all along; runs do not leave their text.
        more = score[:, 1:].max(1) - score[:, 0] + self.go_on - 1e6 * first
        total = np.cumsum(more)
        from_here = np.maximum.accumulate(score[:, self.begin].max(1) - score[:, 0] - total)
        to_here = np.maximum.accumulate(total[::-1])[::-1]
        open_ = from_here + to_here + self.enter + self.leave >= -1e-6
        begins = np.flatnonzero(open_ & (first | ~np.concatenate([[False], open_[:-1]])))
        stops = np.flatnonzero(open_ & (last | ~np.append(open_[1:], False))) + 1
        labels = np.zeros(len(starts), np.int8)
        sizes = stops - begins
        # Both neighbours of a chain are O, or the edge of the text.
        end = np.concatenate([[0], np.zeros(len(LABELS) - 1)])
        for lo, hi in ((1, 8), (9, 64), (65, 1 << 40)):
            pick = np.flatnonzero((sizes >= lo) & (sizes <= hi))
            step = max(1, 200_000 // max(1, int(sizes[pick].max(initial=1))))
            for k in range(0, len(pick), step):
                some = pick[k : k + step]
                width = int(sizes[some].max())
                index = np.minimum(begins[some, None] + np.arange(width), len(starts) - 1)
                chains = score[index].copy()
                inner = ~first[begins[some]]
                chains[:, 0] += np.where(inner[:, None], self.move[0], self.start)
                tail = np.where(last[stops[some] - 1][:, None], 0, self.move[:, 0])
                where = np.arange(len(some)), sizes[some] - 1
                chains[where] += tail
                got = viterbi(chains, sizes[some], self.move, np.zeros(len(LABELS)), end)
                inside = np.arange(width) < sizes[some, None]
                labels[index[inside]] = got[inside]
        found = np.flatnonzero(labels)
        return labels[found].astype(np.int64), text[found], starts[found], ends[found]

    def keys(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A key for each word; words with one key have the same features(), so it does not matter which of them a worker meets first."""
        c = CLASS[raw]
        letter = (c == ord("x")) | (c == ord("X"))
        keep = np.ones(len(raw), bool)
        keep[1:] = (c[1:] != c[:-1]) | ~letter[1:]
        keep[starts] = True
        past = np.concatenate([[0], np.cumsum(keep)])
        keys = span_hashes(c[keep], past[starts], past[ends])
        # Words of the lexicon, whatever signs stand around them, are told by their letters.
        place, core = np.arange(len(raw)), ~LEX_EDGE[raw]
        after = np.minimum.accumulate(np.where(core, place, len(raw))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(core, place, -1))
        s, e = after[starts], before[ends - 1] + 1
        short = np.flatnonzero((e - s <= LEX_LONGEST) & (s < e))
        bare = span_hashes(LOWER[raw], s[short], e[short])
        near = np.flatnonzero(LEX_GATE[(bare & np.uint64(0xFFFF)).astype(np.int64)])
        listed = short[near[np.isin(bare[near], LEX_HASH)]]
        keys[listed] = mixed(span_hashes(LOWER[raw], starts[listed], ends[listed]))
        # Luhn and the parts of IPs are no matter of shape: words with four or more digits are told by all they hold.
        digits = np.concatenate([[0], np.cumsum(c == ord("9"))])
        special = np.flatnonzero(digits[ends] - digits[starts] >= 4)
        keys[special] = span_hashes(raw, starts[special], ends[special])
        return keys


EDGE = ".,;:!?\"'"
AT = r"(?:@|[\s\[({]at[\s\])}])"
DOT = r"(?:\.|[\s\[({]dot[\s\])}])"
SPELLED = re.compile(rf"\w\s*{AT}.*\w\s*{DOT}\s*\w", re.I)


def plausible(kind: str, part: str) -> bool:
    """A last check on a span of the field: that it spells a whole address or number."""
    numbers = re.findall(r"[0-9]+", part)
    digits = "".join(numbers)
    if kind == "email":
        return SPELLED.search(part) is not None
    if kind == "ip":
        return len(numbers) == 4 and all(len(p) <= 3 and octet(p) for p in numbers)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def spans_of(labels: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """text, kind, start and end byte of each run B I I ..."""
    open_: list | None = None
    for label, d, a, z in zip(labels.tolist(), text.tolist(), starts.tolist(), ends.tolist(), strict=True):
        name = LABELS[label]
        if open_ and name.startswith("I-") and open_[0] == d and open_[1] == name[2:]:
            open_[3] = z
            continue
        if open_:
            yield tuple(open_)
        open_ = [d, name[2:], a, z]
    if open_:
        yield tuple(open_)


NOTHING = hashlib.sha256(b"").hexdigest()


class Find:
    def __init__(self, field: Field):
        self.field, self.tagger = field, None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.tagger = self.tagger or Tagger(self.field)
        for whole in batches:
            for b in slices(whole, "text"):
                yield self.one(b)

    def one(self, b: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = text_buffer(b.column("text"))
        n = b.num_rows
        added: dict[int, list] = {}
        for d, kind, a, z in spans_of(*self.tagger.tag(raw, at)):
            added.setdefault(d, []).append((kind, a - int(at[d]), z - int(at[d])))
        signs = np.zeros(n, bool)
        digit = (raw >= 48) & (raw <= 57)
        for hit in (np.flatnonzero(raw == 64), np.flatnonzero(digit[1:] & digit[:-1] if len(raw) > 1 else digit), np.flatnonzero((raw[1:] == 46) & digit[:-1] if len(raw) > 1 else digit), np.flatnonzero(raw == 43), np.flatnonzero((raw[1:-1] == 32) & digit[:-2] & digit[2:] if len(raw) > 2 else digit), np.flatnonzero((raw[1:-1] == 45) & digit[:-2] & digit[2:] if len(raw) > 2 else digit)):
            signs[np.searchsorted(at, hit, side="right") - 1] = True
        counts, digest, spans = np.zeros((4, n), np.int64), [NOTHING] * n, [""] * n
        for d in sorted({*np.flatnonzero(signs).tolist(), *added}):
            text = b.column("text")[d].as_py() or ""
            base = base_spans(text)
            for kind, _, _ in base:
                counts[KINDS.index(kind), d] += 1
            found = list(base)
            octets = text.encode()
            for kind, a, z in added.get(d, ()):
                a, z = len(octets[:a].decode()), len(octets[:z].decode())
                part = text[a:z]
                a, z = a + len(part) - len(part.lstrip(EDGE)), z - (len(part) - len(part.rstrip(EDGE)))
                if a < z and plausible(kind, text[a:z]) and not any(a < e and s < z for _, s, e in base):
                    found.append((kind, a, z))
            digest[d], spans[d] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(found, key=order))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, counts), pa.array(digest), pa.array(spans)], SCHEMA_NAMES)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs: doc_id, text. One row each: counts and digest of the base spans, and all spans. field: a trained one, else it is trained here."""
    return map_batches(docs.select("doc_id", "text"), Find(field or train(labelled_sentences())), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))
