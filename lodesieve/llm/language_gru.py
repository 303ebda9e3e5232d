"""Language ID: a bidirectional gated recurrent network over bytes.

Each text is cut into windows of ``window`` bytes, all of them, to its end. In a window one
network runs forwards over the bytes and one backwards; at every byte the two states give
scores of the languages, and so a probability at every position. A document's probability
of a language pools those of its positions: the mean of their logarithms, normalised. Each
position has seen its whole window, so positions that speak for nothing weigh little.

The network is trained here, in numpy, by backpropagation through time with Adam, on a bounded
sample of the labelled documents: about ``per_language`` of each language and ``total`` in all, chosen by the
hash of the id among those with crc32(id as text) mod 5 not 0, and of each up to ``pieces`` windows, spread evenly over the
whole text (see sample()). The languages are the labels found. Prediction reads the text alone, all of it.

Defined results. ``und``, with score 0, where the text is null or has no letter (Unicode's letters: no digits, fractions or numerals), or where there was
nothing to learn from. An empty table gives an empty result. Ids are passed through, null and repeated ones too (a null id counts as
the empty text in the fold); other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, map_batches, slices, text_buffer

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
#: Letters, and some numbers that are no decimal digits.
LETTER = re.compile(r"[^\W\d_]")
PAD = 256


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER.finditer(text))


class Network:
    """Weights of the two directions and of the output."""

    def __init__(self, languages: list[str], hidden: int, seed: int = 6):
        rng = np.random.default_rng(seed)
        H, L = hidden, len(languages)
        self.languages, self.hidden = languages, H
        draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        # A byte's input to the gates r, z and the candidate (with their biases), and the recurrent weights.
        self.p = {f"{d}{k}": v for d in "fb" for k, v in (("x", draw(257, 3 * H)), ("h", (draw(H, 3 * H))))} | {"out": draw(2 * H, L), "bias": np.zeros(L, np.float32)}
        for d in "fb":
            self.p[d + "x"][:, H : 2 * H] += 0.5

    def run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: steps x windows, bytes. The states of one direction at every step."""
        T, N = x.shape
        H, wx, wh = self.hidden, self.p[d + "x"], self.p[d + "h"]
        out, h = np.empty((T, N, H), np.float32), np.zeros((N, H), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            gx, gh = wx[x[t]], h @ wh
            rz = sigmoid(gx[:, : 2 * H] + gh[:, : 2 * H])
            r, z = rz[:, :H], rz[:, H:]
            c = np.tanh(gx[:, 2 * H :] + r * gh[:, 2 * H :])
            new = c + z * (h - c)
            if keep is not None:
                keep.append((t, h, rz, c, gh[:, 2 * H :]))
            out[t] = h = new
        return out

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch. x: steps x windows; y: the language of each window."""
        T, N = x.shape
        H, kept = self.hidden, {"f": [], "b": []}
        states = np.concatenate([self.run(x, d, kept[d]) for d in "fb"], 2)
        logits = states @ self.p["out"] + self.p["bias"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        real = (x != PAD)[..., None] / max(1, (x != PAD).sum())
        gold = np.eye(prob.shape[2], dtype=np.float32)[y]
        loss = float(-(np.log((prob * gold).sum(2) + 1e-9)[..., None] * real).sum())
        d_logits = ((prob - gold) * real).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = states.reshape(-1, 2 * H).T @ d_logits.reshape(T * N, -1), d_logits.sum((0, 1))
        d_states = d_logits @ self.p["out"].T
        for d, at in (("f", 0), ("b", H)):
            wh, dh = self.p[d + "h"], np.zeros((N, H), np.float32)
            gates = np.empty((T, N, 3 * H), np.float32)
            for t, h, rz, c, ghc in reversed(kept[d]):
                dh = dh + d_states[t, :, at : at + H]
                r, z = rz[:, :H], rz[:, H:]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * ghc * r * (1 - r)
                gates[t] = np.concatenate([dr, dz, dc], 1)
                dgh = np.concatenate([dr, dz, dc * r], 1)
                g[d + "h"] += h.T @ dgh
                dh = dh * z + dgh @ wh.T
            np.add.at(g[d + "x"], x.ravel(), gates.reshape(-1, 3 * H))
        return loss, g

    def states(self, x: np.ndarray, d: str) -> np.ndarray:
        """As run(), in buffers that are used again; the gates' halves are taken in the weights."""
        T, N = x.shape
        H = self.hidden
        half = np.concatenate([np.full(2 * H, 0.5, np.float32), np.ones(H, np.float32)])
        wx, wh = self.p[d + "x"] * half, self.p[d + "h"] * half
        out, h = np.empty((T, N, H), np.float32), np.zeros((N, H), np.float32)
        gx, gh, c = np.empty((N, 3 * H), np.float32), np.empty((N, 3 * H), np.float32), np.empty((N, H), np.float32)
        rz = np.empty((N, 2 * H), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            np.take(wx, x[t], 0, gx, "clip")
            np.matmul(h, wh, gh)
            np.add(gx[:, : 2 * H], gh[:, : 2 * H], rz)
            np.tanh(rz, rz)
            rz += np.float32(1)
            rz *= np.float32(0.5)
            np.multiply(rz[:, :H], gh[:, 2 * H :], c)
            c += gx[:, 2 * H :]
            np.tanh(c, c)
            new = out[t]
            np.subtract(h, c, new)
            new *= rz[:, H:]
            new += c
            h = new
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """x: steps x windows. The sum, over each window's bytes, of the log-probabilities of the languages."""
        T, N = x.shape
        flat = lambda d: self.states(x, d).reshape(T * N, -1)
        logits = flat("f") @ self.p["out"][: self.hidden]
        logits += flat("b") @ self.p["out"][self.hidden :]
        logits += self.p["bias"]
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        logits = logits.reshape(T, N, -1)
        logits[x == PAD] = 0
        return logits.sum(0)


def sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * a) + np.float32(0.5)


def windows_of(raw: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, steps x windows, filled up with PAD; and the text of each."""
    sizes = np.diff(at)
    counts = -(-sizes // window)
    text = np.repeat(np.arange(len(sizes)), counts)
    k = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = at[:-1][text] + k * window
    index = start + np.arange(window)[:, None]
    real = index < at[1:][text]
    x = np.full(index.shape, PAD, np.int16)
    x[real] = raw[index[real]]
    return x, text


def train(texts: list[bytes], langs: list[str], hidden: int = 8, window: int = 64, batch: int = 256, steps: int = 400, rate: float = 0.01) -> Network | None:
    """A network that has learned from UTF-8 texts, or parts of them, and their languages; None if there are none."""
    if not texts:
        return None
    languages = sorted(set(langs))
    net, rng = Network(languages, hidden), np.random.default_rng(6)
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    x, text = windows_of(raw, at, window)
    y = np.array([languages.index(v) for v in langs])[text]
    by = [np.flatnonzero(y == k) for k in range(len(languages))]
    by = [b for b in by if len(b)]
    if not by:
        return None
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    for s in range(1, steps + 1):
        pick = np.concatenate([rng.choice(b, max(1, batch // len(by))) for b in by])
        _, g = net.step(x[:, pick], y[pick])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        now = rate * min(1, s / 20) * (0.1 if s > 0.8 * steps else 1)
        for k, p in net.p.items():
            a = g[k] / max(1.0, norm)
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.01 * (a * a - v[k])
            p -= now * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)
    return net


class Predict:
    def __init__(self, net: Network | None, window: int):
        self.net, self.window = net, window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 19):
                yield self.one(b)

    def one(self, b: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = text_buffer(b.column("text"))
        n, lang, score = b.num_rows, [], []
        if self.net is not None:
            total = np.zeros((n, len(self.net.languages)))
            x, text = windows_of(raw, at, self.window)
            for k in range(0, x.shape[1], 1024):
                np.add.at(total, text[k : k + 1024], self.net.log_probabilities(x[:, k : k + 1024]))
            mean = total / np.maximum(np.diff(at), 1)[:, None]
            prob = np.exp(mean - mean.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            best = prob.argmax(1)
        for d, t in enumerate(b.column("text")):
            known = self.net is not None and t.is_valid and has_letter(t.as_py())
            lang.append(self.net.languages[best[d]] if known else "und")
            score.append(float(prob[d, best[d]]) if known else 0.0)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


class Pieces:
    """Up to so many windows of each text, spread evenly over all of it."""

    def __init__(self, pieces: int, window: int):
        self.pieces, self.window = pieces, window

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                raw, at = text_buffer(b.column("text"))
                out = []
                for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n = -(-(z - a) // self.window)
                    some = np.unique(np.linspace(0, n - 1, min(n, self.pieces)).astype(np.int64)) if n else []
                    out.append(b"".join(raw[a + k * self.window : min(a + (k + 1) * self.window, z)].tobytes() for k in some))
                yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), pa.array(out, pa.binary())], ["h", "lang", "windows"])


def sample(docs: DataFrame, per_language: int = 400, total: int = 20_000, pieces: int = 64, window: int = 64) -> tuple[list[bytes], list[str]]:
    """Windows and labels to learn from: of about per_language documents of each language, and total in all, by the hash of their ids.

    So the driver gets about total * pieces * window bytes at most (82 MB), whatever the documents' sizes and the number of labels."""
    labelled = docs.where(F.col("lang").isNotNull() & (fold("doc_id", 5) != 0)).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"))
    sizes = labelled.groupBy("lang").count()
    languages = sizes.count()
    each = min(float(per_language), total / max(1, languages))
    share = sizes.select(F.col("lang").alias("l"), (F.lit(each) / F.col("count")).alias("share"))
    if languages <= 100_000:  # a few MB; then no text is shuffled
        share = F.broadcast(share)
    chosen = labelled.join(share, F.col("lang") == F.col("l")).where(F.col("h") < F.col("share") * (1 << 40)).select("h", "lang", "text")
    rows = map_batches(chosen, Pieces(pieces, window), "h bigint, lang string, windows binary").orderBy("h", "lang", "windows").limit(2 * total).collect()
    rows = [r for r in rows if r["windows"]]
    return [bytes(r["windows"]) for r in rows], [r["lang"] for r in rows]


def language_id(docs: DataFrame, net: Network | None, window: int = 128) -> DataFrame:
    """docs: doc_id, text. One row each, by a network that was trained before."""
    rows = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return map_batches(rows, Predict(net, window), SCHEMA)


class Keep:
    """Whole rows of the documents that are in a language, by the same prediction."""

    def __init__(self, predict: Predict, least: float):
        self.predict, self.least = predict, least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 19):
                rows = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.nulls(b.num_rows, pa.bool_()), b.column("text")], ["doc_id", "held_out", "text"])
                found = self.predict.one(rows)
                yield b.filter(pa.array([v != "und" and s >= self.least for v, s in zip(found.column("lang_pred").to_pylist(), found.column("score").to_pylist(), strict=True)], pa.bool_()))


def in_a_language(docs: DataFrame, net: Network | None, margin: float = 1.1, window: int = 128) -> DataFrame:
    """docs, all columns, without rows of no language: those predicted ``und``, or whose best language has less than margin times an even share."""
    least = margin / max(1, len(net.languages)) if net is not None and len(net.languages) > 1 else 0.0
    return map_batches(docs, Keep(Predict(net, window), least), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id(docs, train(*sample(docs)))
