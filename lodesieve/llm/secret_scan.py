r"""Secret scan: a worklist of decoded layers.

A text is layer 0. Each layer is searched for encoded parts: URL escapes (%41), Unicode
escapes (\u0041, \x41, &#65;, full-width forms, zero-width characters), base64 runs, and
compressed data (gzip, zlib, bzip2, xz, zstandard) inside base64 or URL escapes. What an
encoded part decodes to is a new layer; every layer is scanned again, until no layer gives a
new one. A layer that covers the same characters of the base text with the same content as
one seen before is not entered again, so cycles end. Spans found in a layer are mapped back,
layer by layer, to the characters of the base text that encode them.

Kinds: ``assign``, ``access``, ``hex``; see PATTERNS. Base spans are those of layer 0.

A base64 run may stand behind a path, a slug or letters that belong to the alphabet too, so it is decoded from each
of its first four characters, and compressed data is looked for at any of them. Bytes that are no text are kept beside
those that are, so a layer is entered if part of it can be read, as UTF-8 or UTF-16.
All members of compressed data are read. What unpacks to more than ``window`` bytes is worked off as overlapping windows,
each a layer of its own; layers are entered depth first, so no more than a window for each depth is held.

Only a text with something to decode or to report leaves the vectorised first look, which
works on the bytes of many texts at once.

Defined results. Null text counts as empty. A text without findings has empty spans, and
the digest of the empty text. Ids are passed through, null and repeated ones too; other
columns are not read. An empty table gives an empty result. Counted in n_refused, and not read to the end: compressed data that
asks for more than 128 MB to unpack, or that unpacks to more than ``most`` bytes: a bomb must not take the executor.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, slices, text_buffer

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),  # runs are taken whole, so this is [0-9a-f]+ of 24 or more
}
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_refused bigint"

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|(\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|([\uFF01-\uFF5E])|([\u200B-\u200D\u2060\uFEFF\u00AD])")
#: At least as long as the shortest thing to find, encoded: 'token=abcdef' in base64.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: What may stand between two lines of one run: a line end, also written out, then an indent or the marks of a quotation.
BETWEEN = r"(?:\r?\n|\\r\\n|\\n)[ \t]*+(?:>[ \t]*+)*+"
SEPARATOR = re.compile(BETWEEN)
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}+(?:{BETWEEN}[A-Za-z0-9+/_-]++)++={{0,2}}")
CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
#: As long as the shortest thing to find: 'token=abcdef'.
STRETCH = re.compile(rb"[\t\n\r\x20-\x7E]{12}")
WIDE = {"utf-16-le": re.compile(rb"(?:[\t\n\r\x20-\x7E]\x00){12}"), "utf-16-be": re.compile(rb"(?:\x00[\t\n\r\x20-\x7E]){12}")}
MAGIC = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"(\xb5/\xfd", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda")
#: How data with one of these begins in base64.
PACKED = re.compile(r"H4sI|Qlpo|[/_]Td6|KLUv|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])")
MEMORY = 1 << 27

Span = tuple[int, int]
Map = Callable[[int, int], Span]


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    for m in PATTERNS["assign"].finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in PATTERNS["access"].finditer(text):
            if m.end() - m.start() >= 20:
                yield "access", m.start(), m.end()
    for m in PATTERNS["hex"].finditer(text):
        yield "hex", m.start(), m.end()


class Refused(Exception):
    pass


def opened(data: bytes):
    """A decompressor of one member; zstandard has its own way."""
    if data.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if data.startswith(b"\xfd7zXZ\x00"):
        return lzma.LZMADecompressor(memlimit=MEMORY)
    return zlib.decompressobj(47)


#: Bytes of compressed data, and of its output, that are worked off at once.
FEED, PIECE = 1 << 14, 1 << 20
DAMAGE = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)


def decompressed(data: bytes) -> Iterator[bytes]:
    """What compressed data holds, piece by piece, all members of it; up to where it is damaged. Raises Refused if it asks for too much memory."""
    at = 0
    try:
        while data[at : at + 6].startswith(MAGIC):
            if data[at : at + 4] == b"(\xb5/\xfd":
                reader = zstandard.ZstdDecompressor(max_window_size=MEMORY).stream_reader(data[at:], read_across_frames=True)
                while out := reader.read(PIECE):
                    yield out
                return
            member = opened(data[at : at + 6])
            while at < len(data) and not member.eof:
                part = data[at : at + FEED]
                at += len(part)
                yield from bounded(member, part)
            if not member.eof:
                return
            at -= len(member.unused_data)
    except DAMAGE as e:
        if "emory" in str(e):
            raise Refused from None


def bounded(member, part: bytes) -> Iterator[bytes]:
    """The output of a part, at most PIECE at a time."""
    is_zlib = hasattr(member, "unconsumed_tail")
    while True:
        out = member.decompress(part, PIECE)
        yield out
        part = member.unconsumed_tail if is_zlib else b""
        if member.eof or not part and len(out) < PIECE:
            return


def windows(data: bytes, window: int, most: int, overlap: int = 1 << 20) -> Iterator[bytes]:
    """The output of decompressed(), whole if it fits a window, else as overlapping windows."""
    held, size, total, fresh = [], 0, 0, False
    for out in decompressed(data):
        held.append(out)
        size, total, fresh = size + len(out), total + len(out), fresh or bool(out)
        if total > most:
            raise Refused
        if size >= window:
            whole = b"".join(held)
            yield whole
            held, fresh = [whole[-overlap:]], False
            size = len(held[0])
    if fresh:
        yield b"".join(held)


def readable(data: bytes) -> tuple[str, str] | None:
    """The text that bytes hold, and its encoding; bytes that are no text stand for themselves. None if there is no stretch of text in them."""
    try:
        text = data.decode()
        if text and not CONTROL.search(text):
            return text, "utf-8"
    except UnicodeDecodeError:
        pass
    if STRETCH.search(data):
        return data.decode("utf-8", "surrogateescape"), "utf-8"
    for name, pattern in WIDE.items():
        if m := pattern.search(data):
            shift = m.start() % 2
            return "\udc80" * shift + data[shift : len(data) - (len(data) - shift) % 2].decode(name, "replace"), name
    return None


def octets_before(inner: str, encoding: str) -> np.ndarray:
    """How many bytes of a layer stand before each of its characters, and in all."""
    c = np.frombuffer(inner.encode("utf-32-le", "surrogatepass"), "<u4")
    alone = (c >= 0xDC80) & (c <= 0xDCFF)  # a byte that is no text
    if encoding == "utf-8":
        width = np.where(alone, 1, 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000))
    else:
        width = np.where(alone, 1, 2 + 2 * (c >= 0x10000))
    return np.concatenate([[0], np.cumsum(width)])


def unbase64(run: str) -> bytes | None:
    """The bytes of a run of the alphabet, an incomplete end left out."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        run = run[:-1]
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


Piece = tuple[str, int, int]


def replaced(text: str, pattern: re.Pattern, decode: Callable[[re.Match], list[Piece]]) -> tuple[str, Map] | None:
    """text with all that decode gives put in, and the map back."""
    parts, to, size, marks = [], 0, 0, []
    for m in pattern.finditer(text):
        for new, start, end in decode(m):
            parts += [text[to:start], new]
            size += start - to
            marks.append((size, size + len(new), start, end))
            size, to = size + len(new), end
    if not marks:
        return None
    parts.append(text[to:])
    starts = [x[0] for x in marks]

    def back(at: int, end: bool) -> int:
        k = bisect.bisect_right(starts, at - end) - 1
        if k < 0:
            return at
        _, new_end, old_start, old_end = marks[k]
        if at - end < new_end:  # inside what was decoded: all of the escape
            return old_end if end else old_start
        return old_end + at - new_end

    return "".join(parts), lambda a, b: (back(a, False), max(back(b, True), back(a, False)))


def from_url(m: re.Match) -> list[Piece]:
    """A piece for each character that a run of escapes spells in UTF-8; other bytes stay as they are."""
    out, at = [], m.start()
    for c in bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape"):
        end = at + 3 * len(c.encode("utf-8", "surrogateescape"))
        if not "\udc80" <= c <= "\udcff" and not CONTROL.match(c):
            out.append((c, at, end))
        at = end
    return out


def from_escape(m: re.Match) -> list[Piece]:
    brace, unit, long, short, decimal, hexadecimal, wide, hidden = m.groups()
    if hidden:
        new = ""
    elif wide:
        new = chr(ord(wide) - 0xFEE0)
    elif unit:
        new = bytes.fromhex(unit.replace("\\u", "")).decode("utf-16-be", "ignore")
        if not new:
            return []
    else:
        code = int(decimal) if decimal else int(brace or long or short or hexadecimal, 16)
        if code >= 0x110000 or 0xD800 <= code < 0xE000:
            return []
        new = chr(code)
    return [(new, m.start(), m.end())]


def layers_of(text: str, window: int, most: int) -> Iterator[tuple[str, Map] | None]:
    """The layers that stand in text, each with the map from its characters to those of text; None for one refused."""
    if "%" in text:
        if new := replaced(text, URL, from_url):
            yield new
        for m in URL.finditer(text):
            data = bytes.fromhex(m.group().replace("%", ""))
            if data.startswith(MAGIC):
                yield from packed_layers(data, m.start(), m.end(), window, most)
    if new := replaced(text, ESCAPE, from_escape):
        yield new
    for pattern in (BASE64, WRAPPED):
        for m in pattern.finditer(text):
            run, places = m.group(), None
            if pattern is WRAPPED:
                run, places = unwrapped(run)
                if len(run) < 16:
                    continue
            for p in PACKED.finditer(run):
                # Chance finds are many in long runs: the first bytes must unpack.
                head = unbase64(run[p.start() : p.start() + 400])
                if head and head.startswith(MAGIC) and unpacks(head):
                    start = m.start() + (p.start() if places is None else places[p.start()])
                    yield from packed_layers(unbase64(run[p.start() :]) or b"", start, m.end(), window, most)
            for phase in range(4):
                data = unbase64(run[phase:])
                if data and (found := readable(data)) is not None:
                    yield found[0], base64_map(*found, m.start(), run, phase, places)


def unwrapped(lines: str) -> tuple[str, list[int]]:
    """A run of several lines as one, and where each of its characters stands."""
    places, at = [], 0
    for m in SEPARATOR.finditer(lines):
        places += range(at, m.start())
        at = m.end()
    places += range(at, len(lines))
    return SEPARATOR.sub("", lines), places


def unpacks(head: bytes) -> bool:
    """Whether data that begins so is compressed."""
    if head.startswith(b"(\xb5/\xfd"):
        return True
    try:
        opened(head).decompress(head, PIECE)
    except DAMAGE as e:
        return "emory" in str(e)
    return True


def packed_layers(data: bytes, start: int, end: int, window: int, most: int, outer: tuple[bytes, ...] = ()) -> Iterator[tuple[str, Map] | None]:
    """The layers of compressed data, under any number of compressed layers; None for one refused. outer: digests of the layers it lies in, which end cycles."""
    outer = (*outer, hashlib.sha256(data).digest())
    try:
        for k, inner in enumerate(windows(data, window, most)):
            if inner.startswith(MAGIC) and not k:
                if len(inner) >= window or len(outer) > 100:
                    yield None  # compressed data of this size within compressed data is not read to its end
                if len(outer) <= 100 and hashlib.sha256(inner).digest() not in outer:
                    yield from packed_layers(inner, start, end, window, most, outer)
            if (found := readable(inner)) is not None:
                yield found[0], lambda a, b: (start, end)
    except Refused:
        yield None


def base64_map(inner: str, encoding: str, begin: int, run: str, phase: int, places: list[int] | None) -> Map:
    size, octets = len(run.rstrip("=")), []

    def back(a: int, b: int) -> Span:
        if encoding != "utf-8" or not inner.isascii():
            if not octets:
                octets.append(octets_before(inner, encoding))
            a, b = int(octets[0][a]), int(octets[0][b])
        first, last = phase + a // 3 * 4, min(phase + -(-b // 3) * 4, size) - 1
        if places is not None:
            first, last = places[first], places[last]
        return begin + first, begin + last + 1

    return back


def find(text: str, window: int = 1 << 24, most: int = 1 << 33) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, int]:
    """Base spans, all spans (both in order), layers entered, layers refused."""
    base = sorted(scan(text), key=order)
    found, seen, refused = set(base), set(), 0
    work: list[tuple[Iterator, list[Map]]] = [(layers_of(text, window, most), [])]
    while work:
        layers, maps = work[-1]
        new = next(layers, False)
        if new is False:
            work.pop()
            continue
        if new is None:
            refused += 1
            continue
        inner, back = new
        chain = [back, *maps]
        key = (through(chain, 0, len(inner)), hashlib.sha256(inner.encode("utf-8", "surrogatepass")).digest())
        if inner == text or key in seen:
            continue
        seen.add(key)
        found.update((kind, *through(chain, a, b)) for kind, a, b in scan(inner))
        work.append((layers_of(inner, window, most), chain))
    return base, sorted(found, key=order), len(seen), refused


def through(maps: list[Map], a: int, b: int) -> Span:
    for m in maps:
        a, b = m(a, b)
    return a, b


def order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RUN = np.zeros(256, bool)
RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
HEX_RUN = re.compile(rb"[0-9a-f]{24}")
#: Bytes without which no other look is needed: names of assignments, escapes, full-width and zero-width characters.
SIGNS = re.compile(rb"%[0-9a-f]{2}|\\[ux][0-9a-f{]|&#|\xef\xbc|\xef\xbd|\xe2\x80[\x8b-\x8d]|\xe2\x81\xa0|\xef\xbb\xbf|\xc2\xad")
NAMES = (b"passw", b"secret", b"token", b"api")
FIRSTS = (b"%", b"\\", b"&#", b"\xef", b"\xe2\x80", b"\xe2\x81", b"\xc2\xad")


def decodes(run: str) -> bool:
    if PACKED.search(run):
        return True
    for phase in range(4):
        data = unbase64(run[phase:])
        if data and readable(data) is not None:
            return True
    return False


def worth_a_look(raw: np.ndarray, at: np.ndarray) -> list[int]:
    """The texts in which there can be something to find or to decode."""
    data, out = raw.tobytes(), set()
    inside = RUN[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1  # runs end where texts do
    first[heads], last[tails] = inside[heads], inside[tails]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = np.flatnonzero(ends - begins >= 16)
    where = np.searchsorted(at, begins[long], side="right") - 1
    for a, z, d in zip(begins[long].tolist(), ends[long].tolist(), where.tolist(), strict=True):
        run = data[a:z]
        # Long runs may be of a kind that is not looked into here; others say by themselves whether they are worth it.
        if z - a >= 48 or HEX_RUN.search(run) or b"AKIA" in run or decodes(run.decode()):
            out.add(d)
    # Runs that only a line end and what may follow it part: as one, they may be base64 of any width.
    gap = begins[1:] - ends[:-1]
    ender = raw[ends[:-1]] if len(ends) > 1 else raw[:0]
    near = (ends[:-1] - begins[:-1] >= 1) & (gap <= 64) & ((ender == 10) | (ender == 13) | (ender == 92))
    near &= np.searchsorted(at, begins[1:], side="right") == np.searchsorted(at, begins[:-1], side="right")
    first_of = np.flatnonzero(near & ~np.concatenate([[False], near[:-1]]))
    for k in first_of.tolist():
        d = int(np.searchsorted(at, begins[k], side="right")) - 1
        if d not in out:
            stop = k + 1
            while stop < len(near) and near[stop]:
                stop += 1
            lines = data[begins[k] : ends[stop]].decode("utf-8", "replace")
            if any(len(run := unwrapped(m.group())[0]) >= 16 and decodes(run) for m in WRAPPED.finditer(lines)):
                out.add(d)
    lower, bounds = data.lower(), at.tolist()
    names = [n for n in NAMES if n in lower]
    firsts = [n for n in FIRSTS if n in lower]
    if names or firsts:
        for d, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if d in out:
                continue
            part = lower[a:z]
            if any(n in part for n in names) or (any(n in part for n in firsts) and SIGNS.search(part)):
                out.add(d)
    return sorted(d for d in out if d < len(bounds) - 1)


NOTHING = hashlib.sha256(b"").hexdigest()


class Scan:
    def __init__(self, window: int, most: int):
        self.window, self.most = window, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                yield self.one(b)

    def one(self, b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        counts, digest, spans, layers, refused = np.zeros((3, n), np.int64), [NOTHING] * n, [""] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d in worth_a_look(*text_buffer(b.column("text"))):
            base, found, layers[d], refused[d] = find(b.column("text")[d].as_py() or "", self.window, self.most)
            for kind, _, _ in base:
                counts[KINDS.index(kind), d] += 1
            digest[d], spans[d] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)
        arrays = [b.column("doc_id"), *map(pa.array, counts), pa.array(digest), pa.array(spans), pa.array(layers), pa.array(refused)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_refused"])


def secret_scan(docs: DataFrame, window: int = 1 << 24, most: int = 1 << 33) -> DataFrame:
    """docs: doc_id, text. One row each: counts and digest of the base spans, all spans, layers entered and refused."""
    return map_batches(docs.select("doc_id", "text"), Scan(window, most), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
