"""JSON bodies: strict parsing, leaves as columns, attachments, and putting changed leaves back.

Parsing and writing JSON need Python (no built-in refuses repeated keys or keeps the order of keys), in
small Arrow maps; everything between them, scanning above all, is columns. A leaf is known by its place in the
order of the walk, so it does not matter what keys hold. Nothing is joined or shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import empty
from ..sources.rules import DEFAULT_RULES, scanner_of
from . import attachments
from .parts import BOUNDARY, LIMIT
from .scan import FINDING, Rules, scan
from .spans import SPAN, merged_array, redact

# Limits of a body, and properties whose text is looked at but never rewritten.
MAX_DEPTH, MAX_FINDINGS = 64, 10_000
CONTROL = ("model", "role", "type", "id", "call_id", "name", "prompt_cache_key", "promptCacheKey")
LEAF = "struct<pos:int,kind:string,key:string,path:string,text:string>"
WHOLE = "struct<whole:string,pieces:array<struct<pos:int,start:int,end:int>>>"
FILE = "struct<digest:string,text:string,error:string>"


def no_repeats(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key is repeated")
    return out


def finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("a number is out of range")
    return value


def refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def parse(text: str):
    """The value of a JSON text. Repeated keys, numbers that are not finite, half characters and trailing text are errors."""
    value = json.loads(text, object_pairs_hook=no_repeats, parse_float=finite, parse_constant=refuse)
    if re.search(r"\\u[dD][89a-fA-F]", text):
        written(value).encode()  # half a character is a UnicodeEncodeError, and so a ValueError
    return value


def inner(text: str):
    """The value of a text that is JSON itself (an object or array), else None."""
    if text.lstrip()[:1] in ("{", "["):
        try:
            return parse(text)
        except (ValueError, RecursionError):
            return None
    return None


def written(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class Failed(Exception):
    """What keeps a body from being inspected."""


def step_of(key: str) -> str:
    """A key as a step of a path, told from all others."""
    return f".{key}" if re.fullmatch(r"[A-Za-z0-9_/-]+", key) else f"[{json.dumps(key, ensure_ascii=False)}]"


class Walk:
    """The leaves of a body in order: (kind, key, path, text), kind key, control, data (an attachment, looked at elsewhere) or text."""

    def __init__(self, value):
        self.leaves: list[tuple[str, str, str, str]] = []
        self.visit(value, "$", 0, "")

    def add(self, kind: str, key: str, path: str, text: str) -> None:
        self.leaves.append((kind, key, path, text))

    def visit(self, value, path: str, depth: int, key: str) -> None:
        if depth > MAX_DEPTH:
            raise Failed("nesting_limit")
        if isinstance(value, dict):
            for k in value:
                self.add("key", k, path + step_of(k), k)
            for k, v in value.items():
                if k == "file_data" and isinstance(v, str):
                    self.add("data", k, path + step_of(k), v)
                elif k in CONTROL and isinstance(v, str):
                    self.add("control", k, path + step_of(k), v)
                else:
                    self.visit(v, path + step_of(k), depth + 1, k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                self.visit(v, f"{path}[{i}]", depth + 1, key)
        elif isinstance(value, str):
            if value.startswith("data:"):
                self.add("data", key, path, value)
            elif (own_value := inner(value)) is not None:
                self.visit(own_value, path + "!", depth + 1, key)
            else:
                self.add("text", key, path, value)


class Parts:
    """The arrays of a value that hold texts in parts, in the order of the walk, and what is left of the value once their texts are cut.

    An element's text takes part as it stands, whatever it is: JSON and data URLs too. cuts: for each array, of each text's spans (start, end, rule) in bytes;
    None: nothing is cut. within: only arrays in strings with such paths count; None: all."""

    def __init__(self, value, cuts: list[list[list]] | None = None, within: set[str] | None = None):
        self.arrays: list[list[str | None]] = []
        self.cuts, self.within = cuts, within
        self.cut_paths: list[str] = []
        self.rules: list[str] = []
        self.value = self.visit(value, "$", 0, within is None)

    def visit(self, v, path: str, depth: int, counts: bool):
        if depth > MAX_DEPTH:
            raise Failed("nesting_limit")
        if isinstance(v, dict):
            return {k: x if isinstance(x, str) and (k == "file_data" or k in CONTROL) else self.visit(x, path + step_of(k), depth + 1, counts) for k, x in v.items()}
        if isinstance(v, list):
            texts = [x["text"] if isinstance(x, dict) and isinstance(x.get("text"), str) else None for x in v]
            spans: list[list] = [[]] * len(v)
            if counts and any(t is not None for t in texts):
                if self.cuts is not None:
                    spans = self.cuts[len(self.arrays)]
                self.arrays.append(texts)
            out = []
            for i, (x, own) in enumerate(zip(v, spans, strict=True)):
                now = self.visit(x, f"{path}[{i}]", depth + 1, counts)  # also where it is cut: arrays in it have been counted
                if own:
                    now = {**now, "text": cut(x["text"], own)}
                    self.cut_paths.append(f"{path}[{i}].text")
                    self.rules += [r for _, _, r in own]
                out.append(now)
            return out
        if isinstance(v, str) and not v.startswith("data:") and (own := inner(v)) is not None:
            now = self.visit(own, path + "!", depth + 1, counts or path in (self.within or ()))
            return v if now == own else written(now)
        return v

    def wholes(self) -> list[dict]:
        """Texts in parts as one: joined by line ends, once there is text; other elements put a boundary there. pos: the place in the array."""
        out = []
        for texts in self.arrays:
            pieces, parts, size = [], [], 0
            for pos, t in enumerate(texts):
                lead = (BOUNDARY if t is None else "\n") if size else ""
                start = size + len(lead)
                size = start + len((t or "").encode())
                parts += [lead, t or ""]
                if t is not None:
                    pieces.append({"pos": pos, "start": start, "end": size})
            if size > LIMIT:
                raise Failed("reconstruction_limit")
            out.append({"whole": "".join(parts), "pieces": pieces})
        return out


def cut(text: str, spans: list[tuple[int, int, str]]) -> str:
    octets = text.encode()
    for start, end, rule in reversed(spans):
        octets = octets[:start] + f"[REDACTED:{rule}]".encode() + octets[end:]
    return octets.decode("utf-8", "replace")


def clipped(wholes: list[dict], found: list[list[dict]], sizes: list[int]) -> list[list[list]]:
    """Merged spans of each whole, clipped to its texts: for each array, of each element (start, end, rule) in order."""
    out = []
    for w, islands, n in zip(wholes, found, sizes, strict=True):
        own: list[list] = [[] for _ in range(n)]
        for p in w["pieces"]:
            own[p["pos"]] = sorted((max(s["start"], p["start"]) - p["start"], min(s["end"], p["end"]) - p["start"], s["rule"]) for s in islands if s["start"] < p["end"] and s["end"] > p["start"])
        out.append(own)
    return out


def strict_base64(text: str) -> bytes:
    try:
        out = base64.b64decode(text, validate=True)
    except (binascii.Error, ValueError):
        raise Failed("bad_base64") from None
    if base64.b64encode(out).decode() != text:
        raise Failed("bad_base64")
    return out


def files(value, key: str = "", depth: int = 0, out: list[bytes] | None = None) -> list[bytes]:
    """The attachments that a body holds. What can't be looked at fails: references, other encodings, media."""
    out = [] if out is None else out
    if depth > MAX_DEPTH:
        raise Failed("nesting_limit")
    if isinstance(value, dict):
        if "file_id" in value or "file_url" in value:
            raise Failed("unresolved_reference")
        kind = value.get("type")
        if key == "image_url" or kind in ("input_image", "image_url"):
            if any(isinstance(value.get(k), str) and not value[k].startswith("data:") for k in ("url", "image_url")):
                raise Failed("remote_reference")
        if isinstance(kind, str) and kind in attachments.MEDIA_TYPES_REFUSED:
            raise Failed("unsupported_media")
        for k, v in value.items():
            files(v, k, depth + 1, out)
    elif isinstance(value, list):
        for v in value:
            files(v, key, depth + 1, out)
    elif isinstance(value, str):
        if (own := inner(value)) is not None:
            files(own, key, depth + 1, out)
        if value.startswith("data:"):
            head, comma, data = value.partition(",")
            if not comma:
                raise Failed("bad_data_url")
            if not head.endswith(";base64"):
                raise Failed("unsupported_encoding")
            out.append(strict_base64(data))
        elif key == "file_data":
            out.append(strict_base64(value))
        elif key in ("image_url", "image", "data") and value.startswith(("https:", "http:")):
            raise Failed("remote_reference")
    return out


def file_row(content: bytes) -> dict:
    text = attachments.text_of(content)
    error = "too_large" if len(content) > attachments.MAX_BYTES else "unsupported" if text is None else None
    return {"digest": attachments.digest_of(content), "text": None if error else text, "error": error}


def guarded(f, *args):
    """f of a body; what is too deep fails."""
    try:
        return f(*args)
    except RecursionError:
        raise Failed("nesting_limit") from None


def body_of(body: str) -> dict:
    try:
        value = guarded(parse, body)
    except ValueError:
        raise Failed("bad_json") from None
    if not isinstance(value, dict):
        raise Failed("bad_json")
    return value


def looked_into(value: dict) -> tuple[list[dict], list[dict]]:
    """Leaves and attachments of a body."""
    found = files(value)
    if len(found) > attachments.MAX_COUNT or sum(map(len, found)) > attachments.MAX_TOTAL:
        raise Failed("attachment_limit")
    rows = [file_row(c) for c in found]
    if bad := next((r["error"] for r in rows if r["error"]), None):
        raise Failed(bad)
    return [{"pos": k, "kind": x[0], "key": x[1], "path": x[2], "text": x[3]} for k, x in enumerate(Walk(value).leaves)], rows


def clean(text: str) -> str:
    """Escapes of JSON can name half a character, which no column can hold: its place is kept by a sign of as many bytes."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return re.sub("[\ud800-\udfff]", "�", text)


class Join:
    """Adds wholes (texts in parts as one) to the rows of bodies; a body whose row has an error already is not looked into."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            error, wholes = b.column("error").to_pylist(), []
            for k, body in enumerate(b.column("body").to_pylist()):
                own = []
                if error[k] is None:
                    try:
                        own = guarded(Parts, body_of(body or "")).wholes()
                    except Failed as e:
                        error[k] = str(e)
                wholes.append(own)
            yield replaced(b, {"error": pa.array(error, pa.string()), "wholes": pa.array(wholes, WHOLES_TYPE)})


class Cut:
    """Takes what spans texts in parts out of each. Columns: body as it is then, cuts (the rule of each), and wholes of arrays that lie in texts which were cut, as they read now."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            bodies, error, cuts, wholes = (b.column(c).to_pylist() for c in ("body", "error", "cuts", "wholes"))
            for k, found in enumerate(b.column("whole_spans").to_pylist()):
                own, wholes[k] = wholes[k], []
                if error[k] is not None or not any(found):
                    continue
                try:
                    value = body_of(bodies[k])
                    done = Parts(value, clipped(own, found, [len(x) for x in Parts(value).arrays]))
                    bodies[k], cuts[k] = written(done.value), done.rules
                    wholes[k] = guarded(Parts, body_of(bodies[k]), None, set(done.cut_paths)).wholes()
                except Failed as e:
                    error[k] = str(e)
            now = {"body": pa.array(bodies, pa.string()), "error": pa.array(error, pa.string()), "wholes": pa.array(wholes, WHOLES_TYPE), "cuts": pa.array(cuts, pa.list_(pa.string()))}
            yield replaced(b, now, "whole_spans")


class Look:
    """Adds leaves and files to the rows of bodies without an error."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            error, leaves, found = b.column("error").to_pylist(), [], []
            for k, body in enumerate(b.column("body").to_pylist()):
                own = [], []
                if error[k] is None:
                    try:
                        own = guarded(looked_into, body_of(body or ""))
                    except Failed as e:
                        error[k] = str(e)
                leaves.append(own[0])
                found.append(own[1])
            yield replaced(b, {"error": pa.array(error, pa.string()), "leaves": pa.array(leaves, LEAVES_TYPE), "files": pa.array(found, FILES_TYPE)})


def few(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def replaced(b: pa.RecordBatch, new: dict[str, pa.Array], *but: str) -> pa.RecordBatch:
    """b with new columns at the end, in place of those of the same name, and without others."""
    names = [n for n in b.schema.names if n not in new and n not in but]
    return pa.RecordBatch.from_arrays([*map(b.column, names), *new.values()], [*names, *new])


LEAVES_TYPE = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("key", pa.string()), ("path", pa.string()), ("text", pa.string())]))
WHOLES_TYPE = pa.list_(pa.struct([("whole", pa.string()), ("pieces", pa.list_(pa.struct([("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))]))
FILES_TYPE = pa.list_(pa.struct([("digest", pa.string()), ("text", pa.string()), ("error", pa.string())]))


def schema_of(df: DataFrame, *but: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in but)


def with_wholes(requests: DataFrame) -> DataFrame:
    """requests: request_id, body, and perhaps error and original (the body as it came), which stay. request_id, original, body, error, wholes (texts in parts as one).

    Errors: bad_json, nesting_limit, reconstruction_limit."""
    error = F.col("error").cast("string") if "error" in requests.columns else F.lit(None).cast("string")
    original = "original" if "original" in requests.columns else "body"
    rows = requests.select("request_id", F.col(original).cast("string").alias("original"), F.col("body").cast("string").alias("body"), error.alias("error"))
    return rows.mapInArrow(Join(), f"{schema_of(rows, 'error')}, error string, wholes array<{WHOLE}>")


def with_leaves(rows: DataFrame) -> DataFrame:
    """rows: body, error and others. Adds leaves and files (attachments).

    Errors: as above, and of attachments unresolved_reference, remote_reference, unsupported_media, bad_data_url, unsupported_encoding, bad_base64,
    attachment_limit, too_large, unsupported."""
    return rows.mapInArrow(Look(), f"{schema_of(rows, 'error')}, error string, leaves array<{LEAF}>, files array<{FILE}>")


def rebuilt(value, new: dict[int, str], swaps: dict[str, bytes]):
    """value with the texts of new (by their places in the walk) put in, and attachments of swaps (by digest) replaced; and whether anything changed."""
    place = -1

    def attachment(text: str) -> str:
        head, comma, data = text.partition(",") if text.startswith("data:") else ("", "", text)
        try:
            content = swaps.get(attachments.digest_of(strict_base64(data))) if swaps else None
        except Failed:
            content = None
        if content is None:
            return text
        return attachments.data_url_of(content) if comma else base64.b64encode(content).decode()

    def visit(v):
        nonlocal place
        if isinstance(v, dict):
            place += len(v)
            out = {}
            for k, x in v.items():
                if k == "file_data" and isinstance(x, str):
                    place += 1
                    out[k] = attachment(x)
                elif k in CONTROL and isinstance(x, str):
                    place += 1
                    out[k] = attachment(x)
                else:
                    out[k] = visit(x)
            return out
        if isinstance(v, list):
            return [visit(x) for x in v]
        if not isinstance(v, str):
            return v
        if v.startswith("data:"):
            place += 1
            return attachment(v)
        if (own := inner(v)) is not None:
            now = visit(own)
            return v if now == own else written(now)
        place += 1
        return new.get(place, attachment(v))

    return visit(value)


class Rebuild:
    """Writes changed bodies again; all others stay as they are, byte by byte."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = []
            for body, new, swaps in zip(b.column("body").to_pylist(), b.column("new").to_pylist(), b.column("swaps").to_pylist(), strict=True):
                if not new and not swaps:
                    bodies.append(body)
                    continue
                swap = {s["digest"]: s["text"].encode() for s in swaps or ()}
                bodies.append(clean(written(rebuilt(parse(body), {x["pos"]: x["text"] for x in new or ()}, swap))))
            names = [n for n in b.schema.names if n not in ("new", "swaps")]
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.string()) if n == "body" else b.column(n) for n in names], names)


def inspect(requests: DataFrame, rules: Rules = DEFAULT_RULES, sanitize: bool = True) -> DataFrame:
    """requests: request_id, body, and perhaps error and original (see materialize()). request_id, original (the body as it came), body (redacted; untouched if nothing changed), error, rules (one for each finding), changed, unsafe.

    Attachments are decoded and scanned: a text with findings is replaced (if sanitize), and the new one scanned again; what can't be read is an error (see
    with_leaves()). Texts in the parts of an array are first read as one, JSON and data URLs among them as they stand, and what spans them is cut from each, also in arrays within
    texts that are JSON; then every leaf of what is left is scanned by itself. A text that was cut, and is JSON with an array over whose parts another finding goes: nesting_limit. Findings in keys and control fields, and in attachments that are not replaced, are unsafe: reported, but not rewritten.
    """
    s = scanner_of(rules)
    rows = with_wholes(requests).select("request_id", "original", "body", "error", (~F.col("original").eqNullSafe(F.col("body"))).alias("put_in"), "wholes", empty("array<string>").alias("cuts"))
    rows = rows.withColumn("whole_spans", F.transform("wholes", lambda w: merged_array(scan(w["whole"], s))))
    new = ("body", "error", "wholes", "cuts", "whole_spans")
    rows = rows.mapInArrow(Cut(), f"{schema_of(rows, *new)}, body string, error string, wholes array<{WHOLE}>, cuts array<string>")
    # Leaves, attachments, and what is left of arrays in texts that were cut are scanned by one expression.
    piece = lambda place, kind, digest, text: F.struct(place.alias("pos"), kind.alias("kind"), digest.alias("digest"), text.alias("text"))
    blank = F.lit(None).cast("string")
    texts = F.concat(
        F.transform(F.filter("leaves", lambda x: x["kind"] != "data"), lambda x: piece(x["pos"], x["kind"], blank, x["text"])),
        F.transform("files", lambda f: piece(F.lit(None).cast("int"), F.lit("file"), f["digest"], f["text"])), F.transform("wholes", lambda w: piece(F.lit(None).cast("int"), F.lit("whole"), blank, w["whole"])),
    )
    rows = with_leaves(rows).select("request_id", "original", "body", "error", "put_in", "cuts", texts.alias("texts"))
    found = F.transform("texts", lambda x: F.struct(x["pos"].alias("pos"), x["kind"].alias("kind"), x["digest"].alias("digest"), x["text"].alias("text"), scan(x["text"], s).alias("found")))
    rows = rows.withColumn("hits", F.filter(found, lambda x: F.size(x["found"]) > 0)).drop("texts")
    rows = rows.withColumn("seen", F.filter("hits", lambda x: x["kind"] == "file"))
    swaps = F.transform("seen", lambda f: F.named_struct(F.lit("digest"), f["digest"], F.lit("text"), redact(f["text"], f["found"]))) if sanitize else empty("array<struct<digest:string,text:string>>")
    rows = rows.withColumn("swaps", swaps)
    of = lambda c: F.flatten(F.transform(c, lambda x: F.transform(x["found"], lambda f: f["rule"])))
    all_rules = F.concat(F.col("cuts"), of(F.filter("hits", lambda x: x["kind"] != "whole")))
    texts = F.filter("hits", lambda x: x["kind"] == "text")
    unsafe = F.exists("hits", lambda x: x["kind"].isin("key", "control")) | (F.lit(not sanitize) & (F.size("seen") > 0))
    new = F.transform(texts, lambda x: F.named_struct(F.lit("pos"), x["pos"], F.lit("text"), redact(x["text"], x["found"])))
    dirty = F.exists("swaps", lambda w: F.size(scan(w["text"], s)) > 0)
    error = F.coalesce(F.col("error"), F.when(F.size(all_rules) > MAX_FINDINGS, F.lit("finding_limit")), F.when(dirty, F.lit("not_clean")), F.when(F.exists("hits", lambda x: x["kind"] == "whole"), F.lit("nesting_limit")))
    rows = rows.select("request_id", "original", "body", error.alias("error"), all_rules.alias("rules"), (F.col("put_in") | (F.size("cuts") > 0) | (F.size(texts) > 0) | (F.size("swaps") > 0)).alias("changed"), unsafe.alias("unsafe"), new.alias("new"), "swaps")
    return rows.mapInArrow(Rebuild(), schema_of(rows, "new", "swaps"))


# References ---------------------------------------------------------------------------------

def referred(value, swap=None, out: list[tuple[str, str]] | None = None, depth: int = 0):
    """References in a body, in order: (kind, ref), kind file or url. With swap (ref to bytes, by kind) the value with them put in; JSON in texts included."""
    out = [] if out is None else out
    if depth > MAX_DEPTH:
        raise Failed("nesting_limit")

    def got(kind: str, ref: str) -> str:
        out.append((kind, ref))
        return attachments.data_url_of(swap[kind, ref]) if swap else ""

    if isinstance(value, dict):
        now = dict(value)
        for name, kind in (("file_id", "file"), ("file_url", "url")):
            if isinstance(now.get(name), str):
                url = got(kind, now.pop(name))
                now["file_data"] = url
                if swap:
                    now.setdefault("filename", attachments.file_name_of(swap[out[-1]]))
        fresh = {}
        for k, v in now.items():
            if k == "image_url" and isinstance(v, str) and v.startswith(("https://", "http://")):
                fresh[k] = got("url", v)
                continue
            if k == "image_url" and isinstance(v, dict) and isinstance(v.get("url"), str) and v["url"].startswith(("https://", "http://")):
                v = {**v, "url": got("url", v["url"])}
            fresh[k] = referred(v, swap, out, depth + 1)[0]
        return fresh, out
    if isinstance(value, list):
        return [referred(v, swap, out, depth + 1)[0] for v in value], out
    if isinstance(value, str) and (own := inner(value)) is not None:
        before = len(out)
        now, _ = referred(own, swap, out, depth + 1)
        return (written(now) if len(out) > before else value), out
    return value, out


class Refer:
    """refs of each body; null where it can't be parsed (which inspect() reports)."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs = []
            for body, error in zip(b.column("body").to_pylist(), b.column("error").to_pylist(), strict=True):
                try:
                    refs.append([{"kind": k, "ref": clean(r)} for k, r in referred(parse(body or ""))[1]] if error is None else None)
                except (ValueError, RecursionError, Failed):
                    refs.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(refs, REFS_TYPE)], [*b.schema.names, "refs"])


REFS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string())]))


class PutIn:
    """Bodies with the bytes of their references."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = []
            for body, have in zip(b.column("body").to_pylist(), b.column("have").to_pylist(), strict=True):
                swap = {(h["kind"], h["ref"]): bytes(h["content"]) for h in have or ()}
                bodies.append(clean(written(referred(parse(body), swap)[0])) if swap else body)
            names = [n for n in b.schema.names if n != "have"]
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.string()) if n == "body" else b.column(n) for n in names], names)


def materialize(requests: DataFrame, fetched: DataFrame) -> DataFrame:
    """requests: request_id, body, and perhaps error; fetched: kind (file or url), ref, content. The requests with file ids, file URLs and image URLs replaced by the bytes, as data URLs; original: the body as it came.

    Errors: unresolved_reference (not fetched, or an id that is none), reference_limit. Only bodies within the limits get bytes."""
    error = F.col("error").cast("string") if "error" in requests.columns else F.lit(None).cast("string")
    body = F.col("body").cast("string")
    rows = requests.select(F.monotonically_increasing_id().alias("row"), "request_id", body.alias("original"), body.alias("body"), error.alias("error"))
    rows = attachments.written_out(rows.mapInArrow(Refer(), f"{schema_of(rows)}, refs array<struct<kind:string,ref:string>>"))
    refs = rows.select(F.col("row").alias("request_id"), F.posexplode("refs").alias("pos", "r")).select("request_id", "r.kind", "r.ref")
    valid = (F.col("kind") == "url") | F.col("ref").rlike(r"\A[A-Za-z0-9_-]{1,255}\z")
    budget = attachments.materialized(refs.withColumn("valid", valid), fetched)
    fine = budget.where("error IS NULL").select(F.col("request_id").alias("row"))
    pairs = refs.select(F.col("request_id").alias("row"), "kind", "ref").distinct().join(fine, "row").join(fetched.select("kind", "ref", "content"), ["kind", "ref"])
    have = pairs.groupBy("row").agg(F.collect_list(F.struct("kind", "ref", "content")).alias("have"))  # at most the limits' count and bytes
    bad = budget.where("error IS NOT NULL").select(F.col("request_id").alias("row"), F.col("error").alias("bad"))
    out = rows.drop("refs").join(bad, "row", "left").join(have, "row", "left").withColumn("error", F.coalesce("error", "bad")).drop("row", "bad")
    return out.mapInArrow(PutIn(), schema_of(out, "have"))


# Metadata -----------------------------------------------------------------------------------

def scalars(value, path: str = "$") -> Iterator[tuple[str, str | None]]:
    """Path and text of all that is neither object nor array."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from scalars(v, path + step_of(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from scalars(v, f"{path}[{i}]")
    else:
        yield path, value if value is None or isinstance(value, str) else written(value)


class Scalars:
    def __init__(self, keys: list[str]):
        self.keys = keys

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, body in enumerate(b.column("body").to_pylist()):
                try:
                    found = list(scalars(parse(body))) if body else []
                except (ValueError, RecursionError):
                    continue
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    own = [b.column(c).take(pa.array([k] * len(part), pa.int64())) for c in self.keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([clean(p) for p, _ in part], pa.string()), pa.array([v if v is None else clean(v) for _, v in part], pa.string())], [*self.keys, "path", "value"])


def leaf_rows(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """All scalars of JSON bodies as rows: keys, path, value (as text). Bodies that are no JSON give none."""
    rows = df.select(*keys, F.col(body).cast("string").alias("body"))
    return rows.mapInArrow(Scalars(keys), f"{schema_of(rows, 'body')}, path string, value string")


# Properties of documents' metadata that are not supported.
FORBIDDEN = ("/OpenAction", "/AA", "/OCProperties", "/XFA", "/JS", "/JavaScript", "/RichMediaContent", "/Prev")


def metadata_texts(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Texts in nested metadata: keys, path, text. 'u:' goes; 'b:' and hex give also the bytes' text, if they are UTF-8."""
    rows = leaf_rows(df, keys, body)
    octets = F.when(F.startswith("value", F.lit("b:")), F.try_to_binary(F.substring("value", 3, 1 << 30), F.lit("hex")))
    plain = F.regexp_replace("value", r"\Au:", "")
    return rows.select(*keys, "path", F.explode(F.array_compact(F.array(F.try_validate_utf8(octets.cast("string")), plain))).alias("text"))


def forbidden_metadata(df: DataFrame, keys: list[str], body: str) -> DataFrame:
    """keys and error of those whose metadata has an unsupported property at any depth."""
    names = "|".join(re.escape(k) for k in FORBIDDEN)
    hit = F.col("path").rlike(rf"\.(?:{names})(?:\.|\[|\z)")
    return leaf_rows(df, keys, body).where(hit).select(*keys, F.lit("unsupported_pdf_feature").alias("error")).distinct()
