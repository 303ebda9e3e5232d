"""Attachments: kinds by magic number, data URLs, text attachments, limits, discovery, materialised references."""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_sums
from ..functions.text import from_base64, to_base64
from ..sources.rules import DEFAULT_RULES
from ..sources.shared import saved
from .scan import Rules, scan
from .spans import redact

# Magic numbers, media types and names of the four kinds; limits.
MAGIC = (("pdf", "255044462D"), ("png", "89504E47"), ("jpg", "FFD8FF"))
MEDIA = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "txt": "text/plain"}
MAX_BYTES, MAX_COUNT, MAX_TOTAL = 32 << 20, 16, 64 << 20
MEDIA_TYPES_REFUSED = ("input_audio", "audio", "video", "input_video")


def kind(content: Column) -> Column:
    out = F.lit("txt")
    for name, magic in reversed(MAGIC):
        out = F.when(F.startswith(content, F.unhex(F.lit(magic))), F.lit(name)).otherwise(out)
    return out


def media_type(kind_: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])[kind_]


def data_url(content: Column) -> Column:
    return F.concat(F.lit("data:"), media_type(kind(content)), F.lit(";base64,"), to_base64(content))


def file_name(content: Column) -> Column:
    return F.concat(F.lit("attachment."), kind(content))


#: Control characters but line feed, carriage return and tab.
CONTROLS = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")
MARKS = ((codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def text_of(content: bytes) -> str | None:
    """The text of a text attachment: UTF-16 after a byte order mark (even length, no unpaired surrogate), else strict UTF-8; None if it is of another kind, neither, or holds control characters."""
    if kind_of(content) != "txt":
        return None
    try:
        name = next((n for mark, n in MARKS if content.startswith(mark)), None)
        text = content[2:].decode(name) if name else content.decode()
    except UnicodeDecodeError:
        return None
    return None if CONTROLS.search(text) else text


def kind_of(content: bytes) -> str:
    return next((name for name, magic in MAGIC if content.startswith(bytes.fromhex(magic))), "txt")


def digest_of(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def data_url_of(content: bytes) -> str:
    return f"data:{MEDIA[kind_of(content)]};base64,{base64.b64encode(content).decode()}"


def file_name_of(content: bytes) -> str:
    return "attachment." + kind_of(content)


def written_out(rows: DataFrame) -> DataFrame:
    return saved(rows, "references")


class Texts:
    """Adds the column text to rows with content."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                texts = [None if c is None or len(c) > MAX_BYTES else text_of(c) for c in b.column("content").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])


def with_text(rows: DataFrame) -> DataFrame:
    """rows: content, and other columns but text. Adds text, see text_of(); null also beyond MAX_BYTES."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(Texts(), f"{fields}, text string")


def inspect_texts(attachments: DataFrame, keys: list[str], rules: Rules = DEFAULT_RULES, sanitize: bool = True) -> DataFrame:
    """attachments: keys, content. keys, error, rules (one for each finding), replacement (bytes, if sanitize and something was found).

    Images and PDFs are reported as unsupported: their extraction is no work for this library, and what was not read is never clean.
    """
    rows = with_text(attachments.select(*keys, "content"))
    error = F.when(F.octet_length("content") > MAX_BYTES, F.lit("too_large")).when(F.col("text").isNull(), F.lit("unsupported"))
    rows = rows.select(*keys, error.alias("error"), "text").withColumn("found", scan(F.coalesce("text", F.lit("")), rules))
    new = F.when(F.lit(sanitize) & (F.size("found") > 0), F.encode(redact(F.col("text"), F.col("found")), "UTF-8"))
    return rows.select(*keys, "error", F.transform("found", lambda f: f["rule"]).alias("rules"), new.alias("replacement"))


def discovered(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """leaves: keys, key, text. Those that are attachments or references: keys, source, content, error."""
    text, key = F.col("text"), F.col("key")
    comma = F.instr(text, ",")
    head, tail = F.expr("substring(text, 1, instr(text, ',') - 1)"), F.expr("substring(text, instr(text, ',') + 1)")
    is_url = text.rlike(r"\Ahttps?://")
    source = (
        F.when(key.isin("file_id", "file_url"), F.lit("unresolved"))
        .when(F.startswith(text, F.lit("data:")), F.lit("data"))
        .when(key == "file_data", F.lit("file_data"))
        .when((key == "type") & text.isin(*MEDIA_TYPES_REFUSED), F.lit("media"))
        .when(key.isin("image_url", "image", "data") & is_url, F.lit("remote"))
        .when(key == "image_url", F.lit("image"))
    )
    content = F.when((F.col("source") == "data") & (comma > 0) & F.endswith(head, F.lit(";base64")), from_base64(tail)).when(F.col("source") == "file_data", from_base64(text))
    error = (
        F.when(F.col("source") == "unresolved", F.lit("unresolved_reference")).when(F.col("source") == "media", F.lit("unsupported_media")).when(F.col("source").isin("remote", "image"), F.lit("remote_reference"))
        .when(F.col("content").isNull(), F.lit("bad_base64"))
    )
    rows = leaves.withColumn("source", source).where("source is not null").withColumn("content", content)
    return rows.select(*keys, "source", "content", error.alias("error"))


def within_limits(found: DataFrame, key: str) -> DataFrame:
    """key, attachments, total_bytes, error of each request's attachments (key, content)."""
    sums = found.groupBy(key).agg(F.count("content").alias("attachments"), F.coalesce(F.sum(F.octet_length("content").cast("bigint")), F.lit(0)).alias("total_bytes"))
    return sums.withColumn("error", F.when((F.col("attachments") > MAX_COUNT) | (F.col("total_bytes") > MAX_TOTAL), F.lit("attachment_limit")))


def spliced(leaves: DataFrame, replacements: DataFrame) -> DataFrame:
    """leaves: (..., text); replacements: digest of the old bytes, replacement. Every leaf that holds the old bytes gets the new ones, data URLs with a new media type."""
    payload = F.when(F.startswith("text", F.lit("data:")), F.expr("substring(text, instr(text, ',') + 1)")).otherwise(F.col("text"))
    rows = leaves.withColumn("__digest", F.sha2(from_base64(payload), 256))
    new = F.when(F.startswith("text", F.lit("data:")), data_url(F.col("replacement"))).otherwise(to_base64(F.col("replacement")))
    joined = rows.join(replacements, rows["__digest"] == replacements["digest"], "left")
    return joined.withColumn("text", F.coalesce(new, "text")).select(*leaves.columns)


def materialized(references: DataFrame, fetched: DataFrame) -> DataFrame:
    """references: request_id, kind (url or file), ref, and perhaps valid; fetched: ref, content, and perhaps kind. Whether each request is within budget: request_id, charged, charged_bytes, missing, error.

    A URL is charged once in a request however often it stands there; a file id each time. A reference that is not valid is missing.
    """
    on = ["kind", "ref"] if "kind" in fetched.columns else ["ref"]
    rows = references.join(fetched.select(*on, F.octet_length("content").cast("bigint").alias("size")), on, "left")
    if "valid" in references.columns:
        rows = rows.withColumn("size", F.when(F.col("valid"), F.col("size")))
    urls = rows.where("kind = 'url'").dropDuplicates(["request_id", "ref"])
    charged = urls.unionByName(rows.where("kind = 'file'")).groupBy("request_id").agg(F.count(F.lit(1)).alias("charged"), F.sum("size").alias("charged_bytes"), F.count_if(F.col("size").isNull()).alias("missing"))
    error = F.when(F.col("missing") > 0, F.lit("unresolved_reference")).when((F.col("charged") > MAX_COUNT) | (F.col("charged_bytes") > MAX_TOTAL), F.lit("reference_limit"))
    return charged.withColumn("error", error)


def charged_in_order(references: DataFrame, fetched: DataFrame, count: int = MAX_COUNT, total: int = MAX_TOTAL) -> DataFrame:
    """references: request_id, pos, kind (url or file), ref; fetched: kind, ref, content. Each reference in its request's order: charged, used, used_bytes (up to it), state.

    A URL is charged where it first stands in a request, a file id each time. state: read, known (a URL that was read before), unresolved_reference or
    reference_limit for the one at which the request fails, unread for all after it."""
    size = F.octet_length("content").cast("bigint")
    rows = references.select("request_id", "pos", "kind", "ref").join(fetched.select("kind", "ref", size.alias("size")), ["kind", "ref"], "left")
    first = rows.where("kind = 'url'").groupBy("request_id", "ref").agg(F.min("pos").alias("first"))
    rows = rows.join(first.withColumn("kind", F.lit("url")), ["request_id", "kind", "ref"], "left").withColumn("charged", (F.col("kind") == "file") | (F.col("pos") == F.col("first")))
    rows = rows.withColumns({"one": F.col("charged").cast("bigint"), "bytes": F.when(F.col("charged"), F.col("size"))})
    rows = running_sums(rows, ["request_id"], ["pos"], {"used": "one", "used_bytes": "bytes"})
    error = F.when(F.col("charged") & F.col("size").isNull(), F.lit("unresolved_reference")).when((F.col("used") > count) | (F.col("used_bytes") > total), F.lit("reference_limit"))
    rows = saved(rows.withColumn("error", error), "references")
    fails = rows.where("error IS NOT NULL").groupBy("request_id").agg(F.min("pos").alias("end"))
    state = F.when(F.col("pos") > F.col("end"), F.lit("unread")).otherwise(F.coalesce("error", F.when(F.col("charged"), F.lit("read")).otherwise(F.lit("known"))))
    return rows.join(fails, "request_id", "left").select("request_id", "pos", "kind", "ref", "charged", "used", "used_bytes", state.alias("state"))


def reverified(outcomes: DataFrame, keys: list[str], rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Replacements are scanned once more: one that still holds a finding, or can't be read, is an error, and is dropped."""
    rows = with_text(outcomes.drop("text").withColumnRenamed("replacement", "content"))
    again = F.size(scan(F.coalesce("text", F.lit("")), rules)) > 0
    rows = rows.withColumn("__bad", F.col("content").isNotNull() & (again | F.col("text").isNull()))
    rows = rows.withColumn("error", F.when(F.col("__bad"), F.lit("not_clean")).otherwise(F.col("error")))
    return rows.withColumn("replacement", F.when(~F.col("__bad"), F.col("content"))).select(*outcomes.columns)
