"""Column functions on text and bytes. All are built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import bind

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; unlike lower(), no other letter changes."""
    return F.translate(c, UPPER, LOWER)


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether c, in ASCII lower case, holds any of the words. True for no words."""
    if not words:
        return F.lit(True)
    low, out = ascii_lower(c), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def digest(c: Column) -> Column:
    """SHA-256 in lower-case hex."""
    return F.sha2(c, 256)


def entropy(c: Column) -> Column:
    """Shannon entropy, in bits, of the bytes of c. They are sorted, so that equal ones stand together: a byte's count is how far apart its first and last are."""
    octets = F.array_sort(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), 0))

    def of(sorted_: Column) -> Column:
        n = F.size(sorted_)
        ends = F.filter(F.transform(sorted_, lambda x, i: F.when((i == n - 1) | (F.try_element_at(sorted_, i + 2) != x), i + 1)), lambda e: e.isNotNull())
        return bind(ends, lambda e: F.aggregate(F.transform(e, lambda x, i: (x - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(e, i))) / n.cast("double")), F.lit(0.0), lambda t, share: t - share * F.log2(share)))

    return F.when(F.length(c) > 0, bind(octets, of)).otherwise(F.lit(0.0))


def is_digest(c: Column) -> Column:
    return c.rlike(r"\A[0-9A-Fa-f]{64}\z")


def is_file_id(c: Column) -> Column:
    """File ids of providers: at most 255 characters of A-Z a-z 0-9 _ -."""
    return c.rlike(r"\A[A-Za-z0-9_-]{1,255}\z")


def is_plain_text(c: Column) -> Column:
    """No control character but line feed, carriage return and tab."""
    return ~c.rlike(r"[\p{Cc}&&[^\n\r\t]]")


def from_base64(c: Column) -> Column:
    """Bytes of canonical base64, else null: no white space, full padding, no spare bits."""
    return bind(F.named_struct(F.lit("text"), c, F.lit("bytes"), F.try_to_binary(c, F.lit("base64"))), lambda x: F.when(to_base64(x["bytes"]) == x["text"], x["bytes"]))


def to_base64(c: Column) -> Column:
    """On one line, whether or not the session has spark.sql.chunkBase64String.enabled."""
    return F.translate(F.base64(c), "\r\n", "")


def is_public_ipv4(c: Column) -> Column:
    """Dotted IPv4 outside private, loopback, link-local, shared, documentation, benchmark, multicast, reserved and broadcast blocks."""
    a, b, d = (F.try_element_at(F.split(c, r"\."), F.lit(k)).try_cast("int") for k in (1, 2, 3))
    valid = c.rlike(r"\A(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}\z")
    closed = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19)) | ((a == 192) & (b == 0) & (d == 2)) | ((a == 198) & (b == 51) & (d == 100)) | ((a == 203) & (b == 0) & (d == 113))
    )
    return F.coalesce(valid & ~closed, F.lit(False))


def ipv6_groups(c: Column) -> Column:
    """The eight groups of an IPv6 address, also one written with ::, or with dotted IPv4 at its end, as numbers; null if it is none."""
    dotted = F.regexp_extract(c, r":((?:[0-9]{1,3}\.){3}[0-9]{1,3})\z", 1)
    octet = lambda k: F.try_element_at(F.split(dotted, r"\."), F.lit(k)).try_cast("int")
    tail = F.concat(F.hex(octet(1) * 256 + octet(2)), F.lit(":"), F.hex(octet(3) * 256 + octet(4)))
    fits = (dotted == "") | dotted.rlike(r"\A(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}\z")
    plain = F.when(dotted == "", c).otherwise(F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(dotted)), tail))

    def of(a: Column) -> Column:
        halves = F.split(a, "::", -1)
        side = lambda k: F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(k)), F.lit("")), ":", -1), lambda g: g != "")
        gap = F.lit(8) - F.size(side(1)) - F.size(side(2))
        short = F.contains(a, F.lit("::"))
        shape = a.rlike(r"\A([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?(::([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?)?\z")
        groups = F.concat(side(1), F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), side(2))
        return F.when(shape & F.when(short, gap >= 1).otherwise(gap == 0), F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))

    return F.when(fits, bind(plain, of))


def is_public_ipv6(c: Column) -> Column:
    """IPv6 of 2000::/3, outside 2001:db8 and 2001:0 to 2001:1ff; so no mapped IPv4 either."""
    public = lambda g: g[0].between(0x2000, 0x3FFF) & ~((g[0] == 0x2001) & ((g[1] == 0xDB8) | (g[1] < 0x200)))
    return F.coalesce(bind(ipv6_groups(c), lambda g: F.when(g.isNotNull(), public(g))), F.lit(False))


def is_public_address(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(":")), is_public_ipv6(c)).otherwise(is_public_ipv4(c))


def is_uuid4(c: Column) -> Column:
    """A random UUID in its usual form."""
    return c.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z")
