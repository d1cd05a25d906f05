"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_KEY, MAX_VALUE = 4096, 1 << 20


def parse_i64(text: Column) -> Column:
    """A decimal integer with an optional sign and nothing around it, else null (also out of range)."""
    return F.when(text.rlike("^[+-]?[0-9]+$"), F.expr("1").cast("bigint") * text.try_cast("bigint"))


def hex_decode(text: Column) -> Column:
    """Bytes of lower-case hex of even length, else null."""
    return F.when(text.rlike("^([0-9a-f]{2})*$"), F.unhex(text))


def hex_encode(data: Column) -> Column:
    return F.lower(F.hex(data))


def cluster_id(text: Column) -> Column:
    """A 32-digit lower-case hex id that isn't zero, else null."""
    return F.when(text.rlike("^[0-9a-f]{32}$") & (text != "0" * 32), text)


def ttl_seconds(present: Column, deadline_ns: Column, now_ns: Column) -> Column:
    """-2 for what isn't visible, -1 without a deadline, else whole seconds left."""
    left = F.floor((deadline_ns - now_ns) / F.lit(1_000_000_000)).cast("bigint")
    return F.when(~visible(present, deadline_ns, now_ns), -2).when(deadline_ns.isNull(), -1).otherwise(left)


def visible(present: Column, deadline: Column, now: Column) -> Column:
    """Stored, and no deadline or one after now."""
    return F.coalesce(present, F.lit(False)) & (deadline.isNull() | (deadline > now))


def duration_ns(text: Column) -> Column:
    """Nanoseconds of digits with suffix ns, ms or s (bare digits are ns), else null."""
    number = F.regexp_extract(text, r"^([0-9]+)(ns|ms|s)?$", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"^([0-9]+)(ns|ms|s)?$", 2)
    return number * F.when(unit == "ms", 1_000_000).when(unit == "s", 1_000_000_000).otherwise(1)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def percent_to_p16(percent: Column) -> Column:
    """A percentage as a numerator of 65536ths, rounded."""
    return F.floor((percent * 65535 + 50) / 100).cast("int")


def prefix_end(prefix: bytes) -> bytes | None:
    """The first key after all keys with a prefix; None if there is none."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def in_range(key: Column, start, end) -> Column:
    """start <= key < end; None is no bound."""
    out = F.lit(True)
    if start is not None:
        out = out & (key >= F.lit(start))
    return out if end is None else out & (key < F.lit(end))


def has_prefix(key: Column, prefix: str) -> Column:
    """Prefix test that a scan can push down: the range, then the test itself."""
    end = prefix_end(prefix.encode())
    upper = end.decode("utf-8", "ignore") if end and all(b < 128 for b in end) else None
    return in_range(key, prefix, upper) & key.startswith(prefix)


def display_payload(payload: Column, most: int = 96) -> Column:
    """The first bytes of a payload, most of them: printable ASCII as it is, else 0x and their hex; an ellipsis if there are more."""
    held = F.substring(payload, 1, most)
    shown = F.when(F.hex(held).rlike("^(2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E])*$"), F.decode(held, "US-ASCII")).otherwise(F.concat(F.lit("0x"), hex_encode(held)))
    return F.concat(shown, F.when(F.octet_length(payload) > most, "\u2026").otherwise(""))


def json_escape_bytes(data: Column) -> Column:
    """Each byte as its own escaped unit: a backslash, u00 and two digits."""
    return F.regexp_replace(F.lower(F.hex(data)), "(..)", r"\\u00$1")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def ratio_at_least(a: Column, b: Column, c: Column, d: Column) -> Column:
    """a/b >= c/d for non-negative integers, by cross multiplication in decimals."""
    big = "decimal(38,0)"
    return a.cast(big) * d.cast(big) >= c.cast(big) * b.cast(big)
