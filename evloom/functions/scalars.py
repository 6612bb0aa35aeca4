"""Scalar derivations: text, numbers, urls and names as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that identify a source; the marks of embedded media; job ids; what is taken out of urls in texts.
IDENTIFYING_QUERY = ("v", "list", "id")
EMBEDDED_MEDIA = r"(?i)data:[a-z]+/[a-z0-9.+-]+;base64,|/9j/4[A-Za-z0-9+/]{40,}|iVBORw0KGgo"
JOB_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,99}$"
SESSION_SUFFIX = ".session.json"
URL_CREDENTIALS, URL_TAIL = r"(https?://)[^/\s@]+@", r"(https?://[^\s?#'\"]+)[?#][^\s'\"]*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Without white space of any kind at both ends (trim() knows the space alone)."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")


def py_round(x, digits: int) -> Column:
    """Half to even on the exact binary value, as Python rounds; round and bround look at the shortest decimal text instead.

    p + err is x * 10^digits without error (the factor has few bits, x is split in two halves), so a tie is known from a near tie."""
    x, s = _c(x).cast("double"), 10.0**digits
    p, c = x * s, x * 134217729.0
    high = c - (c - x)
    err = (high * s - p) + (x - high) * s
    near = F.rint(p)
    tie = F.abs(p - near) == 0.5
    return F.when(tie & (err > 0), F.ceil(p).cast("double")).when(tie & (err < 0), F.floor(p).cast("double")).otherwise(near) / s


def fixed(x, digits: int) -> Column:
    """A number with so many decimals, rounded as py_round does."""
    return F.format_string(f"%.{digits}f", py_round(x, digits))


def py_repr(x) -> Column:
    """The shortest decimal text of a double in Python's notation: 0.0001, 1e-05, 12345678.0, 1e+16."""
    s = _c(x).cast("string")
    size = F.abs(_c(x))
    wide = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.substring_index(s, "E", -1).try_cast("int")
    short = F.concat(F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", ""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return F.when(~s.contains("E"), s).when((size >= 1e-4) & (size < 1e16), wide).otherwise(short)


def json_text(x) -> Column:
    """A string as a JSON string of ASCII alone, others as \\u escapes (two for what lies beyond 16 bits)."""
    quoted = F.to_json(F.struct(_c(x).alias("v")))
    quoted = F.substring(quoted, 6, 2**31 - 1)
    quoted = F.left(quoted, F.length(quoted) - 1)
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    high = lambda n: F.lit(0xD800) + F.shiftright(n - 0x10000, 10)
    low = lambda n: F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))
    safe = lambda c: F.when(F.ascii(c) < 128, c).when(F.ascii(c) < 0x10000, four(F.ascii(c))).otherwise(F.concat(four(high(F.ascii(c))), four(low(F.ascii(c)))))
    return F.when(quoted.rlike(r"^[\x00-\x7f]*$"), quoted).otherwise(F.array_join(F.transform(F.split(quoted, ""), safe), ""))


def floor_ms(x) -> Column:
    return F.floor(_c(x) * 1000.0) / 1000.0


def normalized(x: str, size: str) -> Column:
    return F.expr(f"case when {size} > 0 then {x} / {size} end")


def filename_stem(name, most: int = 80, default: str = "video") -> Column:
    """Letters, digits, _ and - of a name, other runs as one _, ends stripped of _."""
    clean = F.regexp_replace(F.regexp_replace(_c(name), r"[^A-Za-z0-9_-]+", "_"), r"^_+|_+$", "")
    return F.left(F.coalesce(F.nullif(clean, F.lit("")), F.lit(default)), F.lit(most))


def session_filename(name, source) -> Column:
    return F.concat(filename_stem(name, 60), F.lit("-"), F.left(F.sha2(_c(source), 256), F.lit(8)), F.lit(SESSION_SUFFIX))


def base_name(path) -> Column:
    """The last part of a path with / or \\."""
    return F.element_at(F.split(_c(path), r"[\\/]"), -1)


def public_url(url) -> Column:
    """A url without credentials and fragment, with the identifying query parameters only."""
    u = _c(url)
    scheme = F.regexp_extract(u, r"^([^:/?#]+):", 1)
    authority = F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    path = F.regexp_extract(u, r"^[^:/?#]+:(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1).isin(*IDENTIFYING_QUERY) & (p != F.substring_index(p, "=", 1)) & ~p.endswith("=")), "&")
    return F.concat(F.lower(scheme), F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def redact_url(text) -> Column:
    """Urls in a text without credentials; query and fragment become ?<redacted>."""
    return F.regexp_replace(F.regexp_replace(_c(text), URL_CREDENTIALS, "$1"), URL_TAIL, r"$1?<redacted>")


def redact_text(text: str) -> str:
    """redact_url for a text on the driver."""
    return re.sub(URL_TAIL, r"\1?<redacted>", re.sub(URL_CREDENTIALS, r"\1", text))


def is_url(x) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(_c(x), r"^([^:/?#]+):", 1)).isin("http", "https"), F.lit(False))


def even_span(lo: str, hi: str, size: str) -> tuple[Column, Column]:
    """Start and length of a crop along one axis: outward to even pixels, at least two, inside the frame."""
    first = f"cast(floor(round({lo} * {size}, 6)) as int)"
    a = f"({first} - {first} % 2)"
    e = f"least({size}, cast(ceil(round({hi} * {size}, 6)) as int))"
    n0 = f"({e} - {a} + ({e} - {a}) % 2)"
    n = f"greatest(2, if({a} + {n0} > {size}, {n0} - 2, {n0}))"
    return F.expr(f"if({a} + {n} > {size}, ({size} - {n}) - ({size} - {n}) % 2, {a})"), F.expr(n)


def scaled_height(width: str, height: str, to: str) -> Column:
    """Height for a target width, aspect kept, half up."""
    return F.expr(f"greatest(1, cast(floor(({height} * {to} * 2 + {width}) / (2 * {width})) as int))")
