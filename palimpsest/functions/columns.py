"""Scalar column functions. Offsets are code points, counted from 0; a span's end is excluded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed characters that a label loses at both ends before it is compared.
LABEL_TRIM = "[] \t\r\n:="
SECRET_LOG = r"(?i)(password|secret|token|api[_-]?key)\s*[:=]\s*\S+|Bearer\s+\S+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits_only(text: Column) -> Column:
    """The text without anything but digits."""
    return F.regexp_replace(text, r"(?U)\D", "")


def folded(text: Column) -> Column:
    """The text in a form that is the same for all cases of its letters, one letter for several where it takes that: ß and ẞ as ss, ﬁ as fi, ς as σ.

    Upper case expands such letters, lower case brings them back as others; what stands between the two keeps Spark from dropping
    the first. A dotless ı, whose upper case is that of i, goes round both.
    """
    upper = F.replace(F.upper(F.translate(text, "ı", "\ue000")), F.lit("ẞ"), F.lit("SS"))
    return F.translate(F.lower(upper), "ς\ue000", "σı")


def normalized(value: Column) -> Column:
    """Trimmed, white space runs as one blank, case folded."""
    return folded(F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def label_form(value: Column) -> Column:
    """A finding's text as a label: without brackets and assignment signs around it, upper case, ``_`` for blank."""
    return F.replace(F.upper(F.btrim(value, F.lit(LABEL_TRIM))), F.lit(" "), F.lit("_"))


def luhn_ok(value: Column) -> Column:
    """13 to 19 digits, not all equal, with a valid check digit; separators are passed over."""
    digits = digits_only(value)
    return F.length(digits).between(13, 19) & ~digits.rlike(r"^(\d)\1*$") & F.call_function("luhn_check", digits)


def log_safe(message: Column) -> Column:
    """A log line with secrets masked behind their names, 500 characters at most."""
    kept = F.regexp_replace(message, r"(?i)((?:password|secret|token|api[_-]?key)\s*)[:=]\s*\S+", "$1=[REDACTED]")
    # a bearer token stands whole up to its first : or =, as any match does
    kept = F.regexp_replace(kept, r"(?i)(Bearer\s+[^\s:=]+)(?:[:=]\S*)?", "$1=[REDACTED]")
    return F.substring(kept, 1, 500)


def html_escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def safe_url(url: Column) -> Column:
    """Scheme, host, port and path of a URL; credentials masked, query and fragment dropped."""
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    host = F.when(authority.contains("@"), F.concat(F.lit("***@"), F.substring_index(authority, "@", -1))).otherwise(authority)
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), host, F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))


def address_class(ip: Column) -> Column:
    """``loopback``, ``private``, ``shared`` (100.64/10), ``public``, or ``invalid`` for an IPv4 address."""
    part = F.split(ip, r"\.")
    a, b = F.get(part, F.lit(0)).cast("int"), F.get(part, F.lit(1)).cast("int")
    return (
        F.when(~ip.rlike(IPV4), "invalid")
        .when(a == 127, "loopback")
        .when((a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)), "private")
        .when((a == 100) & b.between(64, 127), "shared")
        .otherwise("public")
    )


#: Four octets from 0 to 255 without leading zeros.
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of all matches of a Java pattern, left to right, without a UDF.

    The text between matches and the matches themselves alternate, so their lengths add up to offsets.
    Null texts give null; texts without a match an empty array.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("h"), g.alias("g")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + F.length(x["g"])
        end = at + F.length(x["h"])
        return F.struct(end.alias("at"), F.concat(a["found"], F.array(F.struct(at.alias("start"), end.alias("end"), x["h"].alias("value")))).alias("found"))

    return F.when(F.size(hits) > 0, F.aggregate(steps, start, step, lambda a: a["found"])).when(text.isNotNull(), none)


def literal_spans(text: Column, term: Column) -> Column:
    """All occurrences of a term, none overlapping the one before, as ``spans`` gives them."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1)
    n = F.size(gaps) - 1
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(a: Column, gap: Column) -> Column:
        at = a["at"] + F.length(gap)
        end = at + F.length(term)
        return F.struct(end.alias("at"), F.concat(a["found"], F.array(F.struct(at.alias("start"), end.alias("end"), term.alias("value")))).alias("found"))

    return F.when(text.contains(term) & (F.length(term) > 0), F.aggregate(F.slice(gaps, 1, n), start, step, lambda a: a["found"])).otherwise(none)


def counted(names: Column) -> Column:
    """``map<string,long>`` of how often each name stands in an array."""
    distinct = F.array_sort(F.array_distinct(names))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda c: F.size(F.filter(names, lambda x: x == c)).cast("long")))
