"""Deterministic detectors: sensitive values by pattern, as arrays of findings on the document row.

A guard of each pattern, mostly a search for a few plain characters, decides first whether a text can match it at all;
the pattern then runs once, and offsets are worked out only for texts with a match.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.columns import IPV4

FINDING = "struct<start:int,end:int,category:string,value:string,confidence:double,sources:array<string>,reason:string>"
FINDINGS = f"array<{FINDING}>"


@dataclass(frozen=True)
class Pattern:
    name: str
    category: str
    regex: str
    reason: str
    #: ``plain``, ``url`` (trailing punctuation goes), ``card``, ``ipv4`` or ``assignment`` (the value only).
    kind: str = "plain"


_VALUE = r"""(?:"[^"\r\n]+"|'[^'\r\n]+'|[^\s,;]+)"""
#: Fixed patterns, in Java's dialect with Unicode classes.
PATTERNS = (
    Pattern("email", "EMAIL", r"(?U)(?<![\w.+-])[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w-])", "address with local part and domain"),
    Pattern("phone", "PHONE", r"(?U)(?<!\d)(?:\+?1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?!\d)", "ten-digit phone number"),
    Pattern("ssn", "SSN", r"(?U)(?<!\d)(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\d)", "social security number"),
    Pattern("url", "URL", r"""(?U)https?://[^\s<>\]\["']+""", "web address", "url"),
    Pattern("card", "CREDIT_CARD", r"(?U)(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", "card number with a valid check digit", "card"),
    Pattern("api_key", "API_KEY", r"(?U)\b(?:sk-[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,})\b", "key with a known prefix"),
    Pattern("bearer", "SECRET", r"(?iU)\bBearer\s+[A-Za-z0-9._~+/-]+=*", "bearer token"),
    Pattern("jwt", "SECRET", r"(?U)\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "signed web token"),
    Pattern("pem", "SECRET", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "head of a private key"),
    Pattern("ipv4", "IP_ADDRESS", r"(?U)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?=$|[^\d.]|\.(?=\s|$))", "IPv4 address", "ipv4"),
    Pattern("password", "PASSWORD", rf"(?iU)\bpassword\s*[:=]\s*{_VALUE}", "assigned password", "assignment"),
    Pattern("token", "API_KEY", rf"(?iU)\b(?:api[_ -]?key|api\s+token|token)\s*[:=]\s*{_VALUE}", "assigned key or token", "assignment"),
    Pattern("secret", "SECRET", rf"(?iU)\bsecret\s*[:=]\s*{_VALUE}", "assigned secret", "assignment"),
)
BY_NAME = {p.name: p for p in PATTERNS}


def _quoted(x: str) -> str:
    """A string as a literal of Spark SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches of a pattern and the text between them alternate, so their lengths add up to offsets (as in ``columns.spans``).
_SPANS = """aggregate(
  filter(zip_with(regexp_extract_all({t}, {p}, 0), split({t}, {p}, -1), (h, g) -> named_struct('h', h, 'g', g)), x -> x.h IS NOT NULL),
  named_struct('at', 0, 'found', CAST(array() AS array<struct<start:int,value:string>>)),
  (a, x) -> named_struct('at', a.at + length(x.g) + length(x.h), 'found', concat(a.found, array(named_struct('start', a.at + length(x.g), 'value', x.h)))),
  a -> a.found)"""
_DIGITS = r"regexp_replace(x.value, '(?U)\\D', '')"
_ASSIGNED = rf"""transform(
  transform({{spans}}, x -> named_struct('upto', x.start + length(x.value), 'right', regexp_replace(x.value, {_quoted(r"(?U)^[^:=]*[:=]\s*")}, ''))),
  y -> IF(y.right RLIKE {_quoted(r"""^(?:"[^"\r\n]+"|'[^'\r\n]+')$""")},
    named_struct('start', y.upto - length(y.right) + 1, 'value', substring(y.right, 2, length(y.right) - 2)),
    named_struct('start', y.upto - length(y.right), 'value', y.right)))"""
#: What becomes of the spans of each kind of pattern.
_KINDS = {
    "plain": "{spans}",
    "url": "transform({spans}, x -> named_struct('start', x.start, 'value', regexp_replace(x.value, " + _quoted(r"[.,;:!?)\]}]+$").replace("}", "}}") + ", '')))",
    "card": f"filter({{spans}}, x -> length({_DIGITS}) BETWEEN 13 AND 19 AND NOT {_DIGITS} RLIKE " + _quoted(r"^(\d)\1*$") + f" AND luhn_check({_DIGITS}))",
    "ipv4": "filter({spans}, x -> x.value RLIKE " + _quoted(IPV4).replace("{", "{{").replace("}", "}}") + ")",
    "assignment": _ASSIGNED,
}
_FINDING = """transform({raw}, x -> named_struct('start', x.start, 'end', x.start + length(x.value), 'category', {category}, 'value', x.value,
  'confidence', 1.0D, 'sources', array('regex'), 'reason', {reason}))"""


def _found(text: str, p: Pattern) -> Column:
    """Findings of a pattern. One SQL expression: built call by call, thirteen of them keep the driver busy for seconds."""
    found = _SPANS.format(t="`" + text.replace("`", "``") + "`", p=_quoted(p.regex))
    return F.expr(_FINDING.format(raw=_KINDS[p.kind].format(spans=found), category=_quoted(p.category), reason=_quoted(p.reason)))


def _holds(text: Column, *parts: str) -> Column:
    return functools.reduce(operator.or_, (text.contains(x) for x in parts))


def _named(text: Column, *names: str) -> Column:
    """Whether a text may hold a name in any case: letters that fold to s or i without being their lower case count as a hit."""
    return _holds(F.lower(text), *names) | _holds(text, "\u017f", "\u0131", "\u0130")


#: What a text must have for a pattern to match. Every match passes its guard; most texts do not.
_DIGIT = r"\p{Nd}"
GUARDS = {
    "email": lambda t: t.contains("@"),
    "phone": lambda t: t.rlike(r"\p{Nd}{3}[ .-]\p{Nd}{4}"),
    "ssn": lambda t: t.rlike(r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}"),
    "url": lambda t: t.contains("://"),
    "card": lambda t: t.rlike(r"(?:\p{Nd}[ -]?){12}\p{Nd}"),
    "api_key": lambda t: _holds(t, "sk-", "AKIA", "ghp_"),
    "bearer": lambda t: _named(t, "bearer"),
    "jwt": lambda t: t.contains("eyJ"),
    "pem": lambda t: t.contains("-----BEGIN"),
    "ipv4": lambda t: t.rlike(r"\p{Nd}\.\p{Nd}"),
    "password": lambda t: _named(t, "password"),
    "token": lambda t: _named(t, "key", "token"),
    "secret": lambda t: _named(t, "secret"),
}
#: Patterns that need digits: one search for a digit stands before all of their guards.
_NUMERIC = ("phone", "ssn", "card", "ipv4")


def may_match(text: Column, name: str) -> Column:
    guard = GUARDS[name](text)
    return text.rlike(_DIGIT) & guard if name in _NUMERIC else guard


def findings(text: str, names: tuple[str, ...] | None = None) -> Column:
    """All findings of the named detectors, or of all, in the column ``text``, in order of detectors. Null texts have none."""
    none = F.array().cast(FINDINGS)
    chosen = [p for p in PATTERNS if names is None or p.name in names]
    return F.concat(*[F.when(may_match(F.col(text), p.name), _found(text, p)).otherwise(none) for p in chosen]).cast(FINDINGS)


def detect(docs: DataFrame, text: str = "text", names: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with a column ``findings``."""
    return docs.withColumn("findings", findings(text, names))


def valid(text: Column, found: Column) -> Column:
    """Findings whose span holds their value."""
    return F.filter(found, lambda f: F.substring(text, f["start"] + 1, f["end"] - f["start"]) == f["value"])


def exploded(df: DataFrame, column: str = "findings", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each finding."""
    return df.select(*keys, F.explode(column).alias("f")).select(*keys, "f.*")
