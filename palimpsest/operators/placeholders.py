"""Reading placeholders back: valid ones, and malformed ones that must not pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.columns import spans
from palimpsest.operators.policy import Policy

#: Fixed forms of bracketed tokens.
BRACKETED = r"\[[^\]\r\n]*\]"
NUMBERED, REDACTED = r"^\[([A-Z][A-Z0-9_]*)_([1-9][0-9]*)\]$", r"^\[REDACTED_([A-Z][A-Z0-9_]*)\]$"
LOOKALIKE = r"(?U)^\[(?:REDACTED_[A-Z][A-Z0-9_]*|[A-Z][A-Z0-9_]*_\d+)\]$"
UNCLOSED = r"\[(?:REDACTED_)?[A-Z][A-Z0-9_]*"


def is_placeholder(token: Column, policy: Policy) -> Column:
    """Whether a bracketed token is one that the policy writes."""
    numbered = token.rlike(NUMBERED) & F.regexp_extract(token, NUMBERED, 1).isin(policy.numbered_labels)
    return numbered | (token.rlike(REDACTED) & F.regexp_extract(token, REDACTED, 1).isin(policy.redacted_labels))


def placeholder_spans(text: Column, policy: Policy) -> Column:
    """``array<struct<start, end, value>>`` of the policy's placeholders in a text."""
    return F.filter(spans(text, BRACKETED), lambda x: is_placeholder(x["value"], policy))


def malformed_count(text: Column, policy: Policy) -> Column:
    """Tokens that look like placeholders and are none, and openings of placeholders that never close."""
    tokens = F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(0))
    wrong = F.filter(tokens, lambda t: t.rlike(LOOKALIKE) & ~is_placeholder(t, policy))
    return (F.size(wrong) + F.regexp_count(F.regexp_replace(text, BRACKETED, ""), F.lit(UNCLOSED))).cast("long")


def masked(text: Column, found: Column) -> Column:
    """The text with blanks in place of the spans, so that all offsets stay."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, x["start"] - a["at"])
        return F.struct(x["end"].alias("at"), F.concat(a["parts"], F.array(gap, F.repeat(F.lit(" "), x["end"] - x["start"]))).alias("parts"))

    return F.aggregate(found, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def inside(start: Column, end: Column, found: Column) -> Column:
    """Whether a span lies within one of the spans found."""
    return F.exists(found, lambda p: (start >= p["start"]) & (end <= p["end"]))
