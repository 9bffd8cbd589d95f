"""Verification of rewritten texts: nothing that was replaced, and nothing that a detector finds, may be left."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.columns import counted, digits_only, label_form
from palimpsest.operators.detect import FINDINGS, findings
from palimpsest.operators.merge import merge, over_threshold
from palimpsest.operators.placeholders import inside, malformed_count, masked, placeholder_spans
from palimpsest.operators.policy import CATEGORIES, Policy

#: Categories whose digits are searched without their separators too.
DIGIT_CATEGORIES = ("PHONE", "SSN", "CREDIT_CARD", "BANK_ACCOUNT")
ASSIGNMENT = r"(?iU)^\s*(?:password|passwd|pwd|api[ _-]?(?:key|token)|token|secret)\s*[:=]\s*$"


def residual_count(visible: Column, originals: Column) -> Column:
    """Replaced findings still in the visible text, as they were or as digits run together."""

    def left(f: Column) -> Column:
        digits = digits_only(f["value"])
        as_digits = f["category"].isin(*DIGIT_CATEGORIES) & (F.length(digits) >= 7) & digits_only(visible).contains(digits)
        return visible.contains(f["value"]) | as_digits

    return F.size(F.filter(originals, left)).cast("long")


def _labels(policy: Policy) -> list[str]:
    return sorted({*CATEGORIES, *(policy.label(c) for c in CATEGORIES)})


def is_generated(f: Column, placeholders: Column, policy: Policy) -> Column:
    """Whether a finding is made of what the rewriting itself wrote."""
    labels = _labels(policy)
    tokens = F.array_distinct(F.transform(placeholders, lambda p: p["value"]))
    bare = F.aggregate(tokens, f["value"], lambda a, t: F.replace(a, t, F.lit(" ")))
    composite = (bare != f["value"]) & ((label_form(bare) == "") | label_form(bare).isin(labels) | bare.rlike(ASSIGNMENT))
    return (
        F.array_contains(tokens, f["value"])
        | label_form(f["value"]).isin(labels)
        | f["value"].rlike(ASSIGNMENT)
        | composite
        | inside(f["start"], f["end"], placeholders)
    )


def verify(df: DataFrame, policy: Policy, sanitized: str = "sanitized", originals: str = "planned", allowed: Column | None = None, contextual: Column | None = None, known: Column | None = None) -> DataFrame:
    """``df`` with the verification columns.

    ``originals``: array of what was replaced. ``allowed``: values that a warn-only policy lets stand.
    ``contextual``: findings of a further detector on the sanitized text. ``known``: what the patterns found in the text before, which
    stands where nothing was replaced, so that most texts are not searched again. Columns: ``originals_left``,
    ``deterministic_left``, ``contextual_left``, ``ignored_placeholders``, ``ignored_reviews``,
    ``malformed``, ``remaining``, ``passed``, ``remaining_findings`` and ``remaining_by_category``, their counts.
    """
    text = F.col(sanitized)
    none = F.array().cast(FINDINGS)
    searched = findings(sanitized) if known is None else F.when(F.size(originals) == 0, known).otherwise(findings(sanitized))
    parts = {"_d": searched.cast(FINDINGS)} | ({} if contextual is None else {"_c": contextual.cast(FINDINGS)})
    staged = df.withColumns({"_spans": placeholder_spans(text, policy), "malformed": malformed_count(text, policy), **parts})
    kept = {f"{n}k": F.filter(n, lambda f: ~is_generated(f, F.col("_spans"), policy)) for n in parts}
    staged = staged.withColumns({"originals_left": residual_count(masked(text, F.col("_spans")), F.col(originals)), **kept})
    strict = {f"{n}s": F.col(f"{n}k") if allowed is None else F.filter(f"{n}k", lambda f: ~F.array_contains(allowed, f["value"])) for n in parts}
    staged = staged.withColumns(strict)
    for n in parts:
        staged = over_threshold(merge(staged, sanitized, f"{n}s", f"{n}m", "_lost"), policy, f"{n}m", f"{n}a").drop(f"{n}m", "_lost")
    # with one detector, what it left is merged already
    both = staged.withColumn("remaining_findings", F.col("_da")) if contextual is None else merge(staged.withColumn("_both", F.concat("_da", "_ca")), sanitized, "_both", "remaining_findings", "_lost").drop("_both", "_lost")

    def total(first: str, then: str) -> Column:
        return functools.reduce(operator.add, (F.size(f"{n}{first}") - F.size(f"{n}{then}") for n in parts)).cast("long")

    return both.withColumns(
        {
            "deterministic_left": F.size("_da").cast("long"),
            "contextual_left": F.size(none if contextual is None else F.col("_ca")).cast("long"),
            "ignored_placeholders": total("", "k"),
            "ignored_reviews": total("k", "s"),
            "remaining": F.col("originals_left") + F.size("remaining_findings") + F.col("malformed"),
            "passed": F.col("originals_left") + F.size("remaining_findings") + F.col("malformed") == 0,
            "remaining_by_category": counted(F.transform("remaining_findings", lambda f: f["category"])),
        }
    ).drop("_spans", *[f"{n}{x}" for n in parts for x in ("", "k", "s", "a")])
