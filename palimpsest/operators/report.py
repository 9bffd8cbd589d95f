"""Audit reports without plaintext: counts, hashes and verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.columns import counted
from palimpsest.operators.detect import exploded
from palimpsest.operators.policy import Policy
from palimpsest.operators.rewrite import replacements


def by_category(df: DataFrame, findings: str = "accepted") -> DataFrame:
    return exploded(df, findings).groupBy("category").agg(F.count("*").alias("n"))


def by_source(df: DataFrame, findings: str = "accepted") -> DataFrame:
    """Findings by source; one with several sources counts for each."""
    return exploded(df, findings).select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def audit(processed: DataFrame, policy: Policy) -> DataFrame:
    """One report row a document, for the columns that ``plans.process`` adds."""
    return processed.select(
        "doc_id",
        F.sha2("text", 256).alias("source_hash"),
        "status",
        F.lit(policy.name).alias("policy_name"),
        F.lit(policy.version).alias("policy_version"),
        F.size("accepted").cast("long").alias("findings_count"),
        counted(F.transform("accepted", lambda f: f["category"])).alias("findings_by_category"),
        counted(F.flatten(F.transform("accepted", lambda f: f["sources"]))).alias("findings_by_source"),
        replacements(F.col("planned")).alias("replacements"),
        F.size("ambiguous").cast("long").alias("ambiguous_count"),
        F.struct("passed", "originals_left", "deterministic_left", "contextual_left", "ignored_placeholders", "ignored_reviews", "malformed", "remaining", "remaining_by_category").alias("verification"),
    )


def as_json(audited: DataFrame) -> DataFrame:
    """(``doc_id``, ``report``): reports as JSON."""
    return audited.select("doc_id", F.to_json(F.struct(*[c for c in sorted(audited.columns) if c != "doc_id"])).alias("report"))


def _lines(counts: Column) -> Column:
    rows = F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string"))), "\n")
    return F.when(F.size(counts) > 0, rows).otherwise("- None")


def as_markdown(audited: DataFrame) -> DataFrame:
    """(``doc_id``, ``report``): a short readable report."""
    v = "verification."
    verdict = F.when(F.col(v + "passed"), "Passed").otherwise("Needs review")
    advice = F.when(F.col("status") == "quarantined", "Look at the quarantined text, change the source or the policy, and try again.").otherwise("Nothing to do.")
    parts = [
        F.lit("# Sanitization report\n\nStatus: "), F.initcap("status"), F.lit("\nPolicy: "), F.col("policy_name"), F.lit(" v"), F.col("policy_version").cast("string"),
        F.lit("\nReplacements: "), F.size("replacements").cast("string"), F.lit("\n\n## Findings by category\n\n"), _lines(F.col("findings_by_category")),
        F.lit("\n\n## Findings by source\n\n"), _lines(F.col("findings_by_source")), F.lit("\n\n## Verification\n\n- Originals left: "), F.col(v + "originals_left").cast("string"),
        F.lit("\n- Findings left: "), F.col(v + "deterministic_left").cast("string"), F.lit("\n- Malformed placeholders: "), F.col(v + "malformed").cast("string"),
        F.lit("\n- Result: "), verdict, F.lit("\n\n"), advice, F.lit("\n"),
    ]
    return audited.select("doc_id", F.concat(*parts).alias("report"))


def durations(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``seconds`` from start to completion; null while a job has not ended."""
    return jobs.withColumn("seconds", F.col("completed_at").cast("double") - F.col("started_at").cast("double"))


def throughput(docs: DataFrame, seconds: float, text: str = "text") -> DataFrame:
    """One row: documents and characters, and both a second of ``seconds``, the measured wall time; null texts have no characters."""
    counts = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters"))
    spent = F.lit(float(seconds))
    return counts.withColumns({x: F.when(spent > 0, F.col(y) / spent).otherwise(0.0) for x, y in (("documents_a_second", "documents"), ("characters_a_second", "characters"))})


def with_reports(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """``jobs`` with the ``report`` that their ``report_path`` names among ``reports`` (``report_path``, ``report``); null without one."""
    return jobs.join(reports.select("report_path", "report"), "report_path", "left")


def review_diff(processed: DataFrame, context: int = 3) -> DataFrame:
    """(``doc_id``, ``diff``) of texts that were changed: a unified diff of a text and its rewriting. It holds plaintext, so nothing calls it by itself."""
    import difflib

    def diff(before: pd.Series, after: pd.Series) -> pd.Series:
        lines = (difflib.unified_diff(a.splitlines(), b.splitlines(), "original", "sanitized", lineterm="", n=context) for a, b in zip(before, after))
        return pd.Series(["\n".join(x) for x in lines])

    changed = processed.where(F.col("text") != F.col("sanitized"))
    return changed.select("doc_id", F.pandas_udf(diff, "string")("text", "sanitized").alias("diff"))
