"""Placeholders in place of findings, numbered by first appearance within a document.

Numbers count distinct values per label; a key also holds the category, so two categories that share a label
share its counter but not their values. Everything stays within the document's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.columns import normalized
from palimpsest.operators.policy import Policy

PLANNED = "array<struct<start:int,end:int,placeholder:string,category:string,value:string,confidence:double,sources:array<string>>>"
_MARK = "\x01"


def plan(df: DataFrame, policy: Policy, accepted: str = "accepted") -> DataFrame:
    """``df`` with ``planned``: replacements by start, of findings whose action replaces and confidence suffices."""
    keyed = df.withColumn(
        "_keyed",
        F.transform(
            F.array_sort(accepted),
            lambda f: F.struct(
                f.alias("f"),
                policy.lookup("action", f["category"]).alias("action"),
                policy.lookup("label", f["category"]).alias("label"),
                F.concat_ws(_MARK, policy.lookup("label", f["category"]), f["category"], normalized(f["value"])).alias("key"),
            ),
        ),
    )
    leaves = F.filter("_keyed", lambda x: policy.lookup("replaced", x["f"]["category"]))
    counted = F.array_distinct(F.transform(F.filter(leaves, lambda x: x["action"] != "redact"), lambda x: x["key"]))
    keyed = keyed.withColumn("_keys", counted)

    def number(x: Column) -> Column:
        own = F.filter("_keys", lambda k: F.startswith(k, F.concat(x["label"], F.lit(_MARK))))
        return F.array_position(own, x["key"])

    def placeholder(x: Column) -> Column:
        return F.when(x["action"] == "redact", F.concat(F.lit("[REDACTED_"), x["label"], F.lit("]"))).otherwise(
            F.concat(F.lit("["), x["label"], F.lit("_"), number(x).cast("string"), F.lit("]"))
        )

    sure = F.filter(leaves, lambda x: x["f"]["confidence"] >= policy.lookup("threshold", x["f"]["category"]))
    rows = F.transform(
        sure,
        lambda x: F.struct(
            x["f"]["start"].alias("start"), x["f"]["end"].alias("end"), placeholder(x).alias("placeholder"), x["f"]["category"].alias("category"),
            x["f"]["value"].alias("value"), x["f"]["confidence"].alias("confidence"), x["f"]["sources"].alias("sources"),
        ),
    )
    return keyed.withColumn("planned", rows.cast(PLANNED)).drop("_keyed", "_keys")


def rewritten(text: Column, planned: Column) -> Column:
    """The text with each planned span replaced; spans must not overlap."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, x["start"] - a["at"])
        return F.struct(x["end"].alias("at"), F.concat(a["parts"], F.array(gap, x["placeholder"])).alias("parts"))

    return F.aggregate(planned, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def sanitize(df: DataFrame, policy: Policy, text: str = "text", accepted: str = "accepted") -> DataFrame:
    """``df`` with ``planned`` and the rewritten text ``sanitized``."""
    planned = plan(df, policy, accepted)
    return planned.withColumn("sanitized", F.when(F.size("planned") > 0, rewritten(F.col(text), F.col("planned"))).otherwise(F.col(text)))


def replacements(planned: Column) -> Column:
    """The audit list of replacements: hashes in place of values."""
    return F.transform(
        planned,
        lambda x: F.struct(
            x["category"].alias("category"), F.sha2(x["value"], 256).alias("original_hash"), x["placeholder"].alias("placeholder"),
            F.array_sort(x["sources"]).alias("sources"), x["confidence"].alias("confidence"),
        ),
    )
