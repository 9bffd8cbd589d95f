"""Overlapping findings: the riskiest, surest and longest win, one after the other.

Whether a finding is accepted depends on those accepted before it, so this is a fold over the ranked findings
of a document, not a join. It stays within the document's row and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.detect import FINDINGS, valid
from palimpsest.operators.policy import Policy, risk

AMBIGUOUS = "array<struct<category:string,start:int,end:int,confidence:double,issue:string,conflicts_with:string>>"


def deduplicated(found: Column) -> Column:
    """One finding for each span and category: the first, with the highest confidence and all sources."""
    start = F.array().cast(FINDINGS)

    def same(a: Column, b: Column) -> Column:
        return (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["category"] == b["category"])

    def step(kept: Column, x: Column) -> Column:
        joined = F.transform(
            kept,
            lambda a: F.when(
                same(a, x),
                F.struct(
                    a["start"].alias("start"), a["end"].alias("end"), a["category"].alias("category"), a["value"].alias("value"),
                    F.greatest(a["confidence"], x["confidence"]).alias("confidence"), F.array_union(a["sources"], x["sources"]).alias("sources"), a["reason"].alias("reason"),
                ),
            ).otherwise(a),
        )
        return F.when(F.exists(kept, lambda a: same(a, x)), joined).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(found, start, step)


def ranked(found: Column) -> Column:
    """Findings by falling risk, pattern findings first, then longest, leftmost, surest, by category."""
    keyed = F.transform(
        found,
        lambda f: F.struct(
            (-risk(f["category"])).alias("k1"), (~F.array_contains(f["sources"], "regex")).alias("k2"), (f["start"] - f["end"]).alias("k3"),
            f["start"].alias("k4"), (-f["confidence"]).alias("k5"), f["category"].alias("k6"), f.alias("f"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda x: x["f"])


def greedy(found: Column) -> Column:
    """``struct<accepted, ambiguous>`` of ranked findings."""
    start = F.struct(F.array().cast(FINDINGS).alias("accepted"), F.array().cast(AMBIGUOUS).alias("ambiguous"))

    def step(a: Column, x: Column) -> Column:
        rivals = F.filter(a["accepted"], lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
        rival = F.get(rivals, F.lit(0))["category"]
        lost = F.struct(
            x["category"].alias("category"), x["start"].alias("start"), x["end"].alias("end"), x["confidence"].alias("confidence"),
            F.lit(None).cast("string").alias("issue"), rival.alias("conflicts_with"),
        )
        free = rival.isNull()
        return F.struct(
            F.when(free, F.concat(a["accepted"], F.array(x))).otherwise(a["accepted"]).alias("accepted"),
            F.when(free, a["ambiguous"]).otherwise(F.concat(a["ambiguous"], F.array(lost))).alias("ambiguous"),
        )

    return F.aggregate(found, start, step)


def merge(df: DataFrame, text: str = "text", findings: str = "findings", merged: str = "merged", ambiguous: str = "ambiguous") -> DataFrame:
    """``df`` with ``merged`` (accepted findings by start) and ``ambiguous`` (all that lost, without values)."""
    right = valid(F.col(text), F.col(findings))
    wrong = F.transform(
        F.filter(findings, lambda f: ~F.coalesce(F.substring(F.col(text), f["start"] + 1, f["end"] - f["start"]) == f["value"], F.lit(False))),
        lambda f: F.struct(
            f["category"].alias("category"), f["start"].alias("start"), f["end"].alias("end"), f["confidence"].alias("confidence"),
            F.lit("offset_mismatch").alias("issue"), F.lit(None).cast("string").alias("conflicts_with"),
        ),
    )
    # most texts have no findings, and nothing is computed for them
    some, none = F.size(findings) > 0, F.array().cast(FINDINGS)
    staged = df.withColumn("_ranked", F.when(some, ranked(deduplicated(right)))).withColumn("_result", F.when(some, greedy(F.col("_ranked"))))
    by_start = F.array_sort("_result.accepted")  # the struct begins with start and accepted spans are disjoint
    lost = F.when(some, F.concat(wrong, F.col("_result.ambiguous"))).otherwise(F.array().cast(AMBIGUOUS))
    return staged.withColumns({merged: F.when(some, by_start).otherwise(none), ambiguous: lost}).drop("_ranked", "_result")


def over_threshold(df: DataFrame, policy: Policy, merged: str = "merged", accepted: str = "accepted") -> DataFrame:
    """``df`` with ``accepted``: merged findings whose confidence their category's threshold allows."""
    return df.withColumn(accepted, F.filter(merged, lambda f: f["confidence"] >= policy.lookup("threshold", f["category"])))
