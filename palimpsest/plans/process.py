"""The life of a document as one lazy plan: detect, merge, rewrite, verify, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.detect import FINDINGS, detect
from palimpsest.operators.merge import merge, over_threshold
from palimpsest.operators.policy import DEFAULT, Policy
from palimpsest.operators.rewrite import sanitize
from palimpsest.operators.verify import verify


def find(docs: DataFrame, policy: Policy = DEFAULT, text: str = "text", contextual: Column | None = None) -> DataFrame:
    """``docs`` with ``findings``, ``merged``, ``ambiguous`` and ``accepted``."""
    found = detect(docs, text)
    if contextual is not None:
        found = found.withColumn("findings", F.concat("findings", F.coalesce(contextual.cast(FINDINGS), F.array().cast(FINDINGS))))
    return over_threshold(merge(found, text), policy)


def process(docs: DataFrame, policy: Policy = DEFAULT, text: str = "text", contextual: Column | None = None) -> DataFrame:
    """``find`` with the rewritten text, verification, ``status`` and ``route``.

    ``status`` is ``completed`` where verification passes and nothing waits for review, else
    ``quarantined``; ``route`` is ``release`` or ``quarantine``. A null text fails: status ``failed``.
    """
    done = sanitize(find(docs, policy, text, contextual), policy, text)
    reviewed = F.filter("accepted", lambda f: policy.lookup("action", f["category"]) == "review")
    allowed = F.transform(reviewed, lambda f: f["value"]) if policy.warn_only else None
    checked = verify(done, policy, allowed=allowed, known=F.col("findings") if contextual is None else None)
    waits = (F.size(reviewed) > 0) & F.lit(policy.quarantine and not policy.auto_replace)
    clean = F.col("passed") & ~waits
    return checked.withColumns(
        {
            "review_quarantine": waits,
            "status": F.when(F.col(text).isNull(), "failed").when(clean, "completed").otherwise("quarantined"),
            "route": F.when(F.col(text).isNull(), "failed").when(clean, "release").otherwise("quarantine"),
        }
    )
