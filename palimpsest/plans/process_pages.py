"""The life of a document of pages: read, detect, merge, map to glyphs, redact, read again, verify, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import glyphs
from palimpsest.operators.policy import DEFAULT, Policy
from palimpsest.operators.rewrite import sanitize
from palimpsest.operators.verify import verify
from palimpsest.plans.process import find
from palimpsest.plans.shared import written


def process_pages(pages: DataFrame, policy: Policy = DEFAULT, mode: str = "label", read: glyphs.Read | None = None, facts: glyphs.Read | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, redacted pages) of page tables (``doc_id``, ``page``, ``glyphs``), or of what ``read`` turns into ``mapped_pages``.

    A document's row holds its ``text``, ``planned`` replacements, the ``output`` text read from its redacted pages, the columns of
    verification over it, of ``document_checks`` and of ``inspected``, and ``error``, ``status`` and ``route``: ``scanned`` documents have
    hardly any text and ``unmapped`` ones a replaced finding whose glyphs are not sure; both wait in quarantine with pages as they were, and
    never count as released. Others are ``completed`` if verification passes, all pages are there and no replaced value can be read,
    else quarantined. A document without glyphs is scanned. Pages of documents that are not completed are returned too, so
    ``route`` must be asked before pages are handed on. Texts of pages before and after, plans and the glyphs of findings are written once each to
    the shared folder (``facts``: what gives the texts before redaction, if it takes less than ``read``); pages themselves are read where they are needed, and again only if they have findings.
    """
    if mode not in glyphs.MODES:
        raise ValueError(f"mode must be one of {', '.join(glyphs.MODES)}")
    read = glyphs.mapped_pages if read is None else read
    # each of these is met several times below
    facts = written(glyphs.page_facts(read(pages)) if facts is None else facts(pages).select(*glyphs.FACTS), "pages")
    planned = written(sanitize(find(glyphs.document_text(facts), policy), policy), "planned")
    parts = written(glyphs.mapped_findings(planned, pages, "planned", read), "findings")
    unsafe = glyphs.finding_confidence(planned, None, "planned", parts).groupBy("doc_id").agg(F.count_if("unsafe").alias("findings_unmapped"))
    known = planned.join(glyphs.inspected(facts), "doc_id").join(unsafe, "doc_id", "left").withColumn("findings_unmapped", F.coalesce("findings_unmapped", F.lit(0)))
    error = F.when(F.col("appears_scanned"), "scanned").when(F.col("findings_unmapped") > 0, "unmapped")
    known = known.withColumn("error", error)

    rects = written(glyphs.rectangles(glyphs.redaction_boxes(known.where("error is null"), parts, mode=mode)), "rectangles")
    again = written(glyphs.facts_after(pages, facts, rects, read), "redacted")
    originals = planned.select("doc_id", F.explode("planned.value").alias("value"))
    checks = glyphs.document_checks(glyphs.page_checks(facts, again, originals)).select("doc_id", "pages_kept", F.col("redacted").alias("unreadable"))
    output = glyphs.document_text(again).select("doc_id", F.col("text").alias("output"))
    # labels stand where they fit, so what is verified is the text of the pages, not the rewritten one
    checked = verify(known.join(output, "doc_id").join(checks, "doc_id"), policy, sanitized="output")
    clean: Column = F.col("error").isNull() & F.col("passed") & F.col("pages_kept") & F.col("unreadable")
    reviewed = F.exists("accepted", lambda f: policy.lookup("action", f["category"]) == "review") & F.lit(policy.quarantine and not policy.auto_replace)
    done = checked.withColumns(
        {
            "review_quarantine": reviewed,
            "status": F.when(clean & ~reviewed, "completed").otherwise("quarantined"),
            "route": F.when(clean & ~reviewed, "release").otherwise("quarantine"),
        }
    )
    return done, glyphs.uncovered(pages, rects, read)
