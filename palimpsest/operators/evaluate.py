"""Detection quality: found spans against expected ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["case_id", "category", "start", "end"]


@dataclass(frozen=True)
class Gates:
    """Fixed default thresholds of the quality gate."""

    precision: float = 0.7
    required_recall: float = 0.95
    exact_span_accuracy: float = 0.95
    verification_pass_rate: float = 1.0
    invalid_findings: int = 0


def hits(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Found spans that are expected: inner join on case, category and span."""
    return found.select(*KEY).distinct().join(expected.select(*KEY).distinct(), KEY)


def false_positives(found: DataFrame, expected: DataFrame) -> DataFrame:
    return found.select(*KEY).distinct().join(expected.select(*KEY), KEY, "left_anti")


def false_negatives(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Required spans that were not found."""
    return expected.where("required").select(*KEY).distinct().join(found.select(*KEY), KEY, "left_anti")


def _overlap() -> Column:
    return (F.col("f.start") < F.col("e.end")) & (F.col("e.start") < F.col("f.end"))


def overlap_hits(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected spans that some found span of the case overlaps."""
    return expected.alias("e").join(found.alias("f"), (F.col("e.case_id") == F.col("f.case_id")) & _overlap(), "left_semi")


def category_hits(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected spans that a found span of their category overlaps."""
    on = (F.col("e.case_id") == F.col("f.case_id")) & (F.col("e.category") == F.col("f.category")) & _overlap()
    return expected.alias("e").join(found.alias("f"), on, "left_semi")


def by_case(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row a case with its counts. Each side is grouped by case once; a case's spans lie in its row, as a document's findings do."""
    span = F.struct("category", "start", "end")
    left = found.groupBy("case_id").agg(F.collect_set(span).alias("f"))
    every = expected.groupBy(*KEY).agg(F.bool_or("required").alias("required"), F.count("*").alias("n"))
    right = every.groupBy("case_id").agg(F.collect_list(F.struct("category", "start", "end", "required", "n")).alias("e"))
    both = left.join(right, "case_id", "full_outer")
    f = F.coalesce("f", F.array().cast("array<struct<category:string,start:long,end:long>>"))
    e = F.coalesce("e", F.array().cast("array<struct<category:string,start:long,end:long,required:boolean,n:long>>"))

    def plain(x: Column) -> Column:
        return F.struct(x["category"].alias("category"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))

    cases = both.select("case_id", F.transform(f, plain).alias("f"), e.alias("e")).withColumns(
        {"k": F.transform("e", plain), "r": F.transform(F.filter("e", lambda x: x["required"]), plain)}
    )
    hit = F.array_intersect("f", "k")

    def met(x: Column, same: bool) -> Column:
        on = lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])
        return F.exists("f", (lambda y: on(y) & (y["category"] == x["category"])) if same else on)

    def rows(same: bool) -> Column:
        return F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + F.when(met(x, same), x["n"]).otherwise(0))

    return cases.select(
        "case_id", F.size("f").cast("long").alias("found_total"), F.size("k").cast("long").alias("expected_total"), F.size("r").cast("long").alias("required_total"),
        F.size(hit).cast("long").alias("tp"), F.size(F.array_except("f", "k")).cast("long").alias("fp"), F.size(F.array_except("r", "f")).cast("long").alias("fn"),
        F.size(F.array_intersect("f", "r")).cast("long").alias("required_hit"), rows(False).alias("overlap"), rows(True).alias("category"),
    )


def counts(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: the counts of ``by_case`` over all cases. Expected spans that are listed twice count twice for ``overlap`` and ``category``."""
    names = ("tp", "fp", "fn", "required_hit", "required_total", "expected_total", "overlap", "category")
    return by_case(found, expected).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def rates(processed: DataFrame) -> DataFrame:
    """One row: ``case_count``, and the shares of cases that pass verification and that are quarantined; 1 and 0 without cases."""
    held = ~F.col("passed") | F.col("review_quarantine")
    return processed.agg(
        F.count("*").alias("case_count"),
        F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(1.0)).alias("verification_pass_rate"),
        F.coalesce(F.avg(held.cast("double")), F.lit(0.0)).alias("quarantine_rate"),
    )


def case_results(processed: DataFrame, found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row a case of ``processed`` (``doc_id`` and the columns of ``plans.process``): hashes, counts and verdicts, no plaintext."""
    counted = by_case(found, expected).select(F.col("case_id").alias("doc_id"), "found_total", "expected_total", "tp", "fp", "fn")
    kept = processed.select("doc_id", F.sha2("text", 256).alias("source_hash"), F.col("passed").alias("verification_passed"), (~F.col("passed") | F.col("review_quarantine")).alias("quarantined"))
    zero = {x: F.coalesce(F.col(x), F.lit(0)) for x in ("found_total", "expected_total", "tp", "fp", "fn")}
    return kept.join(counted, "doc_id", "left").withColumns(zero)


def summarize(processed: DataFrame, found: DataFrame, expected: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """One row: metrics and rates together. ``invalid``: one row ``invalid_findings``, 0 if not given."""
    one = metrics(counts(found, expected)).join(F.broadcast(rates(processed)))  # a single row each
    return one.withColumn("invalid_findings", F.lit(0).cast("long")) if invalid is None else one.join(F.broadcast(invalid))


def write_summary(summary: DataFrame, cases: DataFrame, folder: str) -> None:
    """The summary as JSON and as a short list in Markdown, and the cases as JSON lines, in three folders."""
    summary.select(*sorted(summary.columns)).write.mode("overwrite").json(f"{folder}/summary")
    lines = [F.concat(F.lit(f"- {n}: "), F.format_number(n, 3) if dict(summary.dtypes)[n] == "double" else F.col(n).cast("string")) for n in sorted(summary.columns) if dict(summary.dtypes)[n] in ("double", "bigint")]
    summary.select(F.concat_ws("\n", F.lit("# Evaluation\n"), *lines).alias("value")).write.mode("overwrite").text(f"{folder}/summary_text")
    cases.write.mode("overwrite").json(f"{folder}/cases")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)


def metrics(counted: DataFrame) -> DataFrame:
    """Precision, recall and the like of ``counts``; empty denominators count as perfect, F1 as 0."""
    found = counted.withColumn("found_total", F.col("tp") + F.col("fp"))
    found = found.withColumns({"precision": _ratio("tp", "found_total"), "recall": _ratio("tp", "expected_total")})
    both = F.col("precision") + F.col("recall")
    return found.withColumns(
        {
            "f1": F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0),
            "required_recall": _ratio("required_hit", "required_total"),
            "exact_span_accuracy": _ratio("tp", "expected_total"),
            "overlap_accuracy": _ratio("overlap", "expected_total"),
            "category_accuracy": _ratio("category", "expected_total"),
        }
    ).drop("found_total")


def gate(summary: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """``summary`` with ``failures``, the codes of gates that fail, in fixed order.

    Expects ``verification_pass_rate`` and ``invalid_findings`` beside the metrics.
    """
    checks = [
        (F.col("precision") < gates.precision, "PRECISION_BELOW_MINIMUM"),
        (F.col("required_recall") < gates.required_recall, "REQUIRED_RECALL_BELOW_MINIMUM"),
        (F.col("exact_span_accuracy") < gates.exact_span_accuracy, "EXACT_SPAN_ACCURACY_BELOW_MINIMUM"),
        (F.col("verification_pass_rate") < gates.verification_pass_rate, "VERIFICATION_PASS_RATE_BELOW_MINIMUM"),
        (F.col("invalid_findings") > gates.invalid_findings, "INVALID_FINDINGS_ABOVE_MAXIMUM"),
    ]
    return summary.withColumn("failures", F.array_compact(F.array(*[F.when(failed, code) for failed, code in checks])))


def latencies(df: DataFrame, value: str, by: list[str] | None = None, share: float = 0.95, bins: int = 1024, rounds: int = 2) -> DataFrame:
    """Count, mean, median and the percentile at index ``int((n - 1) * share)`` of the sorted values; the index is cut off, not interpolated.

    Equal values are counted before anything is sorted. A group's range is cut into ``bins`` on a scale that is logarithmic away from 0, and
    the bin in which an index lies is cut again, ``rounds`` times in all; running counts over bins tell which. Only values of the last bins
    are ranked, so neither a hot group nor one value far from all others brings many rows into one task. Groups without values give no row.
    """
    keys = by or []
    tallied = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    one = F.lit(0).alias("_one")
    ends = tallied.groupBy(*keys, one).agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.col("c") * F.col("v")).alias("total"))
    names = [F.col(k) for k in keys]

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        """Join by the groups, null keys included."""
        renamed = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in (*keys, "_one")])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return a.join(renamed, on).drop(*[f"_{k}" for k in keys])

    low, high = F.asinh("low"), F.asinh("high")
    indices = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) * F.lit(share))))
    # a row for each value and index that is looked for
    rows = met(tallied, ends.withColumns({"at": low, "width": high - low})).withColumn("i", F.explode(indices)).withColumn("before", F.lit(0).cast("long"))
    for _ in range(rounds):
        step = F.col("width") / bins
        place = F.when(step > 0, F.greatest(F.least(F.floor((F.asinh("v") - F.col("at")) / step), F.lit(bins - 1)), F.lit(0))).otherwise(F.lit(0)).cast("int")
        placed = rows.withColumn("bin", place)
        # bins rows a group and index at most
        histogram = placed.groupBy(*keys, "i", "before", "bin").agg(F.sum("c").alias("in_bin"))
        upto = F.col("before") + F.sum("in_bin").over(Window.partitionBy(*keys, "i").orderBy("bin"))
        chosen = histogram.withColumn("upto", upto).where((F.col("i") >= F.col("upto") - F.col("in_bin")) & (F.col("i") < F.col("upto")))
        chosen = chosen.select(*names, F.col("i").alias("_i"), F.col("bin").alias("_bin"), (F.col("upto") - F.col("in_bin")).alias("_before"))
        inside = met(placed, chosen).where("i = _i and bin = _bin")
        rows = inside.withColumns({"at": F.col("at") + F.col("bin") * step, "width": step, "before": F.col("_before")}).drop("bin", "_i", "_bin", "_before")
    last = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("v"))
    ranked = rows.withColumn("last", last).where((F.col("i") >= F.col("last") - F.col("c")) & (F.col("i") < F.col("last")))

    def at(index: Column) -> Column:
        return F.max(F.when(F.col("i") == index, F.col("v")))

    n = F.col("n")
    found = ranked.groupBy(*keys, "n", "total").agg(at(F.floor((n - 1) / 2)).alias("a"), at(F.floor(n / 2)).alias("b"), at(F.floor((n - 1) * F.lit(share))).alias("p95"))
    return found.select(*names, "n", (F.col("total") / n).alias("mean"), ((F.col("a") + F.col("b")) / 2).alias("median"), "p95")
