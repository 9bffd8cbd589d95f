"""The job ledger: an append-only table of attempts, read with windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "analyzing", "sanitizing", "verifying", "completed", "quarantined", "interrupted", "failed")
ACTIVE = ("pending", "processing", "analyzing", "sanitizing", "verifying")
RETRYABLE = ("failed", "interrupted")
SCHEMA = (
    "id string, source_filename string, source_path string, source_hash string, output_path string, report_path string, status string, model string, "
    "policy_name string, policy_version int, findings_count int, verification_result boolean, error_code string, error_message string, "
    "created_at timestamp, started_at timestamp, completed_at timestamp"
)


def latest(jobs: DataFrame, key: str = "source_hash") -> DataFrame:
    """The last attempt of each key. Spark keeps one row a key before the shuffle, however many attempts there are."""
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def not_done(batch: DataFrame, jobs: DataFrame, order: str, key: str = "source_hash") -> DataFrame:
    """Rows of a batch to process: the first of each hash whose last attempt, if any, failed or was interrupted."""
    first = batch.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rank = 1").drop("_rank")
    blocked = latest(jobs, key).where(~F.col("status").isin(*RETRYABLE)).select(key)
    return first.join(blocked, key, "left_anti")


def recent(jobs: DataFrame, limit: int = 50, offset: int = 0, status: list[str] | None = None) -> DataFrame:
    """Attempts from the newest on."""
    chosen = jobs if status is None else jobs.where(F.col("status").isin(*status))
    return chosen.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(min(500, max(1, limit)))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def retryable(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*RETRYABLE))


def recovered(jobs: DataFrame) -> DataFrame:
    """All attempts, those that a crash left active being interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*ACTIVE), "interrupted").otherwise(F.col("status")))


def by_prefix(jobs: DataFrame, prefix: str, among: int = 500) -> DataFrame:
    """The attempt whose id begins with a prefix, among the newest; none if several do."""
    found = recent(jobs, among).where(F.col("id").startswith(prefix))
    return found.withColumn("_n", F.count("*").over(Window.partitionBy())).where("_n = 1").drop("_n")


def collision_safe(names: DataFrame, folder: str, name: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """``names`` with ``safe_name``, which nothing else in its folder has.

    The first of a folder's equal names keeps it, others get ``-2``, ``-3`` and so on before the suffix. ``existing``
    (``folder``, ``name``) are names that are taken. Free numbers are dealt out in turn: a name whose number is taken by
    ``existing`` or by another of ``names`` gets the next that is free. Names of one stem meet in one row of counts, not of files.
    """
    stem, suffix = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    # every name that is taken or asked for, with the stem and number it would occupy
    plain = names.select(F.col(folder).alias("_f"), F.col(name).alias("_n")).distinct()
    taken = plain if existing is None else plain.unionByName(existing.select(F.col("folder").alias("_f"), F.col("name").alias("_n"))).distinct()
    numbered = taken.select("_f", F.regexp_extract("_n", r"^(.+)-(\d{1,9})(\.[^.]*)?$", 1).alias("_s"), F.regexp_extract("_n", r"^(.+)-(\d{1,9})(\.[^.]*)?$", 2).cast("long").alias("_k"), F.regexp_extract("_n", r"^(.+)-(\d{1,9})(\.[^.]*)?$", 3).alias("_x")).where("_s <> ''")
    used = numbered.groupBy("_f", "_s", "_x").agg(F.array_sort(F.collect_set("_k")).alias("_used"))
    place = F.row_number().over(Window.partitionBy(folder, name).orderBy(order))
    ranked = names.withColumns({"_place": place, "_stem": stem, "_suffix": suffix})
    if existing is not None:
        held = existing.select(F.col("folder").alias("_hf"), F.col("name").alias("_hn")).distinct().withColumn("_held", F.lit(1))
        ranked = ranked.join(held, (F.col(folder) == F.col("_hf")) & (F.col(name) == F.col("_hn")), "left").withColumn("_place", F.col("_place") + F.coalesce("_held", F.lit(0))).drop("_hf", "_hn", "_held")
    ranked = ranked.join(used, (F.col(folder) == F.col("_f")) & (F.col("_stem") == F.col("_s")) & (F.col("_suffix") == F.col("_x")), "left").drop("_f", "_s", "_x")
    # the k-th free number from 2 on: every taken number that is not above it moves it by one
    moved = F.aggregate(F.filter(F.coalesce("_used", F.array().cast("array<long>")), lambda k: k >= 2), F.col("_place").cast("long"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    safe = F.when(F.col("_place") == 1, F.col(name)).otherwise(F.concat("_stem", F.lit("-"), moved.cast("string"), "_suffix"))
    return ranked.withColumn("safe_name", safe).drop("_place", "_stem", "_suffix", "_used")


def attempts(processed: DataFrame, policy, model: str = "patterns", stamp: Column | None = None) -> DataFrame:
    """Ledger rows of processed documents (``doc_id``, ``source_hash``, ``status``, ``route``, ``findings_count``, ``passed``)."""
    now = F.current_timestamp() if stamp is None else stamp
    values = {
        "id": F.uuid() if stamp is None else F.sha2(F.concat_ws("/", "doc_id", "source_hash"), 256), "source_filename": F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), "source_path": F.lit(None),
        "source_hash": F.col("source_hash"), "output_path": F.col("route"), "report_path": F.lit(None), "status": F.col("status"), "model": F.lit(model),
        "policy_name": F.lit(policy.name), "policy_version": F.lit(policy.version), "findings_count": F.col("findings_count"), "verification_result": F.col("passed"),
        "error_code": F.col("error") if "error" in processed.columns else F.lit(None), "error_message": F.lit(None), "created_at": now, "started_at": now, "completed_at": now,
    }
    kinds = dict(x.strip().rsplit(" ", 1) for x in SCHEMA.split(","))
    return processed.select(*[c.cast(kinds[n]).alias(n) for n, c in values.items()])
