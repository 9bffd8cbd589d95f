"""The job table as a fold over events: creations and updates in order, illegal ones refused with a reason.

Events: ``job_id``, ``seq`` (their order), ``at``, ``kind`` (``create`` or ``update``), ``status``, and ``fields``, a map of
what is set. A status may only follow one of lower rank, so whether a change is legal depends on the highest
rank before it: a running maximum, which needs no state machine and never holds a job's events in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far a job has come. A job that has ended stays as it is.
RANK = {"pending": 0, "processing": 1, "analyzing": 2, "sanitizing": 3, "verifying": 4, "completed": 5, "quarantined": 5, "failed": 5, "interrupted": 5}
ENDED = max(RANK.values())
#: The changes that are allowed.
CHANGES = {(a, b) for a, x in RANK.items() for b, y in RANK.items() if x < y}
#: Fields that an update may set, and their types.
FIELDS = {"output_path": "string", "report_path": "string", "findings_count": "int", "verification_result": "boolean", "error_code": "string", "error_message": "string", "source_path": "string"}
#: Fields that a creation sets.
CREATED = ("source_filename", "source_path", "source_hash", "model", "policy_name", "policy_version")

EVENTS = "job_id string, seq long, at timestamp, kind string, status string, fields map<string,string>"


def _rank(status: Column) -> Column:
    found = F.lit(None).cast("int")
    for name, rank in RANK.items():
        found = F.when(status == name, rank).otherwise(found)
    return found


def judged(events: DataFrame) -> DataFrame:
    """``events`` with ``refused``: null for those that take effect, else why not.

    ``unknown_kind``; ``already_created``; ``unknown_job`` for updates before a creation; ``unsupported_field`` for others than
    ``FIELDS`` (an update) or ``CREATED`` (a creation); ``unknown_status``; ``illegal_change`` for a status of no higher rank than the
    job's. A refused event has no effect at all. Updates without a status may come at any time, after the end too.
    Events of one ``seq`` are taken creations first, then by status and fields. A null job is a job like others.
    """
    names = F.map_keys(F.coalesce("fields", F.create_map().cast("map<string,string>")))
    creates, updates = F.col("kind") == "create", F.col("kind") == "update"
    supported = F.size(F.array_except(names, F.when(creates, F.array(*map(F.lit, CREATED))).otherwise(F.array(*map(F.lit, FIELDS))))) == 0
    rows = events.withColumns({"_rank": F.when(creates, 0).otherwise(_rank(F.col("status"))), "_ok": supported})
    order = Window.partitionBy("job_id").orderBy("seq", "kind", "status", F.to_json("fields"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.max(F.when(creates & F.col("_ok"), 1)).over(before), F.lit(0)) == 1
    known = rows.withColumn("_there", there)
    counts = F.when(F.col("_ok") & (creates | (updates & F.col("_there"))), F.col("_rank"))
    ranked = known.withColumn("_at", F.coalesce(F.max(counts).over(before), F.lit(-1)))
    refused = (
        F.when(F.coalesce(~(creates | updates), F.lit(True)), "unknown_kind")
        .when(creates & F.col("_there"), "already_created")
        .when(updates & ~F.col("_there"), "unknown_job")
        .when(~F.col("_ok"), "unsupported_field")
        .when(updates & F.col("status").isNotNull() & F.col("_rank").isNull(), "unknown_status")
        .when(updates & (F.col("_rank") <= F.col("_at")), "illegal_change")
    )
    return ranked.withColumn("refused", refused).drop("_rank", "_ok", "_there", "_at")


def jobs(events: DataFrame) -> DataFrame:
    """The job table that the events lead to, a row for each created job.

    ``created_at``, ``started_at`` (processing) and ``completed_at`` (the end) are times of the events that took effect, and each field
    has the value set last, null included. Partial results by job are combined in the shuffle that ``judged`` needs anyway.
    """
    good = judged(events).where("refused is null")
    creates = F.col("kind") == "create"
    ended = _rank(F.col("status")) == ENDED
    place = F.struct("seq", F.col("kind") == "update", "status", F.to_json("fields"))
    every = {c: "int" if c == "policy_version" else "string" for c in CREATED} | FIELDS
    last = [F.max_by(F.struct(F.element_at("fields", c).alias("v")), F.when(F.map_contains_key("fields", c), place))["v"].cast(kind).alias(c) for c, kind in every.items()]
    status = F.when(creates, "pending").otherwise(F.col("status"))
    return good.groupBy("job_id").agg(
        F.max_by(status, F.when(status.isNotNull(), F.when(creates, 0).otherwise(_rank(status)))).alias("status"),
        F.min(F.when(creates, F.col("at"))).alias("created_at"),
        F.min(F.when(~creates & (F.col("status") == "processing"), F.col("at"))).alias("started_at"),
        F.min(F.when(~creates & ended, F.col("at"))).alias("completed_at"),
        *last,
        F.count("*").alias("events"),
    )


def interruptions(table: DataFrame, at: Column) -> DataFrame:
    """The events that end all jobs a crash has left active, for the end of the log (``seq``: the greatest number)."""
    fields = F.create_map(F.lit("error_code"), F.lit("INTERRUPTED"), F.lit("error_message"), F.lit("Processing was interrupted and may be tried again"))
    active = table.where(F.coalesce(_rank(F.col("status")), F.lit(ENDED)) < ENDED)
    return active.select("job_id", F.lit((1 << 63) - 1).alias("seq"), at.cast("timestamp").alias("at"), F.lit("update").alias("kind"), F.lit("interrupted").alias("status"), fields.alias("fields"))
