"""The same plan over a stream: new documents are processed once, in order of arrival, and entered in a ledger."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from palimpsest.operators.ledger import RETRYABLE, SCHEMA, attempts, latest
from palimpsest.operators.policy import DEFAULT, Policy
from palimpsest.plans.process import process

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def documents(spark: SparkSession, folder: str, schema, name: str = "*.parquet", files_at_once: int = 100) -> DataFrame:
    """A stream of the documents in a folder's files, those already there included; of all files of a table where ``name`` is a folder in it."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    if "*" not in name and table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(table):
        return stream.parquet(f"{folder.rstrip('/')}/{name}")
    return stream.option("pathGlobFilter", name).parquet(folder)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path; empty before its first entry."""
    return spark.read.schema(SCHEMA).parquet(path) if _there(spark, path) else spark.createDataFrame([], SCHEMA)


ADMITTED = "doc_id long, text string, source_hash string, error string"


class Admission(StatefulProcessor):
    """Lets one document of each text through, the smallest id of the batch in which it first comes. State: a text's hash."""

    def init(self, handle) -> None:
        self.done = handle.getValueState("done", "status string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.done.update(("completed",))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for batch in rows:
            failed = batch["error"].notna()
            if failed.any():
                yield batch.loc[failed, ["doc_id", "text", "source_hash", "error"]]
            if not failed.all():
                first = batch[~failed].sort_values("doc_id", na_position="last").head(1)
                if best is None or _before(first, best):
                    best = first
        if best is not None and not self.done.exists():
            self.done.update(("completed",))
            yield best[["doc_id", "text", "source_hash", "error"]]

    def close(self) -> None:
        pass


def _before(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    x, y = a["doc_id"].iloc[0], b["doc_id"].iloc[0]
    return not pd.isna(x) and (pd.isna(y) or x < y)


def _one_a_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the copies in a batch only the smallest id goes into the shuffle; what failed goes whole."""
    for batch in batches:
        good = batch[batch["error"].isna()].sort_values("doc_id", na_position="last").drop_duplicates("_key")
        yield pd.concat([good, batch[batch["error"].notna()]])


def admitted(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Documents (``doc_id``, ``text``, perhaps ``error``) of a stream to process: one a text, and every one that failed to be read.

    A text that has been let through stays out from then on; one that came with an ``error``, or a null text, does not count and is let in
    again. ``known``: (``source_hash``) of texts that are done already, read when the stream first starts. Copies within a batch
    meet as one row a task and Arrow batch; failed ones are dealt out by id, as they touch no state.
    """
    own = F.col("error") if "error" in stream.columns else F.lit(None).cast("string")
    rows = stream.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("source_hash"), F.coalesce(own, F.when(F.col("text").isNull(), "no_text")).alias("error"))
    key = F.when(F.col("error").isNull(), F.col("source_hash")).otherwise(F.concat(F.lit("failed-"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("string")))
    few = rows.withColumn("_key", key).mapInPandas(_one_a_text, f"{ADMITTED}, _key string")
    seeds = (stream.sparkSession.createDataFrame([], "source_hash string") if known is None else known.select("source_hash")).withColumnRenamed("source_hash", "_key")
    return few.groupBy("_key").transformWithStateInPandas(Admission(), ADMITTED, "Append", "None", initialState=seeds.groupBy("_key"))


def _run(spark: SparkSession, ledger_path: str, checkpoint: str) -> tuple[str, DataFrame]:
    """The name of the stream that a checkpoint belongs to, and the texts that the ledger called done when it first started."""
    at = f"{checkpoint.rstrip('/')}-start"
    if not _there(spark, f"{at}/_SUCCESS"):
        done = latest(ledger(spark, ledger_path)).where(~F.col("status").isin(*RETRYABLE) & F.col("source_hash").isNotNull()).select("source_hash")
        name = F.lit(uuid.uuid4().hex).alias("run")
        rows = done.select(name, "source_hash").unionByName(spark.range(1).select(name, F.lit(None).cast("string").alias("source_hash")))
        rows.write.mode("overwrite").parquet(at)
    found = spark.read.parquet(at)
    return found.where("source_hash is null").first().run, found.where("source_hash is not null")


def watch(stream: DataFrame, out: str, ledger_path: str, checkpoint: str, policy: Policy = DEFAULT) -> StreamingQuery:
    """Process what is there and end. Texts whose last attempt did not fail are passed over.

    Which texts are done is state of the stream, kept by its checkpoint; the ledger is only read when a checkpoint is new. Output and
    ledger lie in folders named by the stream and the batch. A batch that is repeated after a crash starts from the state before
    it, so it finds the same documents and replaces its own files.
    """
    spark = stream.sparkSession
    run, known = _run(spark, ledger_path, checkpoint)

    def one(batch: DataFrame, number: int) -> None:
        at = f"run={run}/batch={number}"
        done = process(batch, policy).select("doc_id", "source_hash", "sanitized", "status", "route", F.size("accepted").alias("findings_count"), "passed", "error")
        done.write.mode("overwrite").parquet(f"{out}/{at}")
        rows = batch.sparkSession.read.parquet(f"{out}/{at}")
        attempts(rows, policy, stamp=F.timestamp_seconds(F.lit(number))).write.mode("overwrite").parquet(f"{ledger_path}/{at}")

    before = spark.conf.get(_PROVIDER)
    try:
        spark.conf.set(_PROVIDER, ROCKS)
        return admitted(stream, known).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
