"""Text and case sources."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPECTED = "array<struct<category:string,text:string,start:int,end:int,required:boolean>>"
#: Fixed starts and ends of names that are never taken.
HIDDEN = r"^[.~]|\.(?i:tmp|part|swp)$"


@dataclass(frozen=True)
class Handler:
    """How files of some suffixes become text: ``read`` is a column of a file's bytes, null where they are no text."""

    kind: str
    extensions: tuple[str, ...]
    read: Callable[[Column], Column]


def utf8_text(content: Column) -> Column:
    """Text of UTF-8 bytes, line ends as line feeds; null for other bytes."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "\r\n?", "\n"))


TEXT = Handler("text", (".txt",), utf8_text)


def registry(*handlers: Handler) -> dict[str, Handler]:
    """Handlers by suffix in lower case; a suffix that two of them claim raises ``ValueError``."""
    found: dict[str, Handler] = {}
    for handler in handlers:
        for suffix in map(str.lower, handler.extensions):
            if suffix in found:
                raise ValueError(f"two handlers for {suffix}")
            found[suffix] = handler
    return found


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(``path``, ``name``, ``modified``, ``n_bytes``, ``is_link``) of the files right in a folder, by Hadoop's file system.

    Spark's own readers pass over names that begin with ``_``. The driver holds what a directory listing holds.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    local = fs.getScheme() == "file"
    rows = []
    for x in fs.listStatus(at):
        if x.isFile():
            path = x.getPath().toString()
            link = x.isSymlink() or (local and os.path.islink(x.getPath().toUri().getPath()))
            rows.append((path, x.getPath().getName(), x.getModificationTime() / 1000, x.getLen(), link))
    found = spark.createDataFrame(rows, "path string, name string, seconds double, n_bytes long, is_link boolean")
    return found.withColumn("modified", F.timestamp_seconds("seconds")).drop("seconds")


def gate(found: DataFrame, handlers: dict[str, Handler], max_bytes: int = 20_000_000, root: str | None = None) -> DataFrame:
    """``found`` with ``suffix`` and ``refused``: ``symlink``, ``outside``, ``unsupported``, ``too_large``, or null for files that may be read.

    ``root``: a folder below which paths must lie; ``..`` in a path counts as outside.
    """
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    inside = F.lit(True) if root is None else F.col("path").startswith(root.rstrip("/") + "/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    refused = F.when(F.col("is_link"), "symlink").when(~inside, "outside").when(~suffix.isin(*handlers), "unsupported").when(F.col("n_bytes") > max_bytes, "too_large")
    return found.withColumns({"suffix": suffix, "refused": refused})


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".txt",), max_bytes: int = 20_000_000, handlers: dict[str, Handler] | None = None) -> DataFrame:
    """(``path``, ``name``, ``modified``, ``n_bytes``, ``kind``, ``source_hash``, ``text``, ``error``) of a folder's files, in order of paths.

    The folder is not searched below itself. Hidden and unfinished names, links and suffixes without a handler are
    left out. A file over the limit has an ``error`` and is never opened; one whose bytes its handler cannot read has an ``error`` and no text.
    The hash is of the bytes as they are.
    """
    known = registry(*[Handler("text", tuple(extensions), utf8_text)]) if handlers is None else handlers
    wanted = gate(listed(spark, folder).where(~F.col("name").rlike(HIDDEN)), known, max_bytes).where("refused is null or refused = 'too_large'")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                data = None
                if row.column("refused")[0].as_py() is None:
                    fs, at = pafs.FileSystem.from_uri(row.column("path")[0].as_py())
                    with fs.open_input_stream(at) as stream:
                        data = stream.read()
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], [*row.schema.names, "content"])

    kinds = ", ".join(f"{n} {t}" for n, t in wanted.dtypes)
    opened = wanted.repartition(F.col("path")).mapInArrow(read, f"{kinds}, content binary")
    text, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, handler in known.items():
        text = F.when(F.col("suffix") == suffix, handler.read(F.col("content"))).otherwise(text)
        kind = F.when(F.col("suffix") == suffix, handler.kind).otherwise(kind)
    error = F.coalesce("refused", F.when(F.col("text").isNull(), "not_utf8"))
    return opened.withColumns({"text": text, "kind": kind}).select("path", "name", "modified", "n_bytes", "kind", F.sha2("content", 256).alias("source_hash"), "text", error.alias("error")).orderBy("path")


def stable(found: DataFrame, seconds: int = 3) -> DataFrame:
    """Files that have not changed for some seconds."""
    return found.where(F.col("modified") <= F.current_timestamp() - F.expr(f"interval {int(seconds)} seconds"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """(``name``, ``text``, ``findings``) of JSON lines; blank lines are left out, ``required`` is true by default.

    A line whose ``findings`` are no list of findings fails the query.
    """
    raw = spark.read.text(path).where(F.trim("value") != "")
    found = raw.select(F.from_json("value", f"name string, text string, findings {EXPECTED}", {"mode": "PERMISSIVE"}).alias("x"), F.get_json_object("value", "$.findings").alias("given"))
    wrong = ~F.coalesce(F.col("given").startswith("["), F.lit(False)) | F.col("x.findings").isNull()
    right = F.when(wrong, F.raise_error(F.lit("findings must be a list"))).otherwise(F.col("x.findings"))
    filled = F.transform(
        right.cast(EXPECTED),
        lambda f: F.struct(f["category"].alias("category"), f["text"].alias("text"), f["start"].alias("start"), f["end"].alias("end"), F.coalesce(f["required"], F.lit(True)).alias("required")),
    )
    return found.select("x.name", "x.text", filled.alias("findings"))


def case_pairs(spark: SparkSession, texts: str, expected: str) -> DataFrame:
    """Cases whose text is ``<stem>.txt`` in one folder and whose findings are ``<stem>.json`` in another."""
    left = files(spark, texts).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).select("stem", "text")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(expected)
    right = raw.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("stem"), F.from_json(F.col("content").cast("string"), f"findings {EXPECTED}")["findings"].alias("findings"))
    return left.join(right, "stem").select(F.col("stem").alias("name"), "text", "findings")


def write_routed(processed: DataFrame, path: str) -> None:
    """Rewritten texts, a folder for each route."""
    processed.where("route <> 'failed'").select("doc_id", "sanitized", "route").write.partitionBy("route").mode("append").parquet(path)
