"""A file for each document, in a folder for each route, named so that nothing is overwritten.

Spark knows the final names before it writes (``ledger.collision_safe`` against what is there). A task writes its files below
a hidden folder of its own attempt; when all tasks have succeeded, commit moves the files of the attempts that did to their places
and drops the rest, so a task that ran twice leaves each file once. A job that fails leaves nothing but, where tasks are killed while
they write, files in the hidden folder.

One file a document is what people who open the results want; the driver renames each. For more than some
hundred thousand documents use ``files.write_routed``, which writes Parquet.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from palimpsest.operators.ledger import collision_safe

STAGED = ".staged"
ROWS = "route string, name string, content binary"


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: list[str]


class RoutedWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder, self.job = options["path"], options.get("job", uuid.uuid4().hex)

    def _root(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = self._root()
        attempt = posixpath.join(root, STAGED, self.job, uuid.uuid4().hex)
        files, made = [], set()
        for batch in iterator:
            for route, name, content in zip(*(batch.column(c).to_pylist() for c in ("route", "name", "content"))):
                if route not in made:
                    fs.create_dir(posixpath.join(attempt, route))
                    made.add(route)
                at = posixpath.join(route, name)
                with fs.open_output_stream(posixpath.join(attempt, at)) as out:
                    out.write(content or b"")
                files.append(at)
        return Written(attempt, files)

    def _drop(self, fs: pafs.FileSystem, root: str) -> None:
        at = posixpath.join(root, STAGED, self.job)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self._root()
        done = [m for m in messages if m is not None]
        targets = [f for m in done for f in m.files]
        if len(targets) != len(set(targets)):
            raise ValueError("two documents would have one name; name them by collision_safe first")
        for route in sorted({posixpath.dirname(f) for f in targets}):
            fs.create_dir(posixpath.join(root, route))
        taken = [f for f, info in zip(targets, fs.get_file_info([posixpath.join(root, f) for f in targets])) if info.type != pafs.FileType.NotFound]
        if taken:
            raise FileExistsError(f"{len(taken)} of the names are taken by now, {taken[0]} among them")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: fs.move(posixpath.join(x[0], x[1]), posixpath.join(root, x[1])), [(m.attempt, f) for m in done for f in m.files]))
        self._drop(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = self._root()
        self._drop(fs, root)


class RoutedSink(DataSource):
    """``df.write.format("routed_files").mode("append").save(folder)`` for (``route``, ``name``, ``content``)."""

    @classmethod
    def name(cls) -> str:
        return "routed_files"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> RoutedWriter:
        return RoutedWriter(self.options)


def existing(spark: SparkSession, folder: str) -> DataFrame:
    """(``folder``, ``name``) of the files in the folders right below one, hidden ones aside."""
    fs, root = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    rows = [tuple(posixpath.relpath(x.path, root).split("/")) for x in found if x.is_file]
    return spark.createDataFrame([r for r in rows if len(r) == 2 and r[0] != STAGED], "folder string, name string")


def write_files(processed: DataFrame, folder: str, name: str = "name", text: str = "sanitized", order: str = "doc_id") -> DataFrame:
    """Write each text that has a route other than ``failed`` to ``folder/route/name``; return (``route``, ``name``, ``safe_name``, ``doc_id``).

    A name that is taken, by another document or by a file that is there, gets a number before its suffix, in ``order``. Slashes in names
    become ``_``. Null texts are written as empty files. What is returned names the files as they were written.
    """
    spark = processed.sparkSession
    spark.dataSource.register(RoutedSink)
    wanted = processed.where("route <> 'failed'").withColumn("_name", F.regexp_replace(F.col(name), "[/\\x00]", "_"))
    named = collision_safe(wanted.select(F.col(order).alias("doc_id"), "route", "_name", F.col(text).alias("_text")), "route", "_name", "doc_id", existing(spark, folder))
    rows = named.select("route", F.col("safe_name").alias("name"), F.encode(F.coalesce("_text", F.lit("")), "utf-8").alias("content"))
    rows.write.format("routed_files").mode("append").option("job", uuid.uuid4().hex).save(folder)
    return named.select("route", F.col("_name").alias("name"), "safe_name", "doc_id")
