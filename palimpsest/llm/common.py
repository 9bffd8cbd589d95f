"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank and U+0009 to U+000D, nothing else.
WORD_SPACE = "\t\n\x0b\x0c\r"

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may leave the setting empty, as tests do:
    it gets a temporary folder, which executors on other machines could not read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_palimpsest_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark._palimpsest_dir = own
    return own


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


def shared_folder(spark: SparkSession, what: str) -> str:
    """As ``shared_path``, the folder being made."""
    path = shared_path(spark, what)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return path


def cut(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder, in a folder for each value of ``by`` if given, and read again.

    This ends the lineage at files that outlive any executor. Shuffle files of the query that filled
    them are removed as soon as it ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    before = spark.conf.get(_CLEAN_SHUFFLES)
    try:
        spark.conf.set(_CLEAN_SHUFFLES, "true")
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def forget(df: DataFrame) -> None:
    """Delete the files of a DataFrame that ``cut`` returned, once nothing will read it again."""
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Give memory that is free again back to the system; Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(of_batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` from one of a batch; what a task has allocated goes back to the system at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from of_batch(batch)
        batch = None  # noqa: F841
        release()

    return run


def per_task(column: Column, make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str) -> Column:
    """An Arrow UDF of one column; what ``make`` builds for a task goes when the task's input ends."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = make()
        try:
            for batch in batches:
                yield own(batch)
        finally:
            del own
            release()

    return F.arrow_udf(run, kind)(column)


def slices(texts: pa.Array, rows: int, size: int = 1 << 20) -> Iterator[pa.Array]:
    """An array of texts, or lists, in slices of at most ``rows`` rows and about ``size`` bytes, or entries; a longer row is a slice of its own."""
    sizes = pa.compute.list_value_length(texts) if pa.types.is_list(texts.type) else pa.compute.binary_length(texts)
    ends = sizes.fill_null(0).cast(pa.int64()).to_pylist()
    a = total = 0
    for b, n in enumerate(ends):
        if b > a and (b - a >= rows or total + n > size):
            yield texts[a:b]
            a, total = b, 0
        total += n
    if len(texts) > a:
        yield texts[a:]


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that bear one of these working names renamed, and what names them back (for ``withColumnsRenamed``)."""
    working = {n.lower() for n in names}
    back = {f"_held_{uuid.uuid4().hex}": c for c in df.columns if c.lower() in working}
    return df.withColumnsRenamed({c: held for held, c in back.items()}), back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_parts(text):
    """Column: the text split at each single white-space character, empty parts included."""
    return F.split(F.translate(text, WORD_SPACE, " " * len(WORD_SPACE)), " ", -1)


def words(text):
    """Column: the words ``[^\\x20\\x09-\\x0D]+`` of a text; null for null."""
    return F.array_remove(word_parts(text), "")
