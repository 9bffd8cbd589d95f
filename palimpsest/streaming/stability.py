"""Files that are no longer written: their size and time must stay the same from one look at a folder to a later one."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor

SEEN = "path string, n_bytes long, modified timestamp, seen timestamp"


class ListingReader(SimpleDataSourceStreamReader):
    """Each batch is one look at a folder; the driver holds what a directory listing holds.

    A look that has to be repeated after a crash is taken anew: the gate needs looks that tell the truth when they are taken, not equal ones.
    """

    def __init__(self, options):
        self.folder = options["path"]

    def initialOffset(self) -> dict:
        return {"look": 0}

    def _look(self) -> list[tuple]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        seen = datetime.now(timezone.utc)
        return [(x.path, x.size, datetime.fromtimestamp((x.mtime_ns or 0) / 1e9, timezone.utc), seen) for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter(self._look()), {"look": start["look"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._look())


class ListingSource(DataSource):
    """``spark.readStream.format("folder_listing").load(folder)``: a row for each file at each look."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SEEN

    def simpleStreamReader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def looks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of looks at a folder (a URI), one a trigger."""
    spark.dataSource.register(ListingSource)
    return spark.readStream.format("folder_listing").load(folder)


_TOLD = "path string, n_bytes long, modified long, since long, settled long"


class Gate(StatefulProcessor):
    """State of a path: size and time at the first look that found them, that look, the last look, and whether it was told. Times are microseconds."""

    def __init__(self, seconds: float, forget_seconds: float):
        self.wait, self.forget = round(seconds * 1e6), round(forget_seconds * 1e6)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "n_bytes long, modified long, since long, last long, told boolean")

    def _due(self, last: int) -> int:
        return (last + self.forget) // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["seen_us", "n_bytes", "modified_us"])  # the looks at one file in one batch
        now = tuple(self.state.get()) if self.state.exists() else None
        if now is not None:
            self.handle.deleteTimer(self._due(now[3]))
        out = []
        for n_bytes, modified, at in zip(every["n_bytes"].tolist(), every["modified_us"].tolist(), every["seen_us"].tolist()):
            if now is not None and at < now[3]:
                continue  # an older look that comes late
            if now is None or now[:2] != (n_bytes, modified):
                now = (n_bytes, modified, at, at, False)
                continue
            told = now[4] or at - now[2] >= self.wait
            if told and not now[4]:
                out.append((key[0], n_bytes, modified, now[2], at))
            now = (*now[:3], at, told)
        self.state.update(now)
        self.handle.registerTimer(self._due(now[3]))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _TOLD.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def settled(looks: DataFrame, seconds: float = 3, forget_seconds: float = 3600, late: str = "1 minute") -> DataFrame:
    """(``path``, ``n_bytes``, ``modified``, ``since``, ``settled``) once for each state of a file that lasts.

    ``looks``: a stream or a table of (``path``, ``n_bytes``, ``modified``, ``seen``). A file is told at the first look that finds the size and
    time of a look ``seconds`` or more before it, all looks between having found them too. When it changes it has to
    settle again. A stream forgets files of which no look has come for ``forget_seconds`` by its watermark; needs the RocksDB state
    store. Rows with nulls are left out, repeated looks change nothing.
    """
    known = looks.select("path", F.col("n_bytes").cast("long").alias("n_bytes"), F.col("modified").cast("timestamp").alias("modified"), F.col("seen").cast("timestamp").alias("seen")).dropna()
    if looks.isStreaming:
        timed = known.withColumns({"modified_us": F.unix_micros("modified"), "seen_us": F.unix_micros("seen")}).withWatermark("seen", late)
        told = timed.groupBy("path").transformWithStateInPandas(Gate(seconds, forget_seconds), _TOLD, "Append", "EventTime")
        return told.withColumns({c: F.timestamp_micros(c) for c in ("modified", "since", "settled")})
    order = Window.partitionBy("path").orderBy("seen", "n_bytes", "modified")
    same = (F.col("n_bytes") == F.lag("n_bytes").over(order)) & (F.col("modified") == F.lag("modified").over(order))
    runs = known.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    since = F.min("seen").over(Window.partitionBy("path", "_run"))
    second = F.row_number().over(Window.partitionBy("path", "_run").orderBy("seen")) > 1
    lasting = runs.withColumns({"since": since, "_again": second}).where((F.unix_micros("seen") - F.unix_micros("since") >= round(seconds * 1e6)) & F.col("_again"))
    return lasting.groupBy("path", "_run", "n_bytes", "modified", "since").agg(F.min("seen").alias("settled")).drop("_run")
