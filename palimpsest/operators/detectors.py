"""Detectors of one's own as table functions, to be called from SQL beside the patterns.

A detector is a name and a function from a text to ``(start, end, category, confidence, reason)`` tuples. As a table function it
reads windows of texts (``chunk_rows``), a document's windows together and in order, and gives each finding once, at
offsets of the whole text, however many windows share it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from palimpsest.operators.policy import CATEGORIES

Found = tuple[int, int, str, float, str]
_NEEDED = ("doc_id", "start", "chunk_text")


@dataclass(frozen=True)
class Detector:
    """``detect`` gives spans of a text; ``source`` names the detector in its findings."""

    source: str
    detect: Callable[[str], Iterable[Found]]

    def valid(self, text: str) -> Iterator[Found]:
        """Findings whose span lies in the text, whose category is known and whose confidence is from 0 to 1; others are passed over."""
        for start, end, category, confidence, reason in self.detect(text):
            if 0 <= start < end <= len(text) and category in CATEGORIES and 0 <= confidence <= 1:
                yield start, end, category, float(confidence), reason


def as_table_function(detector: Detector):
    """The class that Spark registers. Its argument is a table; ``analyze`` asks for the partitioning, so that callers need not."""

    class DetectIn:
        def __init__(self):
            self.doc = None
            self.open: dict[tuple[int, int, str], tuple] = {}

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the argument must be a table")
            missing = [c for c in _NEEDED if c not in table.dataType.names]
            if missing:
                raise ValueError(f"the table lacks {', '.join(missing)}")
            schema = StructType().add("doc_id", table.dataType["doc_id"].dataType).add("start_at", LongType()).add("end_at", LongType())
            schema = schema.add("category", StringType()).add("value", StringType()).add("confidence", DoubleType()).add("source", StringType()).add("reason", StringType())
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("start")])

        def _told(self, before: int | None) -> Iterator[tuple]:
            """Findings that no later window can hold, since windows from ``before`` on lie behind their start."""
            for key in sorted(k for k in self.open if before is None or k[0] < before):
                value, confidence, reason = self.open.pop(key)
                yield (self.doc, *key, value, confidence, detector.source, reason)

        def eval(self, row) -> Iterator[tuple]:
            self.doc, base, text = row["doc_id"], row["start"], row["chunk_text"]
            yield from self._told(base)
            for start, end, category, confidence, reason in detector.valid(text or ""):
                key = (base + start, base + end, category)
                if key not in self.open or confidence > self.open[key][1]:
                    self.open[key] = (text[start:end], confidence, reason)

        def terminate(self) -> Iterator[tuple]:
            yield from self._told(None)

    return DetectIn


def register(spark: SparkSession, name: str, detector: Detector) -> None:
    """Make ``SELECT * FROM name(TABLE(windows))`` available; ``windows``: ``doc_id``, ``start``, ``chunk_text``."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(as_table_function(detector)))


def detected(windows: DataFrame, name: str) -> DataFrame:
    """Findings of a registered detector in windows. Windows of a null text have none."""
    return windows.sparkSession.sql(f"SELECT * FROM {name}(TABLE({{rows}}))", rows=windows.select("doc_id", F.col("start").cast("long").alias("start"), "chunk_text"))
