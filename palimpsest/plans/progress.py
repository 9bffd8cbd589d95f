"""Counts of each stage of ``process`` from the run itself, without a second pass.

Batch: Spark's observations, read when the action has ended. Streams: a listener hands every batch's counts to a callback.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: What is counted of the rows of ``process``, by stage, in order.
STAGES: dict[str, dict[str, Callable[[], Column]]] = {
    "detect": {"documents": lambda: F.count(F.lit(1)), "findings": lambda: F.sum(F.size("findings"))},
    "merge": {"merged": lambda: F.sum(F.size("merged")), "ambiguous": lambda: F.sum(F.size("ambiguous"))},
    "sanitize": {"replaced": lambda: F.sum(F.size("planned")), "changed": lambda: F.count_if(F.size("planned") > 0)},
    "verify": {"passed": lambda: F.count_if("passed"), "remaining": lambda: F.sum("remaining")},
    "route": {x: (lambda x=x: F.count_if(F.col("route") == x)) for x in ("release", "quarantine", "failed")},
}


def _counts() -> list[Column]:
    return [F.coalesce(make(), F.lit(0)).cast("long").alias(f"{stage}.{name}") for stage, counts in STAGES.items() for name, make in counts.items()]


def _by_stage(counts: dict[str, int]) -> dict[str, dict[str, int]]:
    return {stage: {name: int(counts[f"{stage}.{name}"]) for name in names} for stage, names in STAGES.items()}


class Progress:
    """Counts of one run. ``observed(df)`` is what the action has to use; ``counts()`` waits for its end."""

    def __init__(self) -> None:
        self.observation = Observation()

    def observed(self, processed: DataFrame) -> DataFrame:
        """Rows of ``process``, counted as they pass. Counts are those of the first action; a task that is repeated is counted once."""
        return processed.observe(self.observation, *_counts())

    def counts(self) -> dict[str, dict[str, int]]:
        return _by_stage(self.observation.get)


#: The name of observations in streams.
NAME = "palimpsest_stages"


def observed_stream(processed: DataFrame) -> DataFrame:
    """A stream of ``process`` whose batches report their counts to a ``StageListener``."""
    return processed.observe(NAME, *_counts())


class StageListener(StreamingQueryListener):
    """Calls ``told(batch, counts)`` for every batch of a stream made by ``observed_stream``. Add it by ``spark.streams.addListener``."""

    def __init__(self, told: Callable[[int, dict[str, dict[str, int]]], None]):
        self.told = told

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None:
            self.told(event.progress.batchId, _by_stage(row.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
