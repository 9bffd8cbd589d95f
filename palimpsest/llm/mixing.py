"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies. Rates stay as near to one as the targets
allow, in relative entropy, and the words of each source at these rates make up its target. The solution
tilts every document exponentially by its size, ``rate = exp(lambda * size / unit)``, held below ``max_rate``;
``lambda`` belongs to the source and solves the convex dual. Newton steps on all duals run together, each
one an aggregation over (source, size) counts, with a bracket that a step may not leave.

Rates are then rounded into copies. A document has ``floor(rate)`` copies, and one more if its threshold
``1 - fraction - u`` lies below its source's cut, ``u`` being a hash of the id, the text and, among equal rows, a
number in [0, 1). The cut is found by refining a histogram of thresholds until the source's words pass the target
within one document, so the result misses the target by half a document's words at most, and reruns agree.

Nothing gathers a source: all steps are aggregations with partial sums, so one source may hold most rows.
Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, forget, word_parts

#: Newton steps; the bracket halves at least when a step would leave it.
STEPS = 40
#: Bins of a threshold histogram, and rounds of refinement. 256 ** 4 exceeds the resolution of u.
BINS, ROUNDS = 256, 4
WEIGHTS = (5.0, 2.0, 1.0)
MAX_RATE = 3.0


def n_words(text: Column) -> Column:
    """Column ``long``: words of a text; 0 for null."""
    return F.coalesce(F.size(F.array_remove(word_parts(text), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) with ``target``.

    Sources in order of their code points, null last, take the weights in turn. Targets share out the sum of
    all sizes by weight and stop at ``max_rate`` times a source's size; what is over goes to the other
    sources by weight, until none is above. The level that does so is found without iterating: sources stop
    in order of size to weight. Expects one row for each source.
    """
    # ranks and running sums over sources; a row is a source, so the single partition holds no documents
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    rows = sizes.withColumn("weight", weight).withColumn("limit", max_rate * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.encode("source", "utf-8"))
    every = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "stopped": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "free": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "all": F.sum("source_size").over(every),
        }
    )
    # the level as if this source and all behind it were free; it holds for the first source not stopped by it
    level = (F.col("all") - F.col("stopped")) / F.col("free")
    rows = rows.withColumn("level", level).withColumn("holds", F.col("limit") >= F.col("level") * F.col("weight"))
    found = F.min(F.when(F.col("holds"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(every)
    share = found["level"] * F.col("weight")
    return rows.withColumn("target", F.coalesce(F.least("limit", share), F.col("limit"))).select("source", "source_size", "target")


def solve(histogram: DataFrame, wanted: DataFrame, max_rate: float = MAX_RATE, steps: int = STEPS) -> DataFrame:
    """``wanted`` (``source``, ``source_size``, ``target``, ``unit``) with ``lam``, the solution of each source's dual.

    ``histogram``: ``h_source``, ``size``, ``n``, sizes above 0. ``unit`` is the largest size of the source.
    """
    x = F.col("size") / F.col("unit")
    # the bracket encloses the root: at its ends even the smallest size is at max_rate, or low enough for the target
    least = histogram.groupBy("h_source").agg(F.min("size").alias("least"))
    longest = F.coalesce(F.col("unit") / F.col("least"), F.lit(0.0))
    fall = F.coalesce(F.log(F.col("source_size") / F.when(F.col("target") > 0, F.col("target"))), F.lit(0.0))
    ends = {"lam": F.lit(0.0), "low": -1 - longest * F.greatest(fall, F.lit(0.0)), "high": 1 + longest * F.greatest(F.log(F.lit(max_rate)), F.lit(0.0))}
    state = cut(wanted.join(least, F.col("source").eqNullSafe(F.col("h_source")), "left").withColumns(ends).drop("h_source", "least"), "dual")
    for _ in range(steps):
        rate = F.least(F.exp(F.least(F.col("lam") * x, F.lit(50.0))), F.lit(max_rate))
        mass = F.col("n") * F.col("size")
        sums = (
            histogram.join(state, F.col("h_source").eqNullSafe(F.col("source")))
            .groupBy("source")
            .agg(F.sum(mass * rate).alias("got"), F.sum(F.when(rate < max_rate, mass * x * rate)).alias("slope"))
            .withColumnRenamed("source", "s_source")
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("high")).otherwise(F.col("lam"))
        newton = F.col("lam") - gap / F.col("slope")
        inside = F.coalesce((newton > F.col("new_low")) & (newton < F.col("new_high")), F.lit(False))
        moved = (
            state.join(sums, F.col("source").eqNullSafe(F.col("s_source")), "left")
            .withColumns({"new_low": low, "new_high": high})
            .withColumn("done", F.coalesce(F.abs(gap) <= 1e-9 * F.greatest(F.col("target"), F.lit(1.0)), F.lit(True)))
            .withColumn("next", F.when(F.col("done"), F.col("lam")).when(inside, newton).otherwise((F.col("new_low") + F.col("new_high")) / 2))
        )
        before, state = state, cut(moved.select("source", "source_size", "target", "unit", F.col("next").alias("lam"), F.col("new_low").alias("low"), F.col("new_high").alias("high"), "done"), "dual")
        forget(before)
        if state.where("not done and high - low > 1e-12 * (1 + abs(lam))").isEmpty():
            break
    return state.select("source", "source_size", "target", "unit", "lam")


def _sources(df: DataFrame, by_source: DataFrame) -> DataFrame:
    """``df`` with the columns of the row of its ``source``; null matches null."""
    return df.withColumnRenamed("source", "_source").join(by_source, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")


def _rated(sized: DataFrame, duals: DataFrame, max_rate: float) -> DataFrame:
    """``whole`` copies of each document and the ``threshold`` in [0, 1) below which it gets one more."""
    x = F.col("size") / F.col("unit")
    # a full target leaves no choice: every document is taken max_rate times
    full = F.col("target") >= max_rate * F.col("source_size")
    rate = F.when(full, F.lit(max_rate)).otherwise(F.least(F.exp(F.least(F.col("lam") * x, F.lit(50.0))), F.lit(max_rate)))
    whole = F.least(F.floor(F.col("rate") + 1e-9), F.lit(int(max_rate)))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "size", "mark", "turn"), 11) / F.lit(float(1 << 53))
    open_ = (F.col("size") > 0) & (F.col("whole") < max_rate)
    joined = _sources(sized, duals).withColumn("rate", rate).withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(1))
    return joined.withColumn("threshold", F.when(open_, (2 - (F.col("rate") - F.col("whole")) - u) / 2))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """A row for each source: ``source``, ``source_size``, ``target``, ``unit``, ``lam`` and ``cut``.

    ``sized``: ``doc_id``, ``source``, ``size`` of all documents.
    """
    counts = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.max("size").cast("double").alias("unit"))
    goals = targets(totals.select("source", "source_size"), weights, max_rate)
    wanted = cut(_sources(goals, totals.select("source", "unit")), "targets")
    duals = cut(solve(counts.where("size > 0").withColumnRenamed("source", "h_source"), wanted, max_rate), "duals")

    rated = cut(_rated(sized, duals, max_rate).select("source", "target", "size", "whole", "threshold"), "rates")
    base = rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("base"), F.first("target").alias("target"))
    cuts = cut(base.select("source", (F.col("target") - F.col("base")).alias("need"), F.lit(0.0).alias("at"), F.lit(1.0).alias("width")), "cuts")
    undecided = rated.where("threshold is not null").select("source", "size", "threshold")
    for turn in range(ROUNDS):
        place = F.least(F.floor((F.col("threshold") - F.col("at")) / F.col("width") * BINS), F.lit(BINS - 1))
        inside = _sources(undecided, cuts).where("threshold >= at and threshold < at + width")
        bins = inside.groupBy("source", "need", place.alias("bin")).agg(F.sum("size").alias("words"))
        # a source has BINS rows here at most
        summed = bins.withColumn("sum", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        passed = "sum - words / 2 > need" if turn == ROUNDS - 1 else "sum > need"
        crossing = summed.where(passed).groupBy("source").agg(F.min(F.struct("bin", "sum", "words")).alias("c"))
        crossing = crossing.select(F.col("source").alias("c_source"), F.col("c.bin").alias("bin"), (F.col("c.sum") - F.col("c.words")).alias("before"))
        # a source whose bins all fit takes them all: its cut moves to their end
        every = F.col("bin").isNull()
        cuts = cut(
            cuts.join(crossing, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
                "source",
                F.when(every, F.col("need")).otherwise(F.col("need") - F.col("before")).alias("need"),
                F.when(every, F.col("at") + F.col("width")).otherwise(F.col("at") + F.col("bin") * F.col("width") / BINS).alias("at"),
                F.when(every, F.lit(0.0)).otherwise(F.col("width") / BINS).alias("width"),
            ),
            "cuts",
        )
    return cut(_sources(duals, cuts.select("source", F.col("at").alias("cut"))), "plan")


def copies(sized: DataFrame, by_source: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """``sized``, with any further columns, and ``source_size``, ``target``, ``copies`` and ``taken``."""
    more = F.coalesce(F.col("threshold") < F.col("cut"), F.lit(False)).cast("long")
    found = _rated(sized, by_source, max_rate).withColumn("copies", F.col("whole").cast("long") + more)
    return found.withColumn("taken", F.col("copies") * F.col("size")).drop("unit", "lam", "cut", "rate", "whole", "threshold")


def _numbered(sized: DataFrame) -> DataFrame:
    """``sized`` as a table with ``turn``, a number among equal rows, so that each has a threshold of its own.

    Equal rows are numbered within their partition first, and each partition starts behind those before it: no task meets
    all rows of one value.
    """
    keys = ["doc_id", "source", "size", "mark"]
    placed = cut(sized.withColumn("_row", F.monotonically_increasing_id()), "sizes").withColumn("_part", F.shiftright("_row", 33))
    own = placed.withColumn("_turn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_row")))
    # only rows that meet their like in several partitions need the parts before
    counts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.withColumn("_before", before).where("_before is not null").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), "_before")
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = own.join(shifts, same, "left")
    return cut(met.select(*keys, (F.col("_turn") + F.coalesce("_before", F.lit(0))).cast("long").alias("turn")), "sizes")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``), a row for each row of ``docs``.

    ``size`` counts words, ``taken`` is ``copies * size``. Null texts have size 0 and one copy, as have all
    texts without words. A null source is a source of its own, last in order. Repeated rows, and rows without an id, are documents
    of their own: some may be taken more often than others. A source without words has target 0. No documents give no rows.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("mark"))
    sized = _numbered(sized)
    return copies(sized, plan(sized, weights, max_rate), max_rate).drop("mark", "turn")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """The mix itself: each row of ``docs`` (``doc_id``, ``source``, ``text``, ...) as often as its copies say.

    As ``mix``, but rows equal in id, source and text have equally many copies each, so a target that they make up is met
    within their words only.
    """
    columns = docs.columns
    sizes = ["doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), F.lit(0).cast("long").alias("turn")]
    sized = cut(docs.select(*sizes), "sizes")
    found = copies(docs.select(F.struct(*columns).alias("_row"), *sizes), plan(sized, weights, max_rate), max_rate)
    return found.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
