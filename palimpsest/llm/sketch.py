"""Fingerprints of documents: all shingle hashes below a fixed threshold.

A text's words, A-Z in lower case, form shingles of five (fewer words: one shingle of all). A shingle's hash is the XXH64,
seed 42, of its words joined by blanks, the same as Spark's ``xxhash64``. The fingerprint keeps every hash below
``2**64 / SCALE``, whatever a text's length: two fingerprints sample the same part of hash space, so a text's share in a
text or a source thousands of times its size can be told, and the fingerprint of a union is the union of fingerprints. Where
no hash is below, the smallest one is kept in its place, which unions respect (see ``united``).

Written form: 16 hex digits a hash, ascending; texts without words have the empty fingerprint.

``in_order`` brings each document together with its neighbour in the order of ids without a window over all rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import per_task, release

WORDS = 5
#: One hash in so many is kept.
SCALE = 8
SEED = 42
BELOW = np.uint64((1 << 64) // SCALE)
#: Bytes of a long text that are shingled at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t\n\r\x0b\f]")


def _hashes(words: list[bytes], n: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    xx = xxhash.xxh64_intdigest
    return np.fromiter((xx(joined[a : e - 1], SEED) for a, e in zip([0, *ends], ends[n - 1 :])), np.uint64, len(words) - n + 1)


def _reduced(hashes: np.ndarray) -> np.ndarray:
    below = hashes[hashes < BELOW]
    return np.unique(below) if len(below) else hashes[hashes == hashes.min()][:1] if len(hashes) else hashes


def sketch(text: str | None, n: int = WORDS) -> np.ndarray:
    """A text's kept hashes (uint64, ascending). Long texts go by pieces of about ``PIECE`` bytes that share ``n - 1`` words."""
    data = (text or "").encode().lower()  # bytes: A-Z only
    found, words, at = [], [], 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        words += data[at:end].split()  # bytes: blank and U+0009 to U+000D only
        if len(words) >= n:
            found.append(_reduced(_hashes(words, n)))
            words = words[len(words) - n + 1 :]
        at = end
    if not found and words:
        found.append(_hashes(words, len(words)))
    return _reduced(np.concatenate(found)) if found else np.empty(0, np.uint64)


def united(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of two texts' shingles together."""
    return _reduced(np.union1d(a, b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the share of common shingles among all of two texts; two texts without words are alike, one with and one without are not."""
    every = united(a, b)
    return len(np.intersect1d(np.intersect1d(a, b, True), every, True)) / len(every) if len(every) else 1.0


def contained(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimate of the share of ``a``'s shingles that ``b`` has; None where ``a`` has no hash below the threshold and ``b`` has."""
    if not len(a):
        return 1.0
    if a[0] >= BELOW and len(b) and b[0] < BELOW:
        return None
    return len(np.intersect1d(a, b, True)) / len(a)


def written(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def parsed(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint or ""), ">u8").astype(np.uint64)


def fingerprint(text: Column) -> Column:
    """Column: the written fingerprint of a text; null counts as empty."""
    return per_task(text, lambda: lambda batch: pa.array([written(sketch(x)) for x in batch.to_pylist()], pa.string()), "string")


def hash_rows(fingerprints: DataFrame, keys: list[str], column: str = "fingerprint") -> DataFrame:
    """(keys, ``hash``): a row for each different hash of each group of fingerprints, 16 hex digits; null fingerprints have none.

    The fingerprint of a union, as rows, so that no group has to fit a task. A group of fingerprints without a hash below the
    threshold keeps its smallest. Repeated rows change nothing. Groups without words have no rows.
    """
    size = F.floor(F.length(column) / 16).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(F.col(column), 16 * i + 1, F.lit(16)))
    rows = fingerprints.where(F.length(column) > 0).select(*keys, F.explode(hashes).alias("hash")).distinct()
    limit = f"{int(BELOW):016x}"
    low = rows.where(F.col("hash") < limit)
    least = rows.where(F.col("hash") >= limit).groupBy(*keys).agg(F.min("hash").alias("hash"))
    same = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    return low.unionByName(least.alias("_l").join(low.select(*keys).distinct().alias("_r"), same, "left_anti"))


def containment(fingerprints: DataFrame, groups: DataFrame, doc_id: str = "doc_id", group: str = "source", column: str = "fingerprint") -> DataFrame:
    """(``doc_id``, ``group``, ``n_hashes``, ``n_shared``, ``contained``): how much of each document lies in each group.

    ``groups``: rows of ``hash_rows`` by ``group``. Only pairs with a common hash have a row. Documents are told apart by
    id; repeated ids count as one document of all their hashes.
    """
    own = hash_rows(fingerprints, [doc_id], column)
    total = own.groupBy(doc_id).agg(F.count("*").alias("n_hashes"))
    shared = own.join(groups.select(F.col(group).alias("_group"), "hash"), "hash").groupBy(doc_id, "_group").agg(F.count("*").alias("n_shared"))
    met = shared.withColumnRenamed(doc_id, "_doc").join(total, F.col("_doc").eqNullSafe(F.col(doc_id)))
    return met.select(doc_id, F.col("_group").alias(group), "n_hashes", "n_shared", (F.col("n_shared") / F.col("n_hashes")).alias("contained"))


#: Groups of neighbouring ids at most, and parts by text hash of a group of one id.
GROUPS, PARTS = 10_000, 64


def _numbered(docs: DataFrame, partitions: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (``doc_id``, ``text``) with ``h`` and ``group``, and a row for each group: its number ``i`` in descending order of ids, its first row.

    Groups are ranges of ids between quantiles. Ids that fill several steps, and rows without an id, are spread by the hashes
    of their texts.
    """
    steps = min(GROUPS, 8 * partitions)
    marks, nulls = docs.agg(F.percentile_approx("doc_id", [i / steps for i in range(steps + 1)], 10 * steps), F.count_if(F.col("doc_id").isNull())).first()
    hot = sorted({a for a, b in zip(marks or [], (marks or [])[1:]) if a == b})
    edges = sorted({float(x) for x in marks or [0]})  # as doubles ids keep their order
    buckets = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_x", outputCol="_b", handleInvalid="keep")

    def grouped(rows: DataFrame) -> DataFrame:
        spread = F.col("doc_id").isNull() | (F.col("doc_id").isin(hot) if hot else F.lit(False))
        part = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 58)  # the upper six bits, in order of signed hashes
        bucket = F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(len(edges) - F.col("_b").cast("int"))
        found = buckets.transform(rows.withColumn("_x", F.col("doc_id").cast("double")))
        return found.withColumn("group", bucket.cast("long") * PARTS + F.when(spread, part).otherwise(0)).drop("_x", "_b")

    hashed = bool(hot or nulls)  # else the ids alone are read
    seen = grouped(docs.select("doc_id", (F.xxhash64("text") if hashed else F.lit(0).cast("long")).alias("h")))
    firsts = seen.groupBy("group").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("flip"), "h")).alias("first"))
    rows = sorted((r.group, r.flip, r.h) for r in firsts.select("group", "first.flip", "first.h").collect())  # GROUPS * PARTS rows at most
    facts = [(g, i, None if flip is None else ~flip, h if hashed else None) for i, (g, flip, h) in enumerate(rows)]
    return grouped(docs.withColumn("h", F.xxhash64("text"))), docs.sparkSession.createDataFrame(facts, "group long, i int, first_id long, first_h long")


def in_order(docs: DataFrame) -> DataFrame:
    """(``i``, ``visitor``, ``doc_id``, ``text``): groups of documents in descending order of ids, each followed by the first row of the next group.

    A partition holds whole groups, sorted. The last group is followed by the first row of all. Rows without an id come last, rows
    of one id in order of their texts' hashes.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, groups = _numbered(docs, partitions)
    n = groups.count()
    met = rows.join(F.broadcast(groups), "group")
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("first_h").isNull() | (F.col("first_h") == F.col("h")))
    own = F.struct(F.col("i").alias("i"), F.lit(False).alias("visitor"))
    visit = F.struct(F.pmod(F.col("i") - 1, F.lit(max(n, 1))).cast("int").alias("i"), F.lit(True).alias("visitor"))
    dealt = met.select("doc_id", "text", "h", F.explode(F.when(first, F.array(own, visit)).otherwise(F.array(own))).alias("x")).select("x.*", "doc_id", "text", "h")
    placed = dealt.repartitionById(partitions, F.floor(F.col("i").cast("long") * partitions / max(n, 1)).cast("int"))
    return placed.sortWithinPartitions("i", "visitor", F.col("doc_id").desc_nulls_last(), "h").drop("h")


def edited(text: str, following: str) -> str:
    """``text``, its last third replaced with as many code points, or all, from the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    before = None  # the document that waits for the next one: group, id, text, hashes
    for batch in batches:
        at = zip(*(batch.column(c) for c in ("i", "visitor", "doc_id", "text")))
        for i, visitor, doc, text in ((a.as_py(), b.as_py(), c.as_py(), d.as_py()) for a, b, c, d in at):
            if visitor and (before is None or before[0] != i):
                continue  # equal first rows of the next group: one has been met
            own = sketch(text)
            if before is not None:
                group, doc_before, text_before, hashes = before
                if group != i:
                    raise ValueError(f"group {group} has no last row")
                changed = edited(text_before, text)
                other = sketch(changed)
                digest = hashlib.sha256(changed.encode()).hexdigest()
                rows.append((doc_before, len(text_before), digest, written(hashes), written(other), likeness(hashes, other), likeness(hashes, own)))
            before = None if visitor else (i, doc, text, own)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)
                rows = []
    if before is not None:
        raise ValueError(f"group {before[0]} has no last row")
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)
    release()


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likeness to that and to the next document's.

    The next document is that of the next smaller id; after the smallest comes the greatest. Rows without an id are the smallest;
    rows of one id follow each other by their texts' hashes, so repeated rows are each other's next. A null text counts as empty. A
    single document is its own next. No documents give no rows. Each text is shuffled once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return in_order(rows).mapInArrow(_compared, _OUT)
