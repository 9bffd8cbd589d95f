"""SimHash near-duplicates, searched with vantage-point trees.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a text's shingles. Fingerprints
link at ``radius`` or fewer differing bits; a group is what links reach.

*Metric.* Random fingerprints lie some 32 bits apart, give or take four, so a ball of radius four straddles nearly
every shell around a vantage point on all 64 bits, and such a tree prunes next to nothing. The bits are therefore
shared out to ``radius // 2 + 1`` parts, each a metric space of its own with a tree of its own: two linked fingerprints are at
Hamming distance 1 or less in at least one part, and there distances to a vantage point spread over two or three
times that.

*Shards.* The upper levels of each tree are laid out by Spark. Vantage points are fingerprints of the table, one for each
level; around it lie shells ``SHELL`` bits wide. By the triangle inequality the ends of a link in
this part lie at distances to a vantage point that differ by 1 at most, so a fingerprint belongs to its own shell and also visits
the next one if it lies at the boundary. A shard is one shell of every vantage point; both ends of a link meet in at least one. Levels follow
from the number of fingerprints, so that a shard holds about ``SHARD``.

*Large shards*, as of a huge group of near copies, are dealt out as pairs of parts of ``PART`` fingerprints.

*Within a shard* the lower levels are a vantage-point tree in numpy: medians of distances divide the shard, branches are pruned by triangle bounds
on the part's bits, leaves are compared on all 64, and what comes out is a spanning forest of the links, not the pairs. Components of
all shards' forests are components of all links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, per_task
from palimpsest.llm.components import components

#: Fingerprints that a shard should hold, bits of a shell, and vantage points at most: more would only copy more.
SHARD, SHELL, LEVELS = 2_000, 3, 16
#: Fingerprints of a part of a shard that came out too large.
PART = 20_000
#: Fingerprints of a leaf of the tree in a shard.
LEAF = 128


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """Hashes of all shingles of a text in order; of the whole text where it is shorter, none without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = list(itertools.accumulate(len(x) + 1 for x in parts))
    spans = zip([0, *ends], ends[words - 1 :])
    return np.array([digest(joined[a : b - 1], 42) for a, b in spans], np.uint64)


def simhash(text: str | None, words: int = 4) -> int:
    """Fingerprint of one text; 0 without words."""
    hashes = shingle_hashes(text, words)
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint16)
    major = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(major.view(np.uint64)[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """Column ``long``: the fingerprint of a text. Null and wordless texts have fingerprint zero."""

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(x.as_py(), words) for x in texts], np.uint64).view(np.int64))

    return per_task(text, lambda: batch, "long")


class Forest:
    """Union of links between the rows of one shard. ``mask``, ``reach``: a part of the bits and the distance there within which links are sought."""

    def __init__(self, points: np.ndarray, radius: int, mask: int = (1 << 64) - 1, reach: int | None = None):
        self.points, self.radius = points, radius
        self.mask, self.reach = np.uint64(mask), radius if reach is None else reach
        self.label = np.arange(len(points))
        rows = np.arange(len(points))
        self._search(self._build(rows), rows)

    def _distance(self, rows: np.ndarray, vantage: int) -> np.ndarray:
        return np.bitwise_count((self.points[rows] ^ self.points[vantage]) & self.mask).astype(np.int64)

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label[:] = jumped

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage, rest = rows[0], rows[1:]
        d = self._distance(rest, vantage)
        bound = int(np.median(d))
        near = d <= bound
        if near.all():  # no shell divides them: they are compared with each other
            return rows
        return vantage, bound, self._build(rest[near]), self._build(rest[~near])

    def _search(self, node, queries: np.ndarray) -> None:
        if not len(queries):
            return
        if not isinstance(node, tuple):
            step = max(1, (1 << 20) // len(node))
            for k in range(0, len(queries), step):
                own = queries[k : k + step]
                close = np.bitwise_count(self.points[own][:, None] ^ self.points[node][None, :]) <= self.radius
                a, b = np.nonzero(close)
                self._link(own[a], node[b])
            return
        vantage, bound, near, far = node
        d = self._distance(queries, vantage)
        close = queries[np.bitwise_count(self.points[queries] ^ self.points[vantage]) <= self.radius]
        self._link(close, np.full(len(close), vantage))
        self._search(near, queries[d - self.reach <= bound])
        self._search(far, queries[d + self.reach > bound])


def part_masks(radius: int) -> list[int]:
    """Masks of ``radius // 2 + 1`` parts that share out the 64 bits: fingerprints within ``radius`` differ in 1 bit at most of one part."""
    n = radius // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _forests(radius: int):
    """Spanning forests of the shards in a partition that is sorted by shard."""
    masks = part_masks(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(tree: np.ndarray, shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            hi, lo = [], []
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shard)]):
                if b - a > 1:
                    points = np.unique(fp[a:b])
                    label = Forest(points, radius, masks[tree[a]], min(1, radius)).label
                    moved = np.flatnonzero(label != np.arange(len(points)))
                    hi.append(points[moved])
                    lo.append(points[label[moved]])
            none = np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [none]).view(np.int64)) for x in (hi, lo)], ["hi", "lo"])

        # rows of the shard that is not yet complete, as pieces of batches
        open_: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            rows = tuple(batch.column(c).to_numpy() for c in ("tree", "shard", "fp"))
            if not len(batch):
                continue
            last = int(np.searchsorted(rows[1], rows[1][-1]))
            if last or (open_ and open_[-1][1][-1] != rows[1][-1]):
                whole = [np.concatenate([*(x[i] for x in open_), rows[i][:last]]) for i in range(3)]
                yield links(whole[0], whole[1], whole[2].view(np.uint64))
                open_ = []
            open_.append(tuple(x[last:] for x in rows))
        if open_:
            whole = [np.concatenate([x[i] for x in open_]) for i in range(3)]
            yield links(whole[0], whole[1], whole[2].view(np.uint64))

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def vantage_points(fps: DataFrame) -> list[int]:
    """Fingerprints of the least hashes, one for each level that the table's size asks for; ``LEVELS`` at most."""
    # a shell holds two fifths of a level's fingerprints at most, with a visitor to each third of them
    levels = min(LEVELS, math.ceil(math.log(max(1, fps.count() / SHARD)) / math.log(2.5)))
    return [r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(levels).collect()] if levels else []


def visits(fps: DataFrame, vantage: list[int], radius: int = 4) -> DataFrame:
    """(``fp``, ``tree``, ``shard``) for the shard of each fingerprint ``fp`` in each tree, and for those that it visits."""
    reach = min(1, radius)

    def shards(tree: int, mask: int) -> Column:
        paths = F.array(F.xxhash64(F.lit(tree)))
        for v in vantage:
            d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(v)).bitwiseAND(F.lit(_signed(mask))))
            home = F.floor(d / F.lit(SHELL)).cast("int")
            shells = F.when(F.pmod(d, F.lit(SHELL)) >= SHELL - reach, F.array(home, home + 1)).otherwise(F.array(home))
            paths = F.flatten(F.transform(paths, lambda p: F.transform(shells, lambda h: F.xxhash64(p, h))))
        return F.transform(paths, lambda p: F.struct(F.lit(tree).alias("tree"), p.alias("shard")))

    every = F.concat(*[shards(i, m) for i, m in enumerate(part_masks(radius))])
    return fps.select("fp", F.explode(every).alias("x")).select("fp", "x.tree", "x.shard")


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (``hi``, ``lo``) whose components are those of all links between distinct fingerprints ``fp``."""
    cells = visits(fps, vantage_points(fps), radius)
    large = cut(cells.groupBy(F.col("shard").alias("large")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1"), "large")
    if not large.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        dealt = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("shard", F.least(own, j), F.greatest(own, j)))
        sized = cells.join(large, F.col("shard") == F.col("large"), "left")
        cells = sized.select("fp", "tree", F.explode(F.when(F.col("parts").isNull(), F.array("shard")).otherwise(dealt)).alias("shard"))
    return cells.repartition("shard").sortWithinPartitions("shard").mapInArrow(_forests(radius), "hi long, lo long")


def groups(fingerprints: DataFrame, radius: int = 4) -> DataFrame:
    """(``fingerprint``, ``root``, ``component_id``) for each fingerprint of ``doc_id``, ``fingerprint`` rows.

    ``root`` names the group, ``component_id`` is its smallest id, null if no row of it has one.
    """
    fps = fingerprints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    roots = components(links(fps.select("fp"), radius))
    rooted = cut(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(``doc_id``, ``fingerprint``, ``component_id``), a row for each row of ``docs``.

    ``fingerprint`` is a long, ``component_id`` the smallest id that links reach, itself included. Null and
    wordless texts share fingerprint zero and so link to each other. Rows without an id get the component
    of their fingerprint but name none. Texts are hashed whole; equal fingerprints are searched once.
    """
    own = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), words).alias("fingerprint")), "fingerprints")
    return own.join(groups(own, radius), "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The document of the smallest id of each group, with all columns of ``docs``.

    Where ids are null or repeated, ties go to the first text in order, and one row of equal rows stays.
    """
    own = cut(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fingerprint")), "fingerprints")
    return first_of_groups(docs, own, groups(own, radius), fingerprint(F.col("text"), words))


def first_of_groups(docs: DataFrame, own: DataFrame, groups: DataFrame, key: Column) -> DataFrame:
    """The first row of ``docs`` of each of ``groups`` (``fingerprint``, ``root``, ``component_id``).

    ``own``: the ids of all rows. ``key``: the fingerprint of a row of ``docs``.
    """
    found = cut(groups, "groups")
    plain = own.where("doc_id is null").isEmpty() and own.groupBy("doc_id").count().where("count > 1").isEmpty()
    if plain:
        first = found.select(F.col("component_id").alias("doc_id")).distinct()
        return docs.join(first, "doc_id", "left_semi")
    named = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("fingerprint")).join(found, "fingerprint")
    order = Window.partitionBy("root").orderBy(F.col("_row.doc_id").asc_nulls_last(), F.col("_row.text"))
    return named.withColumn("_place", F.row_number().over(order)).where("_place = 1").select("_row.*")
