"""Near-duplicates by exact Jaccard similarity of word shingles, found with minhash bands.

Texts link where their sets of ``words``-word shingles have a similarity of ``SIMILARITY`` or more; a group is
what links reach. Texts of equal sets are one node.

*Candidates.* Each set has ``BANDS`` keys of ``ROWS`` minima under different hashes each. Two sets of
similarity s share a key with probability ``1 - (1 - s ** ROWS) ** BANDS``: at 0.8 one link in 50,000 is
missed, above it fewer. Nodes meet by way of the least node of a key, so a key costs as many rows as it has
nodes, and components of these meetings hold all candidate pairs.

*Exact check.* The texts of a component's nodes go to one cell, where all pairs are compared by their shingles
and links unite them. A component of over ``CELL`` nodes, or ``CELL_SHINGLES`` shingles, is cut into parts, and each pair of
parts has a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, per_task, release
from palimpsest.llm.components import components
from palimpsest.llm.simhash import fingerprint, first_of_groups, groups, shingle_hashes

#: Links have a similarity of NUMERATOR / DENOMINATOR or more.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 36, 6
#: Nodes and shingles of a part of a large component; a cell holds two parts at most.
CELL, CELL_SHINGLES = 2_000, 400_000
#: Rows that ``_cells`` hands on at once.
OUT_ROWS = 100_000

_RNG = np.random.default_rng(11)
_FACTORS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; none without words."""
    return np.unique(shingle_hashes(text, words))


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys under which a set meets others; none for the empty set, which is one node anyway."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(hashes), 512):
        mixed = (hashes[None, k : k + 512] ^ _MASKS[:, None]) * _FACTORS[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _FACTORS[::-1, None]
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def _node(text: Column, words: int) -> Column:
    def batch(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([node_of(shingle_set(x.as_py(), words)) for x in texts], np.int64))

    return per_task(text, lambda: batch, "long")


def _described(text: Column, words: int) -> Column:
    def batch(texts: pa.Array) -> pa.Array:
        nodes, sizes, keys = [], [], []
        for x in texts:
            own = shingle_set(x.as_py(), words)
            nodes.append(node_of(own))
            sizes.append(len(own))
            keys.append(band_keys(own))
        ends = np.append(0, np.cumsum([len(x) for x in keys])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
        return pa.StructArray.from_arrays([pa.array(np.array(nodes, np.int64)), pa.array(np.array(sizes, np.int64)), lists], ["node", "n_shingles", "keys"])

    return per_task(text, lambda: batch, "struct<node:long,n_shingles:long,keys:array<long>>")


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, the least index of a set that links between them reach."""
    label = np.arange(len(sets))
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    values, place = np.unique(np.concatenate([sets[i] for i in order] or [np.zeros(0, np.uint64)]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    inside = np.zeros(len(values), bool)
    for i in range(len(order)):
        # a set of over DENOMINATOR / NUMERATOR times the size cannot link
        last = int(np.searchsorted(sizes, sizes[i] * DENOMINATOR // NUMERATOR, side="right"))
        others = np.arange(i + 1, last)
        others = others[label[order[others]] != label[order[i]]]
        if not len(others):
            continue
        inside[place[starts[i] : starts[i] + sizes[i]]] = True
        united = [label[order[i]]]
        for k in range(0, len(others), 64):
            part = others[k : k + 64]
            n = sizes[part]
            at = np.cumsum(n) - n
            taken = np.repeat(starts[part] - at, n) + np.arange(int(n.sum()))
            both = np.add.reduceat(inside[place[taken]], at, dtype=np.int64)
            near = DENOMINATOR * both >= NUMERATOR * (sizes[i] + n - both)
            united.extend(label[order[part[near]]])
        inside[place[starts[i] : starts[i] + sizes[i]]] = False
        if len(united) > 1:
            label[np.isin(label, united)] = min(united)
    return label


def _cells(words: int):
    """Spanning forests of the links in the cells of a partition that is sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi: list[int] = []
        lo: list[int] = []
        now, nodes, sets = None, [], []

        def finish() -> None:
            label = linked(sets)
            for i in np.flatnonzero(label != np.arange(len(nodes))):
                hi.append(nodes[i])
                lo.append(nodes[label[i]])

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])
            hi.clear()
            lo.clear()
            return found

        for batch in batches:
            for cell, node, text in zip(batch.column("cell").to_pylist(), batch.column("node").to_pylist(), batch.column("text")):
                if cell != now:
                    finish()
                    now, nodes, sets = cell, [], []
                    if len(hi) > OUT_ROWS:
                        yield out()
                nodes.append(node)
                sets.append(shingle_set(text.as_py(), words))
        finish()
        yield out()
        sets = nodes = None
        release()

    return run


def candidates(own: DataFrame, radius: int | None = None) -> DataFrame:
    """(``node``, ``root``) of nodes that share a key or a group of fingerprints with another; all candidate pairs are of one root."""
    met = band_links(own)
    return components(met if radius is None else fingerprint_links(own, radius).unionByName(met))


def band_links(own: DataFrame) -> DataFrame:
    """Edges (``hi``, ``lo``) between nodes that share a key and the least node of it."""
    met = own.select("node", F.explode("keys").alias("key")).distinct()
    least = met.groupBy("key").agg(F.min("node").alias("lo"), F.count("*").alias("n")).where("n > 1").drop("n")
    return met.join(least, "key").where("node <> lo").select(F.col("node").alias("hi"), "lo").distinct()


def links(docs: DataFrame, own: DataFrame, words: int = 5, radius: int | None = None) -> DataFrame:
    """Edges (``hi``, ``lo``) between nodes whose components are those of all links that were candidates."""
    met = cut(candidates(own, radius), "candidates")
    weighed = met.join(own.groupBy("node").agg(F.min("n_shingles").alias("n")), "node")
    parts = F.ceil(F.greatest(F.count("*") / CELL, F.sum("n") / CELL_SHINGLES)).cast("int")
    sized = met.join(weighed.groupBy("root").agg(parts.alias("parts")), "root")
    texts = docs.select(_node(F.col("text"), words).alias("node"), "text").groupBy("node").agg(F.min("text").alias("text"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("root", F.least(part, j), F.greatest(part, j)))
    dealt = texts.join(sized, "node").select("node", "text", F.explode(cells).alias("cell"))
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(words), "hi long, lo long")


def fingerprint_links(own: DataFrame, radius: int) -> DataFrame:
    """Edges (``hi``, ``lo``) between nodes whose texts are of one group of fingerprints (``simhash.groups``)."""
    found = groups(own.select("doc_id", "fingerprint"), radius).select("fingerprint", "root")
    met = own.select("node", "fingerprint").distinct().join(found, "fingerprint").select("node", "root").distinct()
    least = met.groupBy("root").agg(F.min("node").alias("lo"), F.count("*").alias("n")).where("n > 1").drop("n")
    return met.join(least, "root").where("node <> lo").select(F.col("node").alias("hi"), "lo")


def keep_one(docs: DataFrame, words: int = 5, radius: int | None = None) -> DataFrame:
    """The document of the smallest id of each group, with all columns of ``docs``.

    ``radius``: if given, texts whose fingerprints (``simhash``, 4-word shingles) differ in as many bits or fewer are candidates too,
    checked like those of the bands.
    Null and wordless texts are of one group. Where ids are null or repeated, ties go to the first text in
    order, and one row of equal rows stays.
    """
    prints = [] if radius is None else [fingerprint(F.col("text")).alias("fingerprint")]
    own = cut(docs.select("doc_id", _described(F.col("text"), words).alias("_d"), *prints).select("doc_id", "_d.*", *(["fingerprint"] if prints else [])), "minhashes")
    roots = components(links(docs, own, words, radius))
    least = own.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = cut(least.join(roots, "node", "left").select(F.col("node").alias("fingerprint"), "least", F.coalesce("root", "node").alias("root")), "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return first_of_groups(docs, own.select("doc_id"), rooted.join(named, "root").select("fingerprint", "root", "component_id"), _node(F.col("text"), words))
