"""A Merkle manifest: one digest for a dataset, and for each row a proof that it belongs to it.

Rows become leaves, numbered within their tree (a language, say) without a window over a whole tree: a range
shuffle sorts digests, and row numbers follow from the partitions' counts. Bottom-up, ``FANOUT`` neighbours become
the digest of their digests; every level is a table in the shared folder, an eighth of the one below. The trees'
own roots are the leaves of a last tree, built alike. Top-down, each level joins its nodes to their parents, and
every child puts its siblings in front of the path that its parent has inherited.

Only digests move: the texts are read once, where they lie. Tables hold 32 bytes a digest; hash inputs are lower-case
hex text. Joins and groups go by (tree, number of a run of eight), so no tree is too large for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

FANOUT = 8
#: Bytes of a digest.
WIDTH = 32


def hexed(digest: Column) -> Column:
    """Binary digests as lower-case hex text."""
    return F.lower(F.hex(digest))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def field(value: Column) -> Column:
    """A value as UTF-8 byte count, ``:`` and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The binary digest of a row's values, in order. No two rows of different values share the text that is hashed."""
    return _digest(F.concat(*map(field, values)))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` as a table with ``pos``, the row's number within its tree, and ``n``, the tree's size.

    Rows equal in tree and ``order`` must be equal altogether: a salt deals them to several partitions.
    """
    keys = [tree, *order]
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys).drop("_salt")
    # the id's upper bits are the partition's number, the lower ones the row's number in it
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "nodes").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", tree).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    own = Window.partitionBy(tree)  # a row for each partition that holds a part of the tree
    before = F.coalesce(F.sum("_size").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", tree, (before - F.col("_first")).alias("_shift"), F.sum("_size").over(own).alias("n"))
    return placed.join(runs, ["_part", tree]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes from the leaves (``tree``, ``pos``, ``n``, ``node``) up; those above have ``kids``, the joined digests below.

    ``n`` is the number of the tree's nodes on the level. A tree ends with the level where it has one.
    """
    built = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        run = F.floor(F.col("pos") / FANOUT).cast("long")
        groups = built[-1].where("n > 1").groupBy("tree", run.alias("pos"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"))
        kids = groups.agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), F.hex("node").alias("hex")))).alias("kids"))
        joined = kids.withColumn("kids", F.array_join(F.transform("kids", lambda x: x["hex"]), ""))
        built.append(cut(joined.select("tree", "pos", "n", F.unhex("kids").alias("kids"), _digest(F.lower("kids")).alias("node")), "nodes"))
        most = -(-most // FANOUT)
    return built


def tops(built: list[DataFrame]) -> DataFrame:
    """(``tree``, ``node``) of each tree's last node."""
    found = [x.where("n = 1").select("tree", "node") for x in built]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def pushed(built: list[DataFrame], crown: DataFrame) -> DataFrame:
    """The leaves with ``path``, ``subroot`` and ``root``. ``crown``: for each tree, what its last node inherits.

    ``path`` lists, from the leaf up, the joined digests ``left`` and ``right`` of the node among its siblings.
    """
    above = None
    for level in reversed(built):
        last = level.where("n = 1").join(crown, "tree")
        if above is None:
            above = last
            continue
        parents = above.select("tree", F.col("pos").alias("_run"), F.col("kids").alias("_kids"), F.col("path").alias("_path"), "subroot", "root")
        place = F.pmod("pos", F.lit(FANOUT)).cast("int")
        kids = F.col("_kids")
        beside = F.struct(F.substring(kids, F.lit(1), WIDTH * place).alias("left"), F.substring(kids, WIDTH * (place + 1) + 1, F.lit(WIDTH * FANOUT)).alias("right"))
        inner = level.where("n > 1").withColumn("_run", F.floor(F.col("pos") / FANOUT).cast("long")).join(parents, ["tree", "_run"])
        above = inner.withColumn("path", F.concat(F.array(beside), "_path")).select(*last.columns).unionByName(last)
    return above


@dataclass
class Manifest:
    """Levels of the trees and of the tree over their roots, as tables in the shared folder."""

    trees: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """``root``: one row, none for an empty dataset."""
        return self.top[-1].where("n = 1").select(hexed(F.col("node")).alias("root"))

    def proofs(self) -> DataFrame:
        """The leaves with ``path``, ``subroot`` and ``root`` (binary), and the columns they were built with."""
        summit = self.top[-1].where("n = 1").select("tree", F.col("node").alias("root"))
        bare = F.array().cast("array<struct<left:binary,right:binary>>")
        crown = pushed(self.top, summit.select("tree", "root", F.lit(None).cast("binary").alias("subroot"), bare.alias("path")))
        return pushed(self.trees, crown.select(F.col("name").alias("tree"), F.col("node").alias("subroot"), "root", "path"))


def manifest(rows: DataFrame, tree: str, order: list[str], node: str) -> Manifest:
    """Trees over ``rows``: one for each value of ``tree``, null a value of its own and the first, leaves by ``order``, then by digest.

    ``node`` names the column of leaf digests. Nulls come first in every order. Repeated rows are leaves of their own.
    Further columns are carried to the proofs and should be functions of the order or the digest; columns
    named ``tree``, ``name``, ``pos``, ``n``, ``node``, ``kids``, ``path``, ``subroot`` or ``root`` are taken for the manifest's own.
    No rows give no proofs and no root.
    """
    # '-' sorts before ':'
    key = F.coalesce(F.concat(F.lit(":"), F.col(tree).cast("string")), F.lit("-"))
    # a table, since the range shuffle reads its input twice, the first time for a sample
    leaves = cut(rows.select(key.alias("tree"), F.col(node).alias("node"), *[c for c in rows.columns if c not in (tree, node)]), "leaves")
    trees = levels(numbered(leaves, "tree", [*order, "node"]))
    roots = tops(trees).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    return Manifest(trees, levels(numbered(roots, "tree", ["name"])))


def proof_text(path: Column) -> Column:
    """All siblings of a path as hex text, from the leaf up, left to right."""
    return F.lower(F.array_join(F.transform(path, lambda x: F.concat(F.hex(x["left"]), F.hex(x["right"]))), ""))


def folded(node: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf digest and its path lead to."""
    return F.aggregate(path, hexed(node), lambda a, x: F.sha2(F.concat(hexed(x["left"]), a, hexed(x["right"])), 256))
