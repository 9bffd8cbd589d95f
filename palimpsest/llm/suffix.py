"""Removal of repeated passages by ranks of anchors, in place of prefix doubling over all positions.

A byte of a document goes if a string of ``length`` bytes that covers it also starts in a document with a
smaller id. Deciding this with a suffix array means ranking positions by ever longer prefixes until a rank
is unique or ``length`` bytes long. Ranking every byte position is more than needed: each string of
``length`` bytes names one of its own positions, its *anchor*, by its content alone, so equal strings have
equal anchors, and ranks of anchors decide about all strings around them. About one byte in seventeen is an
anchor (a mod-minimizer, Groot Koerkamp and Pibiri 2024).

Rank rounds, each a sort by Spark of (rank, position) pairs in which unique ranks drop out:

1. the ``k`` bytes from the anchor on (31 of 50), together with a rank of all strings the anchor stands for;
2. the pair of that rank and the rank of the ten bytes at the next offset, before and behind;
3. the pair of the first rank and the rank of all ``length`` bytes.

Most repeats end in round 1: where all documents agree on every string of an anchor, the smallest id keeps
its bytes and the others lose them. Rounds 2 and 3 see the edges of repeats only. Ranks are 64-bit hashes of
content, or 48-bit where they only tell strings of one anchor apart; the decisive pairs are 112 bits wide or
more.

Hot passages: rows of one rank go through a sort and a spilling window, never into memory at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import aside, cut, per_task, release, released

#: Bytes that are hashed together; longer texts are cut into overlapping blocks.
BLOCK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any substrings of a block, from one prefix sum."""

    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(self._up) < n:
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            for name, base in (("_up", _ODD), ("_down", inverse)):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(Hashes, name, np.cumprod(powers, dtype=np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * self._down[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self._up[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self._up[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


class Scheme:
    """Sizes that follow from the string length."""

    def __init__(self, length: int):
        if length < 20:
            raise ValueError("strings shorter than 20 bytes have no useful anchors")
        self.length = length
        self.w = 2 * length // 5  # positions at which an anchor may lie in its string
        self.k = length - self.w + 1  # bytes that all strings of an anchor share
        self.t = 4 + (self.k - 4) % self.w  # bytes that are compared to choose an anchor
        self.half = self.w // 2


def anchors(data: np.ndarray, ends: np.ndarray, s: Scheme, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, last string) of each run of strings with one anchor.

    ``ends``: for each byte, where its text ends; no string crosses that.
    """
    n = len(data) - s.length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty
    at = np.arange(len(data), dtype=np.uint64)
    small = hashes.all(s.t)
    least = sliding_min((small & ~np.uint64((1 << 24) - 1)) | at[: len(small)], s.length - s.t + 1)
    p = np.flatnonzero(ends[:n] - np.arange(n) >= s.length)
    if not len(p):
        return empty, empty, empty
    anchor = p + ((least[p] & np.uint64((1 << 24) - 1)).astype(np.int64) - p) % s.w
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return anchor[first], p[first], p[last]


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together into blocks: bytes, and for each byte its text's end, row and offset less position."""
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        data = np.frombuffer(b"".join(x for _, _, x in part), np.uint8)
        sizes = np.array([len(x) for _, _, x in part])
        stops = np.cumsum(sizes)
        rows = np.repeat([r for r, _, _ in part], sizes)
        shift = np.repeat(np.array([o for _, o, _ in part]) - (stops - sizes), sizes)
        return data, np.repeat(stops, sizes), rows, shift

    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), BLOCK - length + 1):
            piece = text[at : at + BLOCK]
            if len(piece) < length:
                continue
            if size and size + len(piece) > BLOCK:
                yield joined()
                part, size = [], 0
            part.append((row, at, piece))
            size += len(piece)
    if part:
        yield joined()


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _positions(length: int):
    s = Scheme(length)

    def of_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        doc, t = batch.column("doc").to_numpy(), batch.column("t").to_numpy()
        for data, ends, rows, shift in blocks(_utf8(batch.column("text")), length):
            hashes = Hashes(data)
            a, first, last = anchors(data, ends, s, hashes)
            left, extra = a - first, last - first
            whole = hashes.of(first, last + length) + (left * s.w + extra).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes.of(a, a + s.k).view(np.int64)),
                    pa.array((mixed(whole) >> np.uint64(16)).view(np.int64)),
                    pa.array(doc[rows[a]]),
                    pa.array(t[rows[a]]),
                    pa.array(((a + shift[a]) * s.w + left) * s.w + extra),
                ],
                ["g", "c", "doc", "t", "at"],
            )

    return released(of_batch)


def _contexts(length: int):
    """Rows for rounds 2 and 3: per anchor and side, the rank beside it and the ranks of its strings."""
    s = Scheme(length)
    wide = length + s.w - 1
    powers = Hashes(np.zeros(wide, np.uint8))
    up, down = powers._up[: wide + 1].copy(), powers._down[: wide + 1].copy()

    def of(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        rows = np.arange(len(sums))
        return mixed((sums[rows, start + size] - sums[rows, start]) * up[start]).view(np.int64)

    def side(number: int, own: np.ndarray, beside: np.ndarray, rows: dict[str, np.ndarray], d: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(own.any(axis=1))
        sizes = own[some].sum(axis=1)
        strings = pa.StructArray.from_arrays([pa.array(d[some][own[some]].astype(np.int32)), pa.array(h[some][own[some]])], ["d", "h"])
        columns = [pa.array(rows[x][some]) for x in ("g", "c", "doc")]
        columns += [pa.array(np.full(len(some), number, np.int32)), pa.array(beside[some])]
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), strings))
        return pa.RecordBatch.from_arrays(columns, ["g", "c", "doc", "side", "h", "strings"])

    def of_batch(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(whole), 500):
            batch = whole.slice(k, 500)
            texts, wanted = _utf8(batch.column("text")), batch.column("wanted")
            data = np.frombuffer(b"".join(texts) + bytes(wide), np.uint8)
            sizes = wanted.value_lengths().to_numpy()
            base = np.repeat(np.cumsum([0, *map(len, texts[:-1])]), sizes)
            flat = wanted.flatten()
            rows = {x: flat.field(x).to_numpy() for x in ("g", "c", "at")}
            rows["doc"] = np.repeat(batch.column("doc").to_numpy(), sizes)
            a, rest = np.divmod(rows["at"], s.w * s.w)
            left, extra = np.divmod(rest, s.w)
            bytes_ = data[(base + a - left)[:, None] + np.arange(wide)]
            sums = np.zeros((len(a), wide + 1), np.uint64)
            np.cumsum(_BYTE[bytes_] * down[:wide], axis=1, out=sums[:, 1:])
            j = np.arange(s.w)
            h = mixed((sums[:, length:] - sums[:, : s.w]) * up[: s.w]).view(np.int64)
            d = left[:, None] - j
            valid = j <= extra[:, None]
            before, behind = valid & (d >= s.half), valid & (d < s.half)
            yield side(0, before, of(sums, np.maximum(left - s.half, 0), s.half), rows, d, h)
            yield side(1, behind, of(sums, np.minimum(left + s.k, wide - s.w + s.half), s.w - s.half), rows, d, h)

    return released(of_batch)


def _spans(at: Column, s: Scheme) -> list[Column]:
    """First and last + 1 byte of all strings of a packed position."""
    w = F.lit(s.w)
    extra = F.pmod(at, w)
    start = F.expr(f"at div {s.w * s.w}") - F.pmod(F.expr(f"at div {s.w}"), w)
    return [start.alias("start"), (start + extra + s.length).alias("end")]


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """Byte ranges ``start``, ``end`` to remove, by ``doc`` and ``t``; ranges may overlap.

    ``docs`` has ``doc`` (long, not null), ``t`` (a hash that tells rows of one id apart) and ``text``.
    """
    s = Scheme(length)
    by_g = Window.partitionBy("g")
    ranked = (
        docs.select("doc", "t", "text")
        .where(F.octet_length("text") >= length)
        .mapInArrow(_positions(length), "g long, c long, doc long, t long, at long")
        .withColumns({"low": F.min("doc").over(by_g), "high": F.max("doc").over(by_g), "c0": F.min("c").over(by_g), "c1": F.max("c").over(by_g)})
        .where("low < high")
        .withColumn("edge", F.expr("c0 <> c1"))
        .where("edge or doc > low")
    )
    kept = cut(
        ranked.select(F.when(F.col("edge"), F.col("g")).alias("g"), F.when(F.col("edge"), F.col("c")).alias("c"), "doc", "t", "at", "edge"),
        "ranks",
    )
    inner = kept.where(~F.col("edge")).select("doc", "t", *_spans(F.col("at"), s))

    edge = kept.where("edge").withColumn("first", F.min("doc").over(Window.partitionBy("g", "c")))
    later = edge.where("doc > first").select("doc", "t", *_spans(F.col("at"), s))
    firsts = edge.where("doc = first").select("g", "c", "doc", "t", "at")

    one = firsts.groupBy("g", "c").agg(F.min(F.struct("doc", "t", "at")).alias("x")).select("g", "c", "x.*")
    wanted = one.groupBy("doc", "t").agg(F.collect_list(F.struct("g", "c", "at")).alias("wanted"))
    pairs = docs.select("doc", "t", "text").join(wanted, ["doc", "t"]).select("doc", "text", "wanted")
    doubled = cut(
        pairs.mapInArrow(_contexts(length), "g long, c long, doc long, side int, h long, strings array<struct<d:int,h:long>>")
        .withColumns({"low": F.min("doc").over(Window.partitionBy("g", "side", "h")), "high": F.max("doc").over(Window.partitionBy("g", "side", "h"))})
        .where("low < high")
        .select("g", "c", "doc", F.explode("strings").alias("x"))
        .select("g", "c", "doc", "x.d", "x.h")
        .withColumn("low", F.min("doc").over(Window.partitionBy("g", "d", "h")))
        .where("doc > low")
        .select("g", "c", "d")
        .distinct(),
        "edges",
    )
    start = F.expr(f"at div {s.w * s.w}") - F.col("d")
    partly = firsts.join(doubled, ["g", "c"]).select("doc", "t", start.alias("start"), (start + length).alias("end"))
    return inner.unionByName(later).unionByName(partly)


def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    kept, removed, runs = [], [], []
    flat = spans.flatten()
    starts, ends = flat.field("start").to_numpy(), flat.field("end").to_numpy()
    stops = np.cumsum(spans.value_lengths().fill_null(0).to_numpy()).tolist()
    for data, a, b in zip(_utf8(text), [0, *stops], stops):
        if a == b:
            kept.append(data)
            removed.append(0)
            runs.append(0)
            continue
        order = np.argsort(starts[a:b], kind="stable")
        first, last = starts[a:b][order], np.maximum.accumulate(ends[a:b][order])
        new = np.flatnonzero(np.append(True, first[1:] > last[:-1]))
        first, last = first[new].tolist(), last[np.append(new[1:] - 1, len(last) - 1)].tolist()
        kept.append(b"".join(data[x:y] for x, y in zip([0, *last], [*first, len(data)])))
        removed.append(len(data) - len(kept[-1]))
        runs.append(len(first))
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["kept", "n_removed", "n_spans"])


def _each_without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, spans in batches:
        yield _without(text, spans)
    text = spans = None
    release()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """``docs`` with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``.

    A null text counts as empty. Rows of one id are judged each against smaller ids only, so repeated rows
    get equal results. Rows without an id are neither searched nor changed. The result columns replace
    columns of the same names; columns that bear the names of working columns stay.
    """
    working = ("_doc", "_text", "_t", "_spans", "_out")
    docs, back = aside(docs, working)
    keyed = docs.withColumns({"_doc": F.col(doc_id).cast("long"), "_text": F.coalesce(F.col(text), F.lit(""))})
    ids = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1")
    repeated = not ids.isEmpty()
    keyed = keyed.withColumn("_t", F.xxhash64("_text") if repeated else F.lit(0).cast("long"))
    searched = keyed.where("_doc is not null").select(F.col("_doc").alias("doc"), F.col("_t").alias("t"), F.col("_text").alias("text"))
    spans = repeated_spans(searched, length).groupBy(F.col("doc").alias("_doc"), F.col("t").alias("_t"))
    spans = spans.agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    found = keyed.join(spans, ["_doc", "_t"], "left").withColumn(
        "_out", F.arrow_udf(_each_without, "struct<kept:binary,n_removed:long,n_spans:long>")(F.col("_text"), F.col("_spans"))
    )
    return found.withColumns(
        {"n_bytes": F.octet_length("_text").cast("long"), "kept": F.col("_out.kept"), "n_removed": F.col("_out.n_removed"), "n_spans": F.col("_out.n_spans")}
    ).drop(*working).withColumnsRenamed(back)


def valid_text(kept: Column) -> Column:
    """Column ``string``: the characters of UTF-8 bytes; bytes that a cut left without their character go."""

    def decoded(batch: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x.decode(errors="ignore") for x in batch.to_pylist()], pa.string())

    return per_task(kept, lambda: decoded, "string")
