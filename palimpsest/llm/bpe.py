"""Byte-level BPE encoding and decoding with a rank file.

A segment tree over the byte positions of a piece holds the smallest pair rank, leftmost first. Its root
names the next merge; a merge changes the pairs at two live neighbours and empties one leaf, so it costs
three point updates of logarithmic depth, and a piece of n bytes costs O(n log n) however long it is.

Pieces are the matches of a split pattern. Equal pieces have equal ids, so a task remembers those it has
seen in about ``MEMO_BYTES``; beyond that it starts anew, and at its end it forgets them. That changes no result.
"""

from __future__ import annotations

import base64
import contextlib
import copy
import functools
import gc
import itertools
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from palimpsest.llm.common import per_task, release, slices

#: Bytes, about, of pieces and ids that are remembered before the memory is emptied.
MEMO_BYTES = 64 << 20
#: What a remembered piece takes beside its characters and ids: two objects and their place in a table.
ENTRY_BYTES = 180

#: Documents whose new pieces are merged together, and characters of a text that are split at once.
DOCUMENTS_AT_ONCE, CHARACTERS_AT_ONCE = 500, 1 << 22

#: For texts of printable ASCII, line feeds and the letters of Latin-1 alone, the standard library's
#: expressions find the same pieces, three times as fast as ``regex``.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile(rf"[^\n -~{LETTERS}]")
#: The split pattern that the fast expression below stands for.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FAST = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")


def splitter(pattern: str) -> Callable[[str], Iterator[list[str]]]:
    """Function from a text to lists of its pieces, the matches of ``pattern``; one list unless the text is very long."""
    every = regex.compile(pattern)

    def pieces(text: str) -> Iterator[list[str]]:
        found = _FAST if pattern == COMMON_PATTERN and not _OTHER.search(text) else every
        if len(text) <= CHARACTERS_AT_ONCE:
            yield found.findall(text)
        else:
            matches = (m.group() for m in found.finditer(text))
            while part := list(itertools.islice(matches, CHARACTERS_AT_ONCE // 8)):
                yield part

    return pieces


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: merge the leftmost pair of the smallest rank until no pair has one."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    shift = size.bit_length()
    none = 1 << 62
    end = list(range(1, n + 1))  # end[i]: end of the token that starts at byte i
    start = list(range(-1, n))  # start[e]: start of the token that ends at byte e
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    mask = (1 << shift) - 1
    while (low := tree[1]) != none:
        i = low & mask
        middle = end[i]
        last = end[middle]
        end[i], start[last] = last, i
        put(middle, none)
        rank = get(piece[i : end[last]]) if last < n else None
        put(i, none if rank is None else rank << shift | i)
        if i:
            before = start[i]
            rank = get(piece[before:last])
            put(before, none if rank is None else rank << shift | before)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


@contextlib.contextmanager
def no_gc():
    """Without cycle collection, which would walk millions of lists that hold numbers only."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class PairTrees:
    """The same merges for many pieces at once: one segment tree a row, all rows in step, in numpy."""

    NONE = np.int64(1) << 62

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (ranks[token[:k]], ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], rank[order]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids, or NONE."""
        if not len(self.keys):
            return np.full(len(left), self.NONE)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], self.NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed token ids of pieces that are all shorter than 65 bytes."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list = [None] * len(pieces)
        for log in range(7):
            low = 1 << (log - 1) if log else 0
            rows = np.flatnonzero((lengths > low) & (lengths <= 1 << log))
            for part in np.array_split(rows, len(rows) * (1 << log) // 1_000_000 + 1):
                if len(part):
                    for i, ids in zip(part, self._same_size([pieces[i] for i in part], lengths[part], 1 << log)):
                        out[i] = ids
        return out

    def _same_size(self, pieces: list[bytes], n: np.ndarray, size: int) -> list[bytes]:
        m = len(pieces)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(m, size)
        token = self.byte_id[raw]
        end = np.tile(np.arange(1, size + 2), (m, 1))
        start = np.tile(np.arange(-1, size + 1), (m, 1))
        tree = np.full((m, 2 * size), self.NONE)
        row, i = np.nonzero(np.arange(size - 1)[None, :] < (n - 1)[:, None])
        rank = self.lookup(token[row, i], token[row, i + 1])
        tree[row, size + i] = np.where(rank == self.NONE, self.NONE, rank * size + i)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

        def put(row: np.ndarray, i: np.ndarray, rank: np.ndarray | None) -> None:
            k = size + i
            tree[row, k] = self.NONE if rank is None else np.where(rank == self.NONE, self.NONE, rank * size + i)
            k >>= 1
            while k[0]:
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])
                k >>= 1

        row = np.flatnonzero(tree[:, 1] != self.NONE) if size > 1 else np.zeros(0, np.int64)
        while len(row):
            i = tree[row, 1] % size
            token[row, i] = tree[row, 1] // size
            middle = end[row, i]
            last = end[row, middle]
            end[row, i] = last
            start[row, last] = i
            put(row, middle, None)
            inner = last < n[row]
            rank = np.full(len(row), self.NONE)
            rank[inner] = self.lookup(token[row[inner], i[inner]], token[row[inner], last[inner]])
            put(row, i, rank)
            some = np.flatnonzero(i > 0)
            if len(some):
                r, k = row[some], i[some]
                before = start[r, k]
                put(r, before, self.lookup(token[r, before], token[r, k]))
            row = row[tree[row, 1] != self.NONE]
        live = np.zeros((m, size + 1), bool)
        at = np.zeros(m, np.int64)
        row = np.arange(m)
        while len(row):
            live[row, at[row]] = True
            at[row] = end[row, at[row]]
            row = row[at[row] < n[row]]
        ids = token[live[:, :size]].astype("<u4").tobytes()
        stop = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *stop], stop)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers, which take a tenth of the memory of a list."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Memo:
    """Texts to packed ids by pieces; subclasses encode the pieces not met before."""

    split: Callable[[str], Iterator[list[str]]]
    limit = MEMO_BYTES

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, bytes] = {}
        self.used = 0

    def forget(self) -> None:
        self.clear()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of each of these pieces."""
        raise NotImplementedError

    def _joined(self, lists: list[list[str]]) -> list[bytes]:
        if self.used > self.limit:
            self.forget()
        if new := set().union(*lists).difference(self.memo):
            found = self.learn(new)
            self.used += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
            self.memo.update(found)
        get = self.memo.__getitem__
        return [b"".join(map(get, own)) for own in lists]

    def pack(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null counts as empty."""
        with no_gc():
            if all(len(x) <= CHARACTERS_AT_ONCE for x in texts if x):
                return self._joined([next(self.split(x)) if x else [] for x in texts])
            return [b"".join(self._joined([part])[0] for part in self.split(x)) if x else b"" for x in texts]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.pack(texts)]

    def array(self, texts: pa.Array) -> pa.Array:
        """An Arrow list array of the ids of each text."""
        parts = [list_array(self.pack(x.to_pylist())) for x in slices(texts, DOCUMENTS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else list_array([])


class Codec(Memo):
    """Encodes texts by a rank file and a split pattern, and decodes ids."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.split = splitter(pattern)
        self.trees = PairTrees(self.ranks)
        self.bytes_of = {i: token for token, i in self.ranks.items()}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        names, merged = [], []
        for piece in pieces:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                found[piece] = packed([whole])
            elif len(data) > 64:
                found[piece] = packed(merge_piece(data, self.ranks))
            else:
                names.append(piece)
                merged.append(data)
        found.update(zip(names, self.trees.encode(merged)))
        return found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def list_array(rows: list[bytes]) -> pa.Array:
    """Packed ids as an Arrow list array."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, rows), np.int32, len(rows)) // 4, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def fresh(own: Memo) -> Memo:
    """A codec for one task: tables shared with the worker's codec, a memory of its own."""
    new = copy.copy(own)
    new.clear()
    return new


def encode(text: Column, path: str, pattern: str) -> Column:
    """Column ``array<int>``: token ids of a text column, by the ranks in the file at ``path``.

    Null and the empty text give an empty array. ``path`` must exist on every executor.
    """
    return per_task(text, lambda: fresh(codec(path, pattern)).array, "array<int>")


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Column ``binary``: the bytes that token ids stand for, for repeated rows the same; null ids give no bytes, an unknown id fails."""

    def make() -> Callable[[pa.Array], pa.Array]:
        own = codec(path, pattern)

        def joined(batch: pa.Array) -> pa.Array:
            values, offsets = batch.values, batch.offsets.to_pylist()
            null = batch.is_null().to_pylist()
            rows = (b"" if gone else own.decode(values[a:b].to_numpy().tolist()) for gone, a, b in zip(null, offsets, offsets[1:]))
            return pa.array(rows, pa.binary())

        return joined

    return per_task(ids, make, "binary")


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Column ``struct<ids:array<int>,decoded:binary>``: ``encode`` and ``decode`` of its ids, in one pass through Python."""

    def make() -> Callable[[pa.Array], pa.Array]:
        own = fresh(codec(path, pattern))

        def both(batch: pa.Array) -> pa.Array:
            parts = []
            for texts in slices(batch, DOCUMENTS_AT_ONCE):
                rows = own.pack(texts.to_pylist())
                decoded = pa.array((own.decode(np.frombuffer(x, "<u4").tolist()) for x in rows), pa.binary())
                parts.append(pa.StructArray.from_arrays([list_array(rows), decoded], ["ids", "decoded"]))
            return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]))

        return both

    return per_task(text, make, "struct<ids:array<int>,decoded:binary>")


def round_trip_rows(rows: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``rows`` with ``ids`` and ``decoded``, as ``round_trip`` has them, for wide results: they leave Python in small batches.

    Null and empty texts have no ids and no bytes; repeated rows have equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fresh(codec(path, pattern))
        for batch in batches:
            at = 0
            for texts in slices(batch.column(text), DOCUMENTS_AT_ONCE):
                part = batch.slice(at, len(texts))
                at += len(texts)
                packed_ids = own.pack(texts.to_pylist())
                decoded = pa.array([own.decode(np.frombuffer(x, "<u4").tolist()) for x in packed_ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, list_array(packed_ids), decoded], [*part.schema.names, "ids", "decoded"])
        own = batch = texts = part = packed_ids = decoded = None
        release()

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, ids array<int>, decoded binary")
