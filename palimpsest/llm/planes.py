"""Token ids in binary files: byte planes of fixed blocks, compressed with zstandard, behind a chunk index.

File, all numbers little-endian:

* magic ``PLANES1\\n``
* chunks: the four byte planes of up to ``BLOCK`` ids, lowest byte first, each a zstandard frame; then one
  chunk with the documents' ids and lengths as two int64 arrays and a byte that is 1 where the id is null, also a frame
* index: per id chunk the number of ids and four frame lengths (uint32 x 5); then the lengths of the document
  chunk and the number of documents (uint64 x 2)
* footer: number of id chunks, number of ids, offset of the index (uint64 x 3), magic again

The high planes of small ids are constant or nearly so and all but vanish. A reader finds any chunk by the
index alone. Files are written under names of their own for each task attempt and a manifest names those of
attempts that succeeded, so a lost executor leaves only unread files behind.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.bpe import COMMON_PATTERN, DOCUMENTS_AT_ONCE, ENTRY_BYTES, LETTERS, Memo, fresh, packed, splitter
from palimpsest.llm.common import cut, per_task, release, shared_folder, slices

MAGIC = b"PLANES1\n"
BLOCK = 1 << 16
#: Ids after which a task begins a new file.
FILE_IDS = 1 << 22
#: Level of zstandard.
LEVEL = 3
#: Bytes of pieces that a worker remembers with their ids. The library is slow on single words, so a piece that was forgotten costs more to
#: encode again than one of ``bpe``.
LIBRARY_MEMO_BYTES = 96 << 20


def pack(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, null: np.ndarray | None = None, block: int = BLOCK) -> bytes:
    """One file's bytes. ``ids``: uint32 of all documents in a row; ``lengths``: ids of each; ``null``: documents without an id."""
    null = np.zeros(len(doc_ids), bool) if null is None else null
    frames, index = [MAGIC], []
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    at = len(MAGIC)
    for k in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[k : k + block], dtype="<u4")
        planes = [squeeze(x.tobytes()) for x in np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4).T)]
        frames += planes
        index.append(struct.pack("<5I", len(part), *map(len, planes)))
        at += sum(map(len, planes))
    table = squeeze(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + null.astype(np.uint8).tobytes())
    frames.append(table)
    at += len(table)
    return b"".join([*frames, *index, struct.pack("<2Q", len(table), len(doc_ids)), struct.pack("<3Q", len(index), len(ids), at), MAGIC])


def unpack(data: bytes) -> tuple[np.ndarray, np.ma.MaskedArray, np.ndarray]:
    """(ids, document ids, lengths) of one file, null document ids masked; ValueError if it is none or damaged."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a planes file")
    chunks, n, at = struct.unpack_from("<3Q", data, len(data) - 32)
    ids = np.empty(n, "<u4")
    grow = zstandard.ZstdDecompressor().decompress
    here, done = len(MAGIC), 0
    for k in range(chunks):
        size, *lengths = struct.unpack_from("<5I", data, at + 20 * k)
        raw = []
        for length in lengths:
            raw.append(np.frombuffer(grow(data[here : here + length]), np.uint8))
            here += length
        ids[done : done + size] = np.stack(raw, axis=1).reshape(-1).view("<u4")
        done += size
    size, docs = struct.unpack_from("<2Q", data, at + 20 * chunks)
    table = grow(data[here : here + size])
    if len(table) != 17 * docs:
        raise ValueError("the index does not fit the documents")
    both, null = np.frombuffer(table, "<i8", 2 * docs), np.frombuffer(table, np.uint8, docs, 16 * docs)
    if done != n or both[docs:].sum() != n:
        raise ValueError("the index does not fit the chunks")
    return ids, np.ma.array(both[:docs], mask=null.astype(bool)), both[docs:]


#: Pieces that follow each other in one text without changing each other's matches.
_WORD = re.compile(rf" [{LETTERS}]+")


class LibraryCodec(Memo):
    """Texts to packed ids with the tokenizers library; equal pieces are encoded once.

    Only tokenizers that split texts by the common pattern and then merge are fed pieces; others, and texts in which
    the library would find one of its added tokens, are encoded whole.
    """

    limit = LIBRARY_MEMO_BYTES

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        first = spec["pre_tokenizer"] or {}
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.by_piece = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and spec["normalizer"] is None
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a byte of a token is a character of its name
        self.sizes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        pieces = splitter(COMMON_PATTERN)
        self.split = lambda text: pieces(text) if self._plain(text) else iter([[text]])

    def _plain(self, text: str) -> bool:
        return bool(self.by_piece) and not any(x in text for x in self.added)

    def forget(self) -> None:
        """Keep the half that was met first: frequent pieces are met early."""
        self.memo = dict(itertools.islice(self.memo.items(), len(self.memo) // 2))
        self.used = ENTRY_BYTES * len(self.memo) + sum(map(len, self.memo)) + sum(map(len, self.memo.values()))

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        words = [x for x in pieces if _WORD.fullmatch(x)] if self.by_piece else []
        for k in range(0, len(words), 512):
            # one text of many words costs the library less than a text for each; each word begins with the text's only blanks
            part = words[k : k + 512]
            text = "".join(part)
            coded = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw = text.encode()
            ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[1:], len(raw))
            reached = np.cumsum(self.sizes[coded])
            at = np.searchsorted(reached, ends)
            if len(reached) and at[-1] < len(reached) and (reached[at] == ends).all():
                ids, stops = coded.tobytes(), (4 * (at + 1)).tolist()
                found.update(zip(part, (ids[a:b] for a, b in zip([0, *stops], stops))))
        rest = list(pieces.difference(found))
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            found.update(zip(part, (packed(x.ids) for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        return found


@functools.lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


def encode(text: Column, path: str) -> Column:
    """Column ``array<int>``: ids as the tokenizers library gives them without adding special tokens. Null counts as empty."""
    return per_task(text, lambda: fresh(library_codec(path)).array, "array<int>")


def _writer(folder: str, tokenizer: str, end_id: int):
    """Encode and write where the texts are, so that ids do not cross into the JVM and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        codec, end = library_codec(tokenizer), packed([end_id])  # a worker's tasks share the memory of pieces, LIBRARY_MEMO_BYTES at most
        name = uuid.uuid4().hex
        ids: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        size = done = 0
        part = None

        def flush() -> pa.RecordBatch:
            path = f"{name}-{done:05d}.planes"
            own = np.concatenate(docs)
            with fs.open_output_stream(f"{root}/{path}") as out:
                out.write(pack(np.concatenate(ids), own, np.concatenate(lengths), np.concatenate(nulls)))
            for parts in (ids, docs, lengths, nulls):
                parts.clear()
            kinds = {"file": pa.string(), "part": pa.int32(), "roll": pa.int32(), "n_docs": pa.int64(), "n_ids": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, part, done, len(own), size), kinds.values())], list(kinds))

        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), DOCUMENTS_AT_ONCE):
                rows = batch.slice(at, len(texts))
                at += len(texts)
                part = rows.column("part")[0].as_py()
                coded = codec.pack(texts.to_pylist())
                lengths.append(np.fromiter(map(len, coded), np.int64, len(coded)) // 4 + 1)
                ids.append(np.frombuffer(end.join(coded) + end, "<u4"))
                docs.append(rows.column("doc_id").fill_null(0).to_numpy())
                nulls.append(rows.column("doc_id").is_null().to_numpy(zero_copy_only=False))
                size += len(ids[-1])
                if size >= FILE_IDS:
                    yield flush()
                    size, done = 0, done + 1
        if size:
            yield flush()
        release()

    return run


def write(docs: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Write the ids of all texts to files in ``folder``, in ascending order of ids; return the manifest.

    Manifest: ``file``, ``part``, ``roll`` (its order), ``n_docs``, ``n_ids`` and ``base`` (ids in files
    before). Rows without an id come first. Rows of one id follow each other in order of a hash of their texts, by
    which many rows of one id are dealt to several partitions. No documents give an empty manifest.
    The manifest has a row for each file of ``FILE_IDS`` ids.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    placed = dealt.select("doc_id", F.spark_partition_id().alias("part"), "text")
    manifest = cut(placed.mapInArrow(_writer(folder, path, end_id), "file string, part int, roll int, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    return cut(manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ma.MaskedArray, np.ndarray, int]]:
    """(ids, document ids, lengths, ids before) of each file of a batch; ValueError if it does not hold what the manifest says."""
    columns = (batch.column(c).to_pylist() for c in ("file", "base", "n_docs", "n_ids"))
    for data, file, base, n_docs, n_ids in zip(batch.column("content"), *columns):
        ids, docs, lengths = unpack(data.as_py())
        if (len(docs), len(ids)) != (n_docs, n_ids):
            raise ValueError(f"{file} holds {len(docs)} documents and {len(ids)} ids, not {n_docs} and {n_ids}")
        yield ids, docs, lengths, base


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, docs, lengths, base in _unpacked(batch):
            ends = np.cumsum(lengths)
            values = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64), pa.int64()))
            for k in range(0, len(docs), 2000):
                part = slice(k, k + 2000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[part]), pa.array(base + ends[part] - lengths[part]), pa.array(lengths[part]), values[part]], ["doc_id", "start", "n_tokens", "ids"]
                )


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(``doc_id``, ``start``, ``n_tokens``, ``ids``) of all documents in the files of a manifest.

    A listed file that is not there raises ``FileNotFoundError``; one that holds other numbers of documents or ids than
    listed fails the query. Files that are not listed are passed over.
    """
    return _listed(manifest, folder).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids array<long>")


def _listed(manifest: DataFrame, folder: str) -> DataFrame:
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.planes").load(folder)
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    absent = manifest.join(named.select("file"), "file", "left_anti")
    missing = absent.select("file").first()  # names alone are read
    if missing:
        raise FileNotFoundError(f"{absent.count()} of the manifest's files are not in {folder}, {missing.file} among them")
    return named.select("file", "content").join(manifest.select("file", "base", "n_docs", "n_ids"), "file")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, docs, lengths, base in _unpacked(batch):
            ends = np.cumsum(lengths)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def read_checksums(manifest: DataFrame, folder: str) -> DataFrame:
    """As ``read``, with ``ids_crc32``, the checksum of each document's ids as uint32, in place of the ids."""
    return _listed(manifest, folder).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark) -> str:
    return shared_folder(spark, "planes")
