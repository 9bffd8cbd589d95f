"""Media payloads in archives, read by a data source that plans byte ranges over archive directories.

Payloads are stored losslessly as 8-bit grey images (PNG) of 64 samples a row, members of ZIP archives whose
members are not compressed again. The source lists the archives of a folder and cuts each into ranges of
about ``range_bytes``; a task reads the archive's central directory, takes the members whose headers start in
its range, and streams their bytes out as Arrow batches. Planning touches no member, and a member that
cannot be read is tried again alone, from its own offset.

Archives are written under names of their own for each task attempt, and a manifest lists those of attempts
that succeeded, so a lost executor leaves only unread files behind.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.llm.common import cut, shared_folder

ROW = 64
PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes after which a task begins a new archive, of a read range, and of an Arrow batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20, 8 << 20
ATTEMPTS = 4
LEVEL = 1


def payload(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(max(1, -(-len(data) // ROW)) * ROW - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes) -> bytes:
    """An 8-bit grey image of 64 columns that holds ``data``, whose length is a multiple of 64."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">2I5B", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """Samples of an image of ``to_png``; ValueError for any other or for damage."""
    if image[:8] != PNG:
        raise ValueError("not a PNG image")
    at, shape, packed = 8, None, []
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IHDR":
            shape = struct.unpack(">2I5B", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if shape is None or (shape[0], *shape[2:]) != (ROW, 8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image of 64 columns")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name = uuid.uuid4().hex
        number = members = 0
        out = archive = None

        def finish():
            archive.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{number:05d}.zip"]), pa.array([members], pa.int64())], ["archive", "members"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if archive is None:
                    out = fs.open_output_stream(f"{root}/{name}-{number:05d}.zip")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                data = (text or "").encode()
                # the member's name: its document, and its length before the padding
                member = zipfile.ZipInfo(f"{members:08d}/{'' if doc is None else doc}/{len(data)}.png")
                archive.writestr(member, to_png(payload(data)))
                members += 1
                if out.tell() > ARCHIVE_BYTES:
                    yield finish()
                    number, members, archive = number + 1, 0, None
        if archive is not None:
            yield finish()

    return run


def write_archives(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text's padded UTF-8 bytes as an image; return the manifest (``archive``, ``members``).

    A null text counts as empty, and an empty one is a row of zero bytes.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return cut(rows.mapInArrow(_writer(folder), "archive string, members long"), "archives")


class ByteRange(InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        self.uri, self.start, self.end = uri, start, end


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


class _Archive:
    """An archive's open file; a new one after a failure."""

    def __init__(self, uri: str):
        self.uri, self.file = uri, None

    def get(self):
        if self.file is None:
            fs, path = _open(self.uri)
            self.file = fs.open_input_file(path)
        return self.file

    def drop(self) -> None:
        file, self.file = self.file, None
        if file is not None:
            try:
                file.close()
            except OSError:
                pass  # it has failed already

    def again(self, read, wait: float = 0.1):
        """What ``read`` makes of the file, repeated with a newly opened one after a failure."""
        for attempt in range(ATTEMPTS):
            try:
                return read(self.get())
            except (OSError, ValueError, zipfile.BadZipFile):
                self.drop()
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(wait * 2**attempt)
        raise AssertionError


def _member(archive: _Archive, offset: int, size: int, crc: int) -> bytes:
    """One stored member by the offset of its header, tried again alone after a failure."""

    def read(source) -> bytes:
        source.seek(offset)
        head = source.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no member at {offset} of {archive.uri}")
        names, extra = struct.unpack_from("<2H", head, 26)
        source.seek(offset + 30 + names + extra)
        data = source.read(size)
        if len(data) != size or zlib.crc32(data) != crc:
            raise OSError(f"member at {offset} of {archive.uri} is cut short or damaged")
        return data

    return archive.again(read)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        fs, root = _open(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root))
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else "file://"
        base = self.folder.rstrip("/") if "://" in self.folder else scheme + root
        ranges = [
            ByteRange(f"{base}/{x.base_name}", a, min(a + self.range_bytes, x.size))
            for x in sorted(found, key=lambda x: x.base_name)
            if x.is_file and x.extension == "zip"
            for a in range(0, x.size, self.range_bytes)
        ]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.uri:
            return
        archive = _Archive(part.uri)
        try:
            listed = archive.again(lambda source: zipfile.ZipFile(source).infolist())
            name = part.uri.rsplit("/", 1)[-1]
            rows, size = [], 0
            for x in listed:
                if not part.start <= x.header_offset < part.end:
                    continue
                data = _member(archive, x.header_offset, x.file_size, x.CRC)
                _, doc, rest = x.filename.split("/")
                rows.append((name, len(listed), x.header_offset, int(doc) if doc else None, int(rest.split(".")[0]), data))
                size += len(data)
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
        finally:
            archive.drop()


SCHEMA = "archive string, members long, offset long, doc_id long, n_bytes long, media binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["archive", "members", "offset", "doc_id", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: a row for each member of each archive."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Members of the archives in ``folder``; with a manifest, of the archives it lists.

    A folder or a listed archive that is not there raises ``FileNotFoundError``; a listed archive with another number of
    members than listed, or a member that stays unreadable, fails the query. Archives that are not listed are passed over.
    """
    spark.dataSource.register(ArchiveSource)
    found = spark.read.format("media_archive").load(folder)
    if manifest is None:
        return found
    fs, root = _open(folder)
    fs.get_file_info(pafs.FileSelector(root))  # a missing folder is no empty one
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"))
    absent = manifest.join(there, "archive", "left_anti")
    missing = absent.select("archive").first()  # names alone are read
    if missing:
        raise FileNotFoundError(f"{absent.count()} of the manifest's archives are not in {folder}, {missing.archive} among them")
    met = found.join(manifest.select("archive", F.col("members").alias("_listed")), "archive")
    wrong = F.raise_error(F.concat("archive", F.lit(" has "), F.col("members").cast("string"), F.lit(" members, not "), F.col("_listed").cast("string"))).cast("boolean")
    return met.where(F.when(F.col("members") == F.col("_listed"), True).otherwise(wrong)).drop("_listed")


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums and features of images: the mean sample and its deviation, entropy, share of zero bytes."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in batch.column("media"):
            image = media.as_py()
            data = from_png(image)
            samples = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
            level = np.arange(256)
            mean = float(samples @ level)
            some = samples[samples > 0]
            feature = f"mean={mean:.4f};std={max(0.0, float(samples @ level**2) - mean * mean) ** 0.5:.4f};entropy={float(-(some * np.log2(some)).sum()) + 0.0:.4f};zeros={samples[0]:.4f}"
            for k, v in zip(out, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), feature)):
                out[k].append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], ["doc_id", "n_bytes", *out])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Checksums and features of the members that ``read_archives`` gives."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(describe, FEATURES)


def new_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "media")
