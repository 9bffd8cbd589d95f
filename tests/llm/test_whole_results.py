"""Queries against brute force on whole tables, and results that must not be incomplete without an error."""

import hashlib
import os
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import knn_quality, media, mixing, planes, queries


@pytest.fixture(scope="module")
def rows(small):
    return sorted((r.doc_id, r.text or "", r.source) for r in small.collect())


def folder_of(path):
    return path.removeprefix("file://")


def test_plane_query_equals_the_library(spark, sf, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op5_plane_files(spark, sf).collect())
    start, want = 0, []
    for doc, text, _ in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize("harm", ["delete", "other", "cut"])
def test_lost_plane_files_are_noticed(spark, small, harm):
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    folder = planes.new_folder(spark)
    manifest = planes.write(small, public_tokenizers.path("byte_bpe_50k.json"), folder)
    spark.conf.unset(coalesced)
    files = sorted(f"{folder_of(folder)}/{r.file}" for r in manifest.orderBy("part", "roll").collect())
    assert len(files) > 2
    if harm == "delete":
        os.remove(files[1])
    elif harm == "other":
        with open(files[0], "rb") as f:
            data = f.read()
        one = planes.unpack(data)
        keep = one[2][:3].sum()
        with open(files[0], "wb") as f:
            f.write(planes.pack(one[0][:keep], one[1].filled(0)[:3], one[2][:3]))
    else:
        with open(files[0], "r+b") as f:
            f.truncate(100)
    for name in os.listdir(folder_of(folder)):
        if name.endswith(".crc"):
            os.remove(f"{folder_of(folder)}/{name}")
    with pytest.raises(Exception, match="are not in|holds|planes file"):
        planes.read_checksums(manifest, folder).collect()


def test_media_query_equals_brute_force(spark, sf, rows):
    got = {r.doc_id: r for r in queries.op8_media_archives(spark, sf).collect()}
    assert len(got) == len(rows)
    for doc, text, _ in rows:
        data = media.payload(text.encode())
        image, r = media.to_png(data), got[doc]
        samples = np.frombuffer(data, np.uint8)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert r.feature.startswith(f"mean={samples.mean():.4f};") and r.feature.endswith(f"zeros={(samples == 0).mean():.4f}")


@pytest.mark.parametrize("harm", ["delete", "fewer", "folder"])
def test_lost_archives_are_noticed(spark, small, harm):
    folder = media.new_folder(spark)
    manifest = media.write_archives(small.repartition(4), folder)
    names = sorted(r.archive for r in manifest.collect())
    at = f"{folder_of(folder)}/{names[0]}"
    if harm == "fewer":
        with zipfile.ZipFile(at) as z:
            first = z.infolist()[0]
            data = z.read(first)
        with zipfile.ZipFile(at, "w") as z:
            z.writestr(first.filename, data)
    else:
        os.remove(at)
    if harm == "folder":
        folder = f"{folder}-absent"
    with pytest.raises(Exception, match="are not in|members, not|absent"):
        media.features(media.read_archives(spark, folder, manifest)).collect()


def test_members_are_read_again_by_a_new_handle(tmp_path, monkeypatch):
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("0/1/5.png", b"payload")
    good = (tmp_path / "a.zip").read_bytes()
    archive = media._Archive(f"file://{tmp_path}/a.zip")
    first = archive.get()
    (tmp_path / "a.zip").write_bytes(b"??" + good[2:])
    opened, plain = [], media._open

    def heals(uri):
        opened.append(uri)
        if len(opened) == 2:
            (tmp_path / "a.zip").write_bytes(good)
        return plain(uri)

    monkeypatch.setattr(media, "_open", heals)
    assert media._member(archive, 0, 7, zlib.crc32(b"payload")) == b"payload" and len(opened) == 2
    assert first.closed and archive.file is not first and not archive.file.closed


def test_quality_query_scores_every_document(spark, sf, rows):
    got = {r.doc_id: r for r in queries.op4_knn_quality(spark, sf).collect()}
    held = {doc: zlib.crc32(str(doc).encode()) % 3 == 1 for doc, _, _ in rows}
    assert {d: r.held_out for d, r in got.items()} == held
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = queries.quality_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    # every neighbour of every text, one text at a time
    for doc, text, _ in rows[::7]:
        near = model.vectors(knn_quality.counts([text]))[0] @ model.known
        top = sorted(range(len(near)), key=lambda i: -near[i])[: model.voters]
        weight = [max(float(near[i]), 0.0) ** model.power for i in top]
        plain = sum(w * float(model.labels[i]) for w, i in zip(weight, top)) / sum(weight)
        assert got[doc].score == pytest.approx(plain, abs=1e-3) and got[doc].predicted == (got[doc].score >= 0.5)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    told = [got[d].predicted == q for d, q in quality.items() if d in got and got[d].held_out and q is not None]
    assert np.mean(told) > 0.9


def test_labels_of_other_documents_take_no_place(spark, sf, small):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    foreign = spark.range(10_000_000, 10_006_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "0 AS toxic")
    alone = knn_quality.fit(small, labels, max_rows=60)
    among = knn_quality.fit(small, labels.unionByName(foreign), max_rows=60)
    assert len(among.labels) == len(alone.labels) == 60 and (among.labels == alone.labels).all() and (among.known == alone.known).all()


def test_mix_query_meets_its_targets(spark, sf, rows):
    got = queries.op7_mix_sources(spark, sf).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len([w for w in text.encode().split() if w])
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    free, left, target = set(names), float(sum(sizes.values())), {}
    while True:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    target |= {s: share * weight[s] for s in free}
    source = {doc: s for doc, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    biggest = {s: max(r.size for r in got if source[r.doc_id] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op7_mix_sources(spark, sf).collect()))


@pytest.mark.parametrize("equal_texts", [True, False])
def test_rows_without_ids_are_taken_one_by_one(spark, equal_texts):
    words = "w " * 50
    a = spark.range(1000).selectExpr("cast(null AS long) AS doc_id", f"'{words}' AS text" if equal_texts else f"concat('{words[:-2]}', id) AS text", "'a' AS source")
    b = spark.range(100, 1100).selectExpr("id AS doc_id", f"'{words}' AS text", "'b' AS source")
    docs = a.unionByName(b).repartition(5)
    for part in (docs, docs.repartition(3)):
        # weights 5 and 2 share 100,000 words
        sums = {r.source: (r.target, r.taken) for r in mixing.mix(part).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
        assert sums["a"][0] == pytest.approx(100_000 * 5 / 7)
        for target, taken in sums.values():
            assert abs(target - taken) <= 50
