import os
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ledger
from palimpsest.streaming import stability
from palimpsest.streaming.watch import ROCKS, documents, watch

SCHEMA = "doc_id long, text string"


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / x) for x in ("src", "out", "ledger", "ck")]


def put(spark, rows, src, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)


def test_a_batch_that_is_repeated_finds_its_rows_again(spark, folders):
    src, out, led, ck = folders
    put(spark, [(1, "a@b.co"), (2, "other"), (3, "a@b.co")], src)
    watch(documents(spark, src, SCHEMA), out, led, ck).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2]
    os.remove(f"{ck}/commits/0")
    crc = f"{ck}/commits/.0.crc"
    if os.path.exists(crc):
        os.remove(crc)
    watch(documents(spark, src, SCHEMA), out, led, ck).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2]
    assert spark.read.parquet(led).count() == 2
    put(spark, [(4, "a@b.co"), (5, "new")], src)
    watch(documents(spark, src, SCHEMA), out, led, ck).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2, 5]


def test_failed_texts_are_let_in_again(spark, folders):
    src, out, led, ck = folders
    schema = "doc_id long, text string, error string"
    put(spark, [(1, "a@b.co", "too_large"), (2, None, None)], src, schema)
    watch(documents(spark, src, schema), out, led, ck).awaitTermination()
    put(spark, [(3, "a@b.co", None), (4, "a@b.co", None), (5, "a@b.co", "too_large"), (6, None, None)], src, schema)
    watch(documents(spark, src, schema), out, led, ck).awaitTermination()
    put(spark, [(7, "a@b.co", None)], src, schema)
    watch(documents(spark, src, schema), out, led, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r.doc_id, r.error) for r in got.collect()) == [(1, "too_large"), (2, "no_text"), (3, None), (5, "too_large"), (6, "no_text")]
    assert {r.error_code for r in spark.read.parquet(led).where("error_code is not null").collect()} == {"too_large", "no_text"}


def test_a_new_checkpoint_starts_from_the_ledger(spark, folders):
    src, out, led, ck = folders
    put(spark, [(1, "a@b.co"), (2, None)], src)
    watch(documents(spark, src, SCHEMA), out, led, ck).awaitTermination()
    put(spark, [(3, "fresh")], src)
    for _ in range(2):
        watch(documents(spark, src, SCHEMA), out, led, ck + "-other").awaitTermination()
    # the null text failed and is tried again, the other is known
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2, 2, 3]
    assert ledger.latest(spark.read.parquet(led).where("source_hash is not null")).count() == 2


BASE = 1_700_000_000
TOLD = "path string, n_bytes long, modified timestamp, since timestamp, settled timestamp"
LOOKS = "path string, n_bytes long, modified timestamp, seen timestamp"


def seen(spark, rows):
    return spark.createDataFrame(rows, "path string, n_bytes long, m double, s double").select("path", "n_bytes", F.timestamp_seconds(F.col("m") + BASE).alias("modified"), F.timestamp_seconds(F.col("s") + BASE).alias("seen"))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def told(df):
    return sorted((r.path, r.n_bytes, r.since.timestamp() - BASE, r.settled.timestamp() - BASE) for r in df.collect())


def test_a_growing_file_is_held_back(spark, tmp_path, rocks):
    looks = [(("grows", 10 * t, float(t), float(t)), ("still", 5, 0.5, float(t)), ("touched", 7, float(t // 4), float(t)), ("gone", 1, 0.0, 0.0)) for t in range(12)]
    looks = [list(x if i == 0 else x[:3]) for i, x in enumerate(looks)]
    looks[8] = looks[8][1:]  # a look without one of the files
    late = [("still", 9, 0.0, 3.25), (None, 1, 0.0, 3.0), ("grows", None, 0.0, 3.0)]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = spark.createDataFrame([], LOOKS).schema
    for i, rows in enumerate(looks):
        seen(spark, rows + (late if i == 5 else [])).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    stability.settled(stream, 3).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    got = told(spark.read.parquet(out))
    assert got == [("still", 5, 0.0, 3.0), ("touched", 7, 0.0, 3.0), ("touched", 7, 4.0, 7.0), ("touched", 7, 8.0, 11.0)]
    # the same from a table, where nothing comes late
    flat = [r for rows in looks for r in rows]
    assert told(stability.settled(seen(spark, flat + flat[:9]).repartition(3), 3)) == got


def test_forgotten_files_settle_anew(spark, tmp_path, rocks):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for rows in ([("a", 1, 0.0, 0.0)], [("a", 1, 0.0, 5.0)], [("b", 1, 0.0, 500.0)], [("b", 1, 0.0, 501.0)], [("a", 1, 0.0, 600.0)], [("a", 1, 0.0, 604.0)]):
        seen(spark, rows).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    stream = spark.readStream.schema(spark.createDataFrame([], LOOKS).schema).option("maxFilesPerTrigger", 1).parquet(src)
    stability.settled(stream, 3, forget_seconds=100).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out, format="parquet").awaitTermination()
    assert told(spark.read.parquet(out)) == [("a", 1, 0.0, 5.0), ("a", 1, 600.0, 604.0)]


def test_looks_at_a_folder(spark, tmp_path, rocks):
    at, out = tmp_path / "in", str(tmp_path / "out")
    at.mkdir()
    (at / "still.txt").write_text("x")
    growing = at / "grows.txt"
    growing.write_text("")
    query = stability.settled(stability.looks(spark, f"file://{at}"), 2, late="0 seconds").writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start(out, format="parquet")
    try:
        end = time.time() + 60
        while time.time() < end:
            with growing.open("a") as f:
                f.write("more")
            time.sleep(0.3)
            if os.path.exists(out) and spark.read.schema(TOLD).parquet(out).count():
                break
    finally:
        query.stop()
    assert {r.path.rsplit("/", 1)[-1] for r in spark.read.schema(TOLD).parquet(out).collect()} == {"still.txt"}


def test_query_streams_a_table_of_many_files(spark, sf, tmp_path):
    from palimpsest.plans.catalog import QUERIES

    rows = [(i, f"Write to person{i % 120}@example.org now") for i in range(240)]
    schema = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema
    texts = spark.createDataFrame([(doc, text, "en", "s", len(text)) for doc, text in rows], schema)
    # more files than a stream takes at once by default
    texts.repartition(110, "doc_id").write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/documents.parquet")
    assert sum(x.endswith(".parquet") for x in os.listdir(tmp_path / "documents.parquet")) > 200
    got = QUERIES["stream_sanitize_available_now"](spark, str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(120))
