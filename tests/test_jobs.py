import json
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from palimpsest.operators import evaluate, glyphs, ledger, report
from palimpsest.operators.policy import DEFAULT
from palimpsest.plans import catalog, catalog_jobs, catalog_pages  # noqa: F401
from palimpsest.plans.process import process
from palimpsest.sources.files import case_pairs, cases, files
from palimpsest.streaming.watch import documents, watch

TABLES = "documents pages conversations events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i].item() if hasattr(r[i], "item") else r[i] for i in order)) for r in rows)


HEAVY = {"eval_misses", "eval_overlap", "findings_by_source", "release_route", "audit_markdown"}


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - HEAVY))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_reports_hold_no_plaintext(spark):
    df = spark.createDataFrame([(1, "write to secret.person@example.org")], "doc_id long, text string")
    audited = report.audit(process(df), DEFAULT)
    text = report.as_json(audited).first().report + report.as_markdown(audited).first().report
    assert "secret.person" not in text and json.loads(report.as_json(audited).first().report)["findings_count"] == 1


def test_percentile_is_cut_off(spark):
    row = evaluate.latencies(spark.range(10).select(F.col("id").cast("double").alias("v")), "v").first()
    assert (row["median"], row.p95, row.n) == (4.5, 8.0, 10)


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "case_id long, category string, start long, end long, required boolean")
    row = evaluate.metrics(evaluate.counts(none, none)).first()
    assert (row.precision, row.recall, row.f1) == (1.0, 1.0, 1.0)


def jobs(spark, rows):
    base = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, h, s, base + timedelta(hours=n)) for n, (i, h, s) in enumerate(rows)], "id string, source_hash string, status string, created_at timestamp")


def test_duplicates_follow_the_last_attempt(spark):
    past = jobs(spark, [("a", "h1", "failed"), ("b", "h1", "completed"), ("c", "h2", "completed"), ("d", "h2", "failed"), ("e", "h3", "interrupted")])
    batch = spark.createDataFrame([(n, h) for n, h in enumerate(["h1", "h2", "h2", "h3", "h4", "h4"])], "doc_id long, source_hash string")
    assert sorted(r.doc_id for r in ledger.not_done(batch, past, "doc_id").collect()) == [1, 3, 4]
    assert [r.id for r in ledger.recent(past, 2).collect()] == ["e", "d"]
    assert [r.id for r in ledger.by_prefix(past, "a").collect()] == ["a"]
    assert {r.status for r in ledger.recovered(jobs(spark, [("x", "h", "verifying")])).collect()} == {"interrupted"}


def test_names_avoid_what_is_there(spark):
    df = spark.createDataFrame([(1, "d", "a.txt"), (2, "d", "a.txt"), (3, "d", "a.txt"), (4, "d", "a-2.txt")], "i int, folder string, name string")
    held = spark.createDataFrame([("d", "a.txt"), ("d", "a-3.txt")], "folder string, name string")
    got = [r.safe_name for r in ledger.collision_safe(df, "folder", "name", "i", held).orderBy("i").collect()]
    assert got == ["a-4.txt", "a-5.txt", "a-6.txt", "a-2.txt"]


def test_gate_and_registry(spark, tmp_path):
    from palimpsest.sources.files import TEXT, Handler, gate, listed, registry, utf8_text

    for name in ("_a.txt", "b.MD", "c.pdf", "big.txt"):
        (tmp_path / name).write_bytes(b"x" * (99 if name == "big.txt" else 3))
    (tmp_path / "link.txt").symlink_to(tmp_path / "b.MD")
    known = registry(TEXT, Handler("markdown", (".md",), utf8_text))
    got = {r.name: r.refused for r in gate(listed(spark, str(tmp_path)), known, 50).collect()}
    assert got == {"_a.txt": None, "b.MD": None, "c.pdf": "unsupported", "big.txt": "too_large", "link.txt": "symlink"}
    assert {r.name: (r.kind, r.text, r.error) for r in files(spark, str(tmp_path), max_bytes=50, handlers=known).collect()} == {
        "_a.txt": ("text", "xxx", None), "b.MD": ("markdown", "xxx", None), "big.txt": ("text", None, "too_large"),
    }
    paths = listed(spark, str(tmp_path)).unionByName(spark.createDataFrame([(f"file:{tmp_path}/../b.md", "b.md", 1, False), (f"file:{tmp_path}-b/b.md", "b.md", 1, False)], "path string, name string, n_bytes long, is_link boolean"), allowMissingColumns=True)
    inside = gate(paths, known, 50, root=f"file:{tmp_path}")
    assert [r.path for r in inside.where("refused = 'outside'").collect()] == [f"file:{tmp_path}/../b.md", f"file:{tmp_path}-b/b.md"]
    assert {r.name: r.refused for r in inside.where("refused <> 'outside' or refused is null").collect()} == got
    with pytest.raises(ValueError):
        registry(TEXT, Handler("other", (".TXT",), utf8_text))


def test_policies_from_files(spark, tmp_path):
    from palimpsest.operators.policy import PolicyError, load_policies, policy_of

    (tmp_path / "p.yaml").write_text("name: own\nversion: 2\nminimum_confidence: 0.6\nactions: {EMAIL: redact}\nplaceholders: {EMAIL: MAIL}\nreview_behavior: {quarantine: false, warn_only: true}\n")
    own = load_policies(spark, str(tmp_path))["own"]
    assert (own.version, own.action("EMAIL"), own.label("EMAIL"), own.action("PHONE"), own.warn_only) == (2, "redact", "MAIL", "ignore", True)
    for bad in ("[1]", "name: x", "name: x\nversion: 1\nminimum_confidence: 0.5\nactions: {MAIL: redact}", "name: x\nversion: 0\nminimum_confidence: 0.5\nactions: {}", "a: [", "name: x\nversion: 1\nminimum_confidence: 0.5\nactions: {}\nmore: 1"):
        with pytest.raises(PolicyError):
            policy_of(bad)


def test_synthetic_cases_are_found(spark):
    from palimpsest.sources import corpus

    rows = corpus.cases(spark, 120).withColumn("doc_id", F.monotonically_increasing_id())
    expected = rows.select(F.col("doc_id").alias("case_id"), F.explode("findings").alias("f")).select("case_id", "f.category", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), "f.required")
    found = process(rows.select("doc_id", "text"))
    spans = found.select(F.col("doc_id").alias("case_id"), F.explode("merged").alias("f")).select("case_id", "f.category", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"))
    row = evaluate.summarize(found, spans, expected).first()
    assert (row.precision, row.recall, row.verification_pass_rate, row.quarantine_rate, row.case_count) == (1.0, 1.0, 1.0, 0.0, 120)


def test_evaluation_files(spark, tmp_path):
    found = spark.createDataFrame([(1, "EMAIL", 0, 5)], "case_id long, category string, start long, end long")
    done = process(spark.createDataFrame([(1, "a@b.co"), (2, "none")], "doc_id long, text string"))
    wanted = found.withColumn("required", F.lit(True))
    evaluate.write_summary(evaluate.summarize(done, found, wanted), evaluate.case_results(done, found, wanted), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/summary").first().case_count == 2
    assert "- precision: 1.000" in {r.value for r in spark.read.text(f"{tmp_path}/summary_text").collect()}
    assert {r.doc_id: r.tp for r in spark.read.json(f"{tmp_path}/cases").collect()} == {1: 1, 2: 0}


def test_diff_and_bad_cases(spark, tmp_path):
    done = process(spark.createDataFrame([(1, "to a@b.co"), (2, "none")], "doc_id long, text string"))
    assert [(r.doc_id, r["diff"].splitlines()[-2:]) for r in report.review_diff(done).collect()] == [(1, ["-to a@b.co", "+to [EMAIL_1]"])]
    (tmp_path / "bad.jsonl").write_text('{"name":"n","text":"t","findings":{"a":1}}\n')
    with pytest.raises(Exception, match="must be a list"):
        cases(spark, str(tmp_path / "bad.jsonl")).collect()


def test_boxes_merge_line_by_line(spark):
    boxes = [(0, 0, 200, 10), (0, 12, 10, 22), (100, 12, 110, 22), (111, 12, 120, 22), (121, 14, 130, 24)]
    df = spark.createDataFrame([(1, 0, *map(float, b)) for b in boxes], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.y0, r.x0, r.x1, r.n) for r in glyphs.adjacent_merged(df).collect())
    assert got == [(0.0, 0.0, 200.0, 1), (12.0, 0.0, 10.0, 1), (12.0, 100.0, 120.0, 2), (14.0, 121.0, 130.0, 1)]


def test_names_do_not_collide(spark):
    df = spark.createDataFrame([(1, "d", "a.txt"), (2, "d", "a.txt"), (3, "e", "a.txt"), (4, "d", "b")], "i int, folder string, name string")
    assert [r.safe_name for r in ledger.collision_safe(df, "folder", "name", "i").orderBy("i").collect()] == ["a.txt", "a-2.txt", "a.txt", "b"]


def test_files(spark, tmp_path):
    for name, data in {"b.txt": b"x\r\ny", "a.TXT": b"1", "bad.txt": b"\xff", "~t.txt": b"", ".h.txt": b"", "c.md": b"", "d.txt.part": b"", "big.txt": b"x" * 99}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.text, r.error) for r in files(spark, str(tmp_path), max_bytes=50).collect()}
    assert got == {"a.TXT": ("1", None), "b.txt": ("x\ny", None), "bad.txt": (None, "not_utf8"), "big.txt": (None, "too_large")}


def test_cases(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"name":"n","text":"t","findings":[{"category":"EMAIL","text":"t","start":0,"end":1}]}\n\n')
    row = cases(spark, str(tmp_path / "c.jsonl")).collect()
    assert len(row) == 1 and row[0].findings[0].required
    (tmp_path / "t").mkdir(), (tmp_path / "e").mkdir()
    (tmp_path / "t" / "one.txt").write_text("hi"), (tmp_path / "e" / "one.json").write_text('{"findings":[]}')
    assert [tuple(r) for r in case_pairs(spark, str(tmp_path / "t"), str(tmp_path / "e")).collect()] == [("one", "hi", [])]


def test_glyphs(spark):
    rows = [(1, 0, line, i, c) for line, text in enumerate(["ﬁne  co-", "operate x"]) for i, c in enumerate(text)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line int, char int, c string")
    assert glyphs.page_text(df).first().text == "fine cooperate x"


def test_stream_resumes(spark, tmp_path):
    schema = "doc_id long, text string"
    src, out, led, ck = (str(tmp_path / x) for x in ("src", "out", "ledger", "ck"))
    spark.createDataFrame([(1, "a@b.co"), (2, "a@b.co")], schema).coalesce(1).write.parquet(src)
    watch(documents(spark, src, schema), out, led, ck).awaitTermination()
    spark.createDataFrame([(3, "a@b.co"), (4, "plain")], schema).coalesce(1).write.mode("append").parquet(src)
    watch(documents(spark, src, schema), out, led, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted((r.doc_id, r.sanitized) for r in got.collect()) == [(1, "[EMAIL_1]"), (4, "plain")]
    assert spark.read.parquet(led).count() == 2


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_percentiles_with_values_far_off(spark, rounds):
    import random

    rng = random.Random(3)
    groups = {"far": [rng.random() for _ in range(400)] + [1e300, -1e12], "one": [5.0], "equal": [2.5] * 90, "mixed": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(333)], None: [0.0, -0.5, 3.0, 3.0], "none": [None]}
    df = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "g string, v double").repartition(5)
    got = {r.g: r for r in evaluate.latencies(df, "v", ["g"], bins=16, rounds=rounds).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, own in groups.items():
        if g != "none":
            own = sorted(own)
            n = len(own)
            assert (got[g].n, got[g].p95, got[g]["median"]) == (n, own[int((n - 1) * 0.95)], (own[(n - 1) // 2] + own[n // 2]) / 2)
