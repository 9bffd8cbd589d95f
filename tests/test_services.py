import ipaddress
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.columns import folded
from palimpsest.operators import detectors, endpoints, job_events
from palimpsest.operators.contextual import chunk_rows, chunked, windows
from palimpsest.operators.policy import DEFAULT
from palimpsest.operators.rewrite import sanitize
from palimpsest.operators.verify import verify
from palimpsest.plans import progress
from palimpsest.plans.process import find, process
from palimpsest.sources import corpus, routed

START = datetime(2024, 5, 1)


def events(spark, rows):
    full = [(job, seq, START + timedelta(minutes=seq), kind, status, fields) for job, seq, kind, status, fields in rows]
    return spark.createDataFrame(full, job_events.EVENTS)


def plain_jobs(rows):
    """Jobs and refusals, one event after the other."""
    jobs, refused = {}, {}
    for job, seq, kind, status, fields in rows:
        own, why = jobs.get(job), None
        allowed = job_events.CREATED if kind == "create" else job_events.FIELDS
        if kind not in ("create", "update"):
            why = "unknown_kind"
        elif kind == "create" and own:
            why = "already_created"
        elif kind == "update" and not own:
            why = "unknown_job"
        elif set(fields or {}) - set(allowed):
            why = "unsupported_field"
        elif kind == "update" and status is not None and status not in job_events.RANK:
            why = "unknown_status"
        elif kind == "update" and status is not None and (own["status"], status) not in job_events.CHANGES:
            why = "illegal_change"
        refused[job, seq] = why
        if why:
            continue
        at = START + timedelta(minutes=seq)
        if kind == "create":
            own = jobs[job] = {"status": "pending", "created_at": at, "started_at": None, "completed_at": None, "fields": {}}
        elif status:
            own["status"] = status
            if status == "processing":
                own["started_at"] = at
            if job_events.RANK[status] == job_events.ENDED:
                own["completed_at"] = at
        own["fields"] |= fields or {}
    return jobs, refused


def test_job_events_as_one_by_one(spark):
    rng = random.Random(2)
    rows = []
    for job in [*map(str, range(60)), None]:
        for seq in range(rng.randrange(1, 14)):
            kind = rng.choice(["create"] + ["update"] * 5 + (["move"] if rng.random() < 0.1 else []))
            names = list(job_events.CREATED[:2]) if kind == "create" else ["findings_count", "output_path", "error_code"] + ["owner"] * (rng.random() < 0.3)
            fields = {n: rng.choice(["1", "2", None]) for n in names if rng.random() < 0.4} or rng.choice([None, {}])
            rows.append((job, seq, kind, None if kind == "create" else rng.choice([None, "odd", *job_events.RANK]), fields))
    table = events(spark, rows).repartition(5)
    jobs, refused = plain_jobs(rows)
    assert {(r.job_id, r.seq): r.refused for r in job_events.judged(table).collect()} == refused
    assert len(set(refused.values())) == 7
    got = {r.job_id: r for r in job_events.jobs(table).collect()}
    assert set(got) == set(jobs)
    for job, own in jobs.items():
        r = got[job]
        assert (r.status, r.created_at, r.started_at, r.completed_at) == (own["status"], own["created_at"], own["started_at"], own["completed_at"])
        fields = own["fields"]
        assert (r.output_path, r.error_code, r.source_path) == (fields.get("output_path"), fields.get("error_code"), fields.get("source_path"))
        assert r.findings_count == (None if fields.get("findings_count") is None else int(fields["findings_count"]))
    assert job_events.jobs(table.limit(0)).count() == 0


def test_a_crash_interrupts_what_is_active(spark):
    table = events(spark, [("a", 1, "create", None, {}), ("a", 2, "update", "analyzing", {}), ("b", 1, "create", None, {}), ("b", 2, "update", "completed", {}), ("c", 1, "create", None, None)])
    late = job_events.interruptions(job_events.jobs(table), F.lit(START + timedelta(days=1)))
    got = {r.job_id: (r.status, r.error_code) for r in job_events.jobs(table.unionByName(late)).collect()}
    assert got == {"a": ("interrupted", "INTERRUPTED"), "b": ("completed", None), "c": ("interrupted", "INTERRUPTED")}


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(4)
    texts = ["", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "12345::", "g::", ":1", "1:", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4",
             "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "::1.2.3.256", "1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.4.5", "256.0.0.1", " 10.0.0.1 ", "FE80::A%eth0", "10.0.0.1:80", "fdff:ffff::", "fc00::", "fe00::", "febf::1", "fec0::1"]
    for _ in range(300):
        x = rng.getrandbits(128) & ~(rng.choice([0, 0xFFFF << 64, ((1 << 80) - 1) << 32]))
        texts += [str(ipaddress.IPv6Address(x)), ipaddress.IPv6Address(x).exploded.upper(), str(ipaddress.IPv4Address(x & 0xFFFFFFFF)), f"::ffff:{ipaddress.IPv4Address(x & 0xFFFFFFFF)}"]
    for net in map(ipaddress.ip_network, endpoints.NETWORKS):
        texts += [str(x) for x in (net.network_address, net.broadcast_address, net.network_address - 1, net.broadcast_address + 1) if x]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in df.select("t", endpoints.address(F.col("t")).alias("a")).withColumn("k", endpoints.kind(F.col("a"))).collect():
        try:
            want = ipaddress.ip_address(r.t.strip().split("%")[0])
        except (ValueError, AttributeError):
            assert r.a is None and r.k is None, r.t
            continue
        number = int(want) + (0xFFFF << 32 if want.version == 4 else 0)
        assert ((r.a.hi & (1 << 64) - 1) << 64 | r.a.lo & (1 << 64) - 1) == number, r.t
        if want.version == 6 and want.ipv4_mapped:
            want = want.ipv4_mapped
        kinds = [k for n, k in endpoints.NETWORKS.items() if ipaddress.ip_network(n).version == want.version and want in ipaddress.ip_network(n)]
        assert r.k == (kinds[0] if kinds else "public"), r.t


def test_narrower_networks_win(spark):
    nets = {"10.0.0.0/8": "wide", "10.1.0.0/16": "narrow", "10.1.2.3/32": "one"}
    assert [k for _, _, k in endpoints.ranges(nets)] == ["wide", "narrow", "one", "narrow", "wide"]
    df = spark.createDataFrame([("10.1.2.3",), ("10.1.2.4",), ("10.2.0.0",), ("11.0.0.0",)], "t string")
    assert [r.k for r in df.select(endpoints.kind(endpoints.address(F.col("t")), nets).alias("k")).collect()] == ["one", "narrow", "wide", "public"]


def test_every_address_of_a_host_counts(spark):
    hosts = {
        "http://localhost:11434": ["127.0.0.1", "::1"], "https://inner.example": ["10.0.0.1", "fd00::1", "100.64.0.1"], "http://inner.example/x/": ["10.0.0.1"], "https://mixed.example": ["10.0.0.1", "8.8.8.8"],
        "https://public.example": ["8.8.8.8"], "https://none.example": [None], "https://odd.example": ["10.0.0.1", "nonsense"], "ftp://a.example": ["10.0.0.1"], "https://a.example?x=1": ["10.0.0.1"], "https://a.example:99999": ["10.0.0.1"],
        "https://half.example": ["127.0.0.1", "10.0.0.1"],
    }
    df = spark.createDataFrame([(u, a) for u, own in hosts.items() for a in own], "url string, address string")

    def refusals(*args, **kw):
        return {r.url: r.refused for r in endpoints.verdicts(df, *args, **kw).collect()}

    common = {"https://mixed.example": "mixed", "https://none.example": "no_addresses", "https://odd.example": "invalid_address", "ftp://a.example": "invalid_url", "https://a.example?x=1": "parameters", "https://a.example:99999": "invalid_url"}
    local = {"http://localhost:11434": None, "https://inner.example": "not_local", "http://inner.example/x/": "not_local", "https://public.example": "public", "https://half.example": "not_local"}
    assert refusals("local") == common | local
    private = {"http://localhost:11434": "not_private", "https://inner.example": None, "http://inner.example/x/": "insecure", "https://public.example": "public", "https://half.example": "not_private"}
    assert refusals("private-network") == common | private
    custom = {"http://localhost:11434": None, "https://inner.example": None, "http://inner.example/x/": None, "https://public.example": None, "https://half.example": None}
    assert refusals("custom", allow_public=True, allow_insecure=True) == common | custom
    kinds = {r.url: (r.kind, r.addresses) for r in endpoints.verdicts(df, "custom").collect()}
    assert kinds["https://inner.example"] == ("shared", 3) and kinds["https://mixed.example"] == ("public", 2) and kinds["https://none.example"] == (None, 0)
    with pytest.raises(ValueError):
        endpoints.verdicts(df, "other")


def test_redirects_lead_somewhere(spark):
    rows = [("https://a.example/x", "y", "https://a.example/x/y"), ("https://a.example", "/z?q", "https://a.example/z?q"), ("https://a.example/x", "//b.example/", "https://b.example/"), ("https://a.example/", "http://c.example", "http://c.example")]
    df = spark.createDataFrame(rows, "u string, l string, want string")
    assert df.where(endpoints.redirect_target(F.col("u"), F.col("l")) != F.col("want")).count() == 0


def test_table_function_gives_each_finding_once(spark):
    def names_in(text):
        at = text.find("Ann")
        while at >= 0:
            yield at, at + 3, "PERSON_NAME", 0.5 + 0.01 * at, "name"
            at = text.find("Ann", at + 1)
        yield 0, 10_000, "PERSON_NAME", 0.9, "out of the text"
        yield 0, 1, "NO_SUCH", 0.9, "no category"
        yield 0, 1, "OTHER", 1.5, "no confidence"

    texts = {1: "Ann met Bob and Ann. " * 30, 2: "nobody", 3: "", 4: None, 5: "Ann"}
    df = chunked(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), max_chars=50, overlap=20)
    assert df.where("doc_id = 1 and size(chunks) > 10").count() == 1
    detectors.register(spark, "find_ann", detectors.Detector("names", names_in))
    rows = detectors.detected(chunk_rows(df), "find_ann").collect()
    want = {(d, i, i + 3) for d, t in texts.items() for i in range(len(t or "")) if t[i : i + 3] == "Ann"}
    assert sorted((r.doc_id, r.start_at, r.end_at) for r in rows) == sorted(want)
    assert {(r.value, r.category, r.source) for r in rows} == {("Ann", "PERSON_NAME", "names")}
    first = min(r.confidence for r in rows)
    assert first == 0.5
    for bad in ("find_ann(1)", "find_ann(TABLE(SELECT 1 AS doc_id))"):
        with pytest.raises(Exception, match="must be a table|lacks"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def processed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, route string, name string, sanitized string")


def tree(at):
    return sorted(os.path.relpath(os.path.join(d, f), at) for d, _, files in os.walk(at) for f in files)


def test_files_are_written_by_route(spark, tmp_path):
    at = tmp_path / "out"
    (at / "release").mkdir(parents=True)
    (at / "release" / "a.txt").write_text("there before")
    rows = [(1, "release", "a.txt", "one"), (2, "release", "a.txt", "two ü"), (3, "quarantine", "a.txt", "three"), (4, "failed", "d.txt", None), (5, "release", "../x/y.txt", None)]
    names = {r.doc_id: r.safe_name for r in routed.write_files(processed(spark, rows).repartition(3), f"file://{at}").collect()}
    assert names == {1: "a-2.txt", 2: "a-3.txt", 3: "a.txt", 5: ".._x_y.txt"}
    assert tree(at) == ["quarantine/a.txt", "release/.._x_y.txt", "release/a-2.txt", "release/a-3.txt", "release/a.txt"]
    assert (at / "release" / "a.txt").read_text() == "there before" and (at / "release" / "a-3.txt").read_text() == "two ü" and (at / "release" / ".._x_y.txt").read_bytes() == b""
    routed.write_files(processed(spark, rows[:1]), f"file://{at}")
    assert (at / "release" / "a-4.txt").read_text() == "one" or (at / "release" / "a-2.txt").read_text() == "one"
    assert len(tree(at)) == 6


def test_two_attempts_leave_one_file(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["release"]), pa.array(["a.txt"]), pa.array([b"x"])], ["route", "name", "content"])
    writer = routed.RoutedWriter({"path": f"file://{tmp_path}", "job": "j"})
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.attempt != second.attempt
    writer.commit([second, None])
    assert tree(tmp_path) == ["release/a.txt"]
    late = routed.RoutedWriter({"path": f"file://{tmp_path}", "job": "k"})
    with pytest.raises(FileExistsError):
        late.commit([late.write(iter([batch]))])
    late.abort([])
    twice = routed.RoutedWriter({"path": f"file://{tmp_path}/other", "job": "l"})
    with pytest.raises(ValueError):
        twice.commit([twice.write(iter([batch])), twice.write(iter([batch]))])
    twice.abort([None])
    assert tree(tmp_path) == ["release/a.txt"]


def test_a_job_that_fails_shows_nothing(spark, tmp_path):
    spark.dataSource.register(routed.RoutedSink)
    rows = spark.range(20).repartition(4).selectExpr("'release' AS route", "if(id = 13, raise_error('no'), concat(id, '.txt')) AS name", "cast('x' AS binary) AS content")
    with pytest.raises(Exception, match="no"):
        rows.write.format("routed_files").mode("append").save(f"file://{tmp_path}/out")
    # tasks that were killed late may leave files in the hidden folder
    assert [x for x in tree(tmp_path) if not x.startswith(f"out/{routed.STAGED}/")] == []


def test_counts_come_from_the_run_itself(spark, tmp_path):
    df = spark.createDataFrame([(1, "to a@b.co and c@d.co"), (2, "none"), (3, None), (4, "password: x1y2z3")], "doc_id long, text string").repartition(3)
    run = progress.Progress()
    rows = run.observed(process(df)).collect()
    got = run.counts()
    assert got["detect"] == {"documents": 4, "findings": sum(len(r.findings) for r in rows)}
    assert got["merge"]["merged"] == sum(len(r.merged) for r in rows) and got["sanitize"] == {"replaced": sum(len(r.planned) for r in rows), "changed": 2}
    assert got["route"] == {x: sum(r.route == x for r in rows) for x in ("release", "quarantine", "failed")} and got["route"]["failed"] == 1
    src = str(tmp_path / "src")
    for part in ("doc_id < 3", "doc_id >= 3"):
        df.where(part).coalesce(1).write.mode("append").parquet(src)
    told = {}
    listener = progress.StageListener(lambda batch, counts: told.__setitem__(batch, counts))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        progress.observed_stream(process(stream)).select("doc_id", "sanitized").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert sorted(c["detect"]["documents"] for c in told.values()) == [2, 2]
    assert sum(c["sanitize"]["replaced"] for c in told.values()) == got["sanitize"]["replaced"]


def test_letters_fold_to_several(spark):
    pairs = [("Straße", "STRASSE"), ("ẞ", "ss"), ("ﬁn", "FIN"), ("Σας", "ΣΑΣ"), ("K", "k"), ("ſ", "S"), ("ŉ", "ʼN"), ("İ", "i̇"), ("É", "é")]
    df = spark.createDataFrame(pairs + [("ı", "i"), ("a", "b")], "a string, b string")
    assert [r.same for r in df.select((folded(F.col("a")) == folded(F.col("b"))).alias("same")).collect()] == [True] * len(pairs) + [False, False]
    done = process(spark.createDataFrame([(1, "secret: Straße and secret: STRASSE and secret: Strasze")], "doc_id long, text string")).first()
    assert [p.placeholder for p in done.planned] == ["[SECRET_1]", "[SECRET_1]", "[SECRET_2]"] or [p.placeholder for p in done.planned][0] == [p.placeholder for p in done.planned][1]


@pytest.mark.parametrize("n", [len(corpus.KINDS) * 5])
def test_every_kind_of_case_is_judged_right(spark, n):
    rows = corpus.cases(spark, n).withColumn("doc_id", F.monotonically_increasing_id())
    found = process(rows).select("name", "text", "merged", "findings").collect()
    expected = {r.name: [(f.category, f.text, f.start, f.end) for f in r.findings] for r in rows.collect()}
    for r in found:
        assert [(f.category, f.value, f.start, f.end) for f in r.merged] == expected[r.name], (r.name, r.text)
    categories = {c for own in expected.values() for c, *_ in own}
    assert categories == {"EMAIL", "PHONE", "SSN", "IP_ADDRESS", "URL", "CREDIT_CARD", "API_KEY", "PASSWORD", "SECRET"}
    assert sum(not k.categories for k in corpus.KINDS) > 19


def test_windows_of_many_texts_are_those_of_each(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "b", ". ", "! ", "\n", "\n\n", "? ", "\n"]) for _ in range(rng.randrange(120))) for _ in range(60)] + ["", None, "\n", ".", "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in chunked(df, max_chars=20, overlap=6, max_chunks=30).collect()}
    for i, t in enumerate(texts):
        spans = windows(t or "", 20, 6, 10_000)
        if len(spans) > 30:
            assert got[i].chunk_error == "too_many_windows" and got[i].chunks == []
            continue
        assert got[i].chunk_error is None and [(c.start, c.end) for c in got[i].chunks] == spans
        for a, b, (c, d) in zip(spans, spans[1:], zip(got[i].chunks, got[i].chunks[1:])):
            assert c.overlap_after == d.overlap_before == max(0, a[1] - b[0])
        assert [c["index"] for c in got[i].chunks] == list(range(len(spans)))
        for a, b in spans[:-1]:
            # the best mark that ends in the second half
            low = a + max(1, min(20, len(t) - a) // 2)
            best = next((t.rfind(m, low, a + 21) + len(m) for m in ("\n\n", ". ", "! ", "? ", "\n") if t.rfind(m, low, a + 21) >= 0), a + 20)
            assert b == best
    assert got[len(texts) - 1].chunk_error == "too_many_windows"


def generated(spark, text, found):
    kind = "array<struct<start:int,end:int,category:string,value:string,confidence:double,sources:array<string>,reason:string>>"
    df = spark.createDataFrame([(1, text, [], [(a, b, c, text[a:b], 1.0, ["x"], "") for a, b, c in found])], f"doc_id long, sanitized string, planned array<struct<start:int,end:int,placeholder:string,category:string,value:string,confidence:double,sources:array<string>>>, more {kind}")
    return verify(df, DEFAULT, contextual=F.col("more")).first()


def test_what_the_rewriting_wrote_is_no_finding(spark):
    text = "password: [REDACTED_PASSWORD] by [EMAIL_1] and EMAIL or API KEY; EMAIL [EMAIL_1]; token =; Bob"
    spans = {x: (text.index(x), text.index(x) + len(x)) for x in ("[EMAIL_1]", "EMAIL or", "API KEY", "EMAIL [EMAIL_1]", "token =", "Bob", "EMAIL_1", "password: [REDACTED_PASSWORD]")}
    spans["EMAIL or"] = (spans["EMAIL or"][0], spans["EMAIL or"][0] + 5)
    own = [(*v, "OTHER") for v in spans.values()]
    row = generated(spark, text, own)
    # labels, placeholders, parts of placeholders, assignments and composites of these go; a name stays
    assert [f.value for f in row.remaining_findings if "x" in f.sources] == ["Bob"]
    assert row.ignored_placeholders >= len(own) - 1 and row.contextual_left == 1 and row.remaining == 1 and not row.passed


def test_findings_of_rewritten_texts_only_are_searched_again(spark):
    df = spark.createDataFrame([(1, "to a@b.co"), (2, "none"), (3, "see https://x.example/y")], "doc_id long, text string")
    done = sanitize(find(df), DEFAULT)
    known, again = verify(done, DEFAULT, known=F.col("findings")), verify(done, DEFAULT)
    columns = ["doc_id", "originals_left", "deterministic_left", "remaining", "passed"]
    assert sorted(map(tuple, known.select(*columns).collect())) == sorted(map(tuple, again.select(*columns).collect()))
    # where nothing was replaced, what is handed over stands: here nothing
    told = verify(done.withColumns({"planned": F.slice("planned", 1, 0), "sanitized": F.lit("no findings here, but those of the text before: a@b.co")}), DEFAULT, known=F.slice("findings", 1, 0))
    assert {r.doc_id: r.deterministic_left for r in told.collect()} == {1: 0, 2: 0, 3: 0}

