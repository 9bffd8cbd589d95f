"""Queries over jobs, looks at files, endpoints and detectors of one's own, from the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import contextual, detectors, endpoints, job_events
from palimpsest.plans.catalog import WINDOWS_SQL, docs, query, span_sql
from palimpsest.streaming import stability

# Each user's events as those of a job: most of them are illegal changes.
_JOB_EVENTS = """
SELECT CAST(user_id AS STRING) AS job_id, event_id AS seq, ts, ts AS at, CASE WHEN event_type = 'signup' THEN 'create' ELSE 'update' END AS kind,
  CASE WHEN event_type = 'signup' THEN NULL WHEN event_id % 29 = 0 THEN 'lost' WHEN event_type = 'click' THEN 'processing'
    WHEN event_type = 'view' THEN CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'analyzing' WHEN 2 THEN 'sanitizing' ELSE 'verifying' END
    WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'quarantined' END WHEN event_id % 3 = 0 THEN 'failed' END AS status,
  CASE WHEN event_type = 'signup' THEN 'source_filename' WHEN event_id % 17 = 0 THEN 'owner' WHEN event_type = 'error' THEN 'error_code' WHEN event_type = 'purchase' THEN 'output_path'
    WHEN event_type = 'view' THEN 'findings_count' END AS field,
  CASE WHEN event_type = 'view' THEN CAST(CAST(floor(value) AS BIGINT) AS STRING) ELSE event_type || '/' || event_id END AS v FROM events"""
_CHANGES = ", ".join(f"'{a}>{b}'" for a, b in sorted(job_events.CHANGES))
_STATUSES = ", ".join(f"'{s}'" for s in job_events.RANK)
_JOB_FIELDS = ", ".join(f"'{f}'" for f in job_events.FIELDS)
# A job's events one after the other, each with the status it finds.
_FOLDED = f"""WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS i FROM ({_JOB_EVENTS.replace("AS STRING", "AS VARCHAR")})),
step AS (SELECT job_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS st, CAST(NULL AS VARCHAR) AS refused FROM (SELECT DISTINCT job_id FROM ev)
  UNION ALL SELECT e.job_id, e.i, CASE WHEN r IS NOT NULL THEN st WHEN kind = 'create' THEN 'pending' ELSE coalesce(status, st) END, r FROM (
    SELECT e.*, s.st, CASE WHEN kind = 'create' AND st IS NOT NULL THEN 'already_created' WHEN kind = 'update' AND st IS NULL THEN 'unknown_job'
      WHEN kind = 'update' AND field NOT IN ({_JOB_FIELDS}) THEN 'unsupported_field' WHEN status NOT IN ({_STATUSES}) THEN 'unknown_status'
      WHEN kind = 'update' AND status IS NOT NULL AND st || '>' || status NOT IN ({_CHANGES}) THEN 'illegal_change' END AS r
    FROM ev e JOIN step s ON e.job_id = s.job_id AND e.i = s.i + 1) AS e),
good AS (SELECT e.*, s.refused FROM ev e JOIN step s ON e.job_id = s.job_id AND e.i = s.i)"""


def _clock_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def _clock(x: str):
    """A time of the table as text, which no time zone changes."""
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _events(spark, sf_dir) -> DataFrame:
    rows = spark.sql(_JOB_EVENTS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    fields = F.when(F.col("field").isNotNull(), F.create_map("field", "v")).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("job_id", "seq", "at", "kind", "status", fields.alias("fields"))


@query(_FOLDED + " SELECT job_id, seq, refused FROM good")
def job_changes(spark, sf_dir):
    """Every event, and why it was refused."""
    return job_events.judged(_events(spark, sf_dir)).select("job_id", "seq", "refused")


@query(
    _FOLDED
    + f""" SELECT job_id, coalesce(arg_max(status, seq) FILTER (WHERE status IS NOT NULL), 'pending') AS status, count(*) AS events, {_clock_sql("min(ts) FILTER (WHERE kind = 'create')")} AS created,
  {_clock_sql("min(ts) FILTER (WHERE status = 'processing')")} AS started, {_clock_sql("min(ts) FILTER (WHERE status IN ('completed', 'quarantined', 'failed', 'interrupted'))")} AS completed,
  arg_max(v, seq) FILTER (WHERE field = 'source_filename') AS source_filename, CAST(arg_max(v, seq) FILTER (WHERE field = 'findings_count') AS INTEGER) AS findings_count,
  arg_max(v, seq) FILTER (WHERE field = 'output_path') AS output_path, arg_max(v, seq) FILTER (WHERE field = 'error_code') AS error_code
FROM good WHERE refused IS NULL GROUP BY job_id"""
)
def job_table(spark, sf_dir):
    """The jobs that the events lead to."""
    found = job_events.jobs(_events(spark, sf_dir))
    times = [_clock(f"{x}_at").alias(x) for x in ("created", "started", "completed")]
    return found.select("job_id", "status", "events", *times, "source_filename", "findings_count", "output_path", "error_code")


@query(
    """WITH l AS (SELECT user_id, len(event_type) AS n, date_trunc('day', ts) AS m, ts FROM events),
r AS (SELECT *, CASE WHEN n = lag(n) OVER w AND m = lag(m) OVER w THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, n, m)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, n, m ROWS UNBOUNDED PRECEDING) AS run FROM r),
s AS (SELECT *, min(ts) OVER (PARTITION BY user_id, run) AS since FROM k)
SELECT user_id, CAST(n AS BIGINT) AS n_bytes, strftime(since, '%Y-%m-%d %H:%M:%S.%f') AS since, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS settled FROM s WHERE epoch_us(ts) - epoch_us(since) >= 600000000 GROUP BY user_id, run, n, since"""
)
def settled_files(spark, sf_dir):
    """Looks at files that find the size and day of a look ten minutes before: each user's events stand for looks at one file."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seen = events.select(F.col("user_id").alias("path"), F.length("event_type").cast("long").alias("n_bytes"), F.date_trunc("day", "ts").alias("modified"), F.col("ts").alias("seen"))
    return stability.settled(seen, 600).select(F.col("path").alias("user_id"), "n_bytes", _clock("since").alias("since"), _clock("settled").alias("settled"))


# Addresses of hosts: one an event, IPv4, mapped and IPv6 in several spellings, and some that are none.
_ADDRESS = """CASE event_id % 11 WHEN 0 THEN '127.' || (event_id % 256) || '.0.1' WHEN 1 THEN '10.1.' || (event_id % 256) || '.9' WHEN 2 THEN '172.' || (event_id % 64) || '.0.7'
  WHEN 3 THEN '100.' || (event_id % 256) || '.3.3' WHEN 4 THEN '::ffff:192.168.' || (event_id % 256) || '.1' WHEN 5 THEN 'fd' || lpad(CAST(event_id % 100 AS STRING), 2, '0') || '::1:' || (event_id % 10)
  WHEN 6 THEN 'FE80::' || (event_id % 10) || '%eth0' WHEN 7 THEN '2001:db8:0:0:0:0:' || (event_id % 10000) || ':1' WHEN 8 THEN CASE WHEN event_id % 5 = 0 THEN '::1' ELSE '0:0:0:0:0:0:0:1' END
  WHEN 9 THEN '8.8.' || (event_id % 256) || '.8' WHEN 10 THEN CASE WHEN event_id % 7 = 0 THEN '1::2::3' WHEN event_id % 7 = 1 THEN '256.1.1.1' WHEN event_id % 7 = 2 THEN '::ffff:7f00:1' ELSE '127.0.0.1' END END"""
# The kind by the first numbers of each spelling.
_KIND_SQL = """CASE event_id % 11 WHEN 0 THEN 'loopback' WHEN 1 THEN 'private' WHEN 2 THEN CASE WHEN event_id % 64 BETWEEN 16 AND 31 THEN 'private' ELSE 'public' END
  WHEN 3 THEN CASE WHEN event_id % 256 BETWEEN 64 AND 127 THEN 'shared' ELSE 'public' END WHEN 4 THEN 'private' WHEN 5 THEN 'private' WHEN 6 THEN 'private' WHEN 7 THEN 'public' WHEN 8 THEN 'loopback'
  WHEN 9 THEN 'public' WHEN 10 THEN CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE 'loopback' END END"""


def _addresses(spark, sf_dir) -> DataFrame:
    return spark.sql(f"SELECT event_id, user_id, {_ADDRESS} AS address FROM {{events}}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))


@query(f"SELECT event_id, {_KIND_SQL} AS kind FROM events")
def address_kinds(spark, sf_dir):
    return _addresses(spark, sf_dir).select("event_id", endpoints.kind(endpoints.address(F.col("address"))).alias("kind"))


_SCHEME = "CASE user_id % 2 WHEN 0 THEN 'https' ELSE 'http' END || '://h' || user_id || '-' || (event_id % 5) || '.example.org' || CASE WHEN user_id % 13 = 0 THEN '/?q=1' ELSE '' END"


@query(
    f"""WITH a AS (SELECT {_SCHEME} AS url, {_KIND_SQL} AS k FROM events),
g AS (SELECT url, count(*) AS n, bool_or(k IS NULL) AS odd, coalesce(bool_or(k = 'public'), false) AS pub, coalesce(bool_or(k IN ('private', 'shared')), false) AS inner_, coalesce(bool_or(k = 'shared'), false) AS sh,
  coalesce(bool_or(k = 'loopback'), false) AS lo FROM a GROUP BY url)
SELECT url, n AS addresses, CASE WHEN pub THEN 'public' WHEN sh THEN 'shared' WHEN inner_ THEN 'private' WHEN lo THEN 'loopback' END AS kind,
  CASE WHEN contains(url, '?') THEN 'parameters' WHEN odd THEN 'invalid_address' WHEN pub AND (inner_ OR lo) THEN 'mixed' WHEN pub THEN 'public' WHEN lo THEN 'not_private' WHEN starts_with(url, 'http:') THEN 'insecure' END AS refused FROM g"""
)
def endpoint_verdicts(spark, sf_dir):
    """Which hosts a private network may call, by all their addresses."""
    rows = _addresses(spark, sf_dir).select(F.expr(_SCHEME).alias("url"), "address")
    return endpoints.verdicts(rows, "private-network")


_LISTED = ("token", "address")


def _listed_terms(text: str):
    """Spans of two listed words."""
    for term in _LISTED:
        at = text.find(term)
        while at >= 0:
            yield at, at + len(term), "OTHER", 0.8, "listed word"
            at = text.find(term, at + len(term))


@query(
    "WITH " + ", ".join(span_sql(f"w{i}", f"({t})") for i, t in enumerate(_LISTED))
    + " SELECT doc_id, pos AS start_at, CAST(pos + len(value) AS BIGINT) AS end_at, 'OTHER' AS category, 'words' AS source FROM (" + " UNION ALL ".join(f"SELECT doc_id, pos, value FROM w{i}" for i in range(len(_LISTED))) + ")"
)
def table_function_detect(spark, sf_dir):
    """A detector of one's own over windows of all documents, called from SQL."""
    windows = contextual.chunk_rows(contextual.chunked(docs(spark, sf_dir), max_chars=2000, overlap=100, max_chunks=1_000_000))
    detectors.register(spark, "detect_listed_words", detectors.Detector("words", _listed_terms))
    return detectors.detected(windows, "detect_listed_words").select("doc_id", "start_at", "end_at", "category", "source")


@query(WINDOWS_SQL + " SELECT doc_id, CAST(i AS BIGINT) AS chunk, a AS start_at, e AS end_at, CAST(CASE WHEN i > 0 THEN 150 ELSE 0 END AS BIGINT) AS before, CAST(CASE WHEN b IS NULL THEN 0 ELSE 150 END AS BIGINT) AS after FROM e")
def chunk_overlaps(spark, sf_dir):
    """Windows with what they share with the ones before and behind."""
    rows = contextual.chunked(docs(spark, sf_dir), max_chars=1500, overlap=150, max_chunks=1_000_000)
    c = [F.col(f"c.{a}").cast("long").alias(b) for a, b in (("index", "chunk"), ("start", "start_at"), ("end", "end_at"), ("overlap_before", "before"), ("overlap_after", "after"))]
    return rows.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", *c)
