"""Streaming queries: the tables are read as streams and drained."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptorium.operators import confusion as C
from scriptorium.operators.feedback import fingerprint
from scriptorium.sources.files import scratch
from scriptorium.streaming import jobs as J

from .catalog import query
from .views import Views


def _stream(spark, d, df=None):
    """The events as a stream of files; other inputs are written to the scratch folder first."""
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{folder}/in"
    df = Views(spark, d).table("events") if df is None else df
    df.write.parquet(source)
    return spark.readStream.schema(df.schema).parquet(source), folder


@query("str1_feedback_stream", """
SELECT submission_id, count(*) AS n, min(event_id) AS accepted_id FROM feedback GROUP BY submission_id""", "feedback")
def str1(spark, d):
    rows = Views(spark, d).feedback.withColumn("fingerprint", fingerprint()).select("submission_id", "event_id", "fingerprint", "ts")
    stream, folder = _stream(spark, d, rows)
    verdicts = J.drain(J.feedback_verdicts(stream), folder, "verdicts")
    return verdicts.groupBy("submission_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("verdict") == "accepted", F.col("event_id"))).alias("accepted_id"))


@query("str1_anonymous_feedback", """
SELECT submission_id, count(*) AS n, min(event_id) AS accepted_id FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'event:' || event_id ELSE submission_id END AS submission_id, event_id FROM feedback) GROUP BY submission_id""", "feedback")
def str1_anonymous(spark, d):
    own = F.when(F.col("event_id") % 5 != 0, F.col("submission_id"))
    rows = Views(spark, d).feedback.withColumn("fingerprint", fingerprint()).select(own.alias("submission_id"), "event_id", "fingerprint", "ts")
    stream, folder = _stream(spark, d, rows)
    verdicts = J.drain(J.feedback_verdicts(stream), folder, "verdicts")
    return verdicts.groupBy("submission_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("verdict") == "accepted", F.col("event_id"))).alias("accepted_id"))


@query("str2_edit_debounce")
def str2(spark, d):
    rows = Views(spark, d).table("events").selectExpr("user_id as doc_id", "cast(get_json_object(props, '$.k') as bigint) % 4 as line_no", "event_id", "ts")
    stream, folder = _stream(spark, d, rows)
    return J.drain(J.debounced(stream, "1 hour"), folder, "bursts")


@query("str2_edit_commits", """
WITH e AS (SELECT user_id AS doc_id, CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS line_no, event_id, event_type AS text, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS original, event_id % 7 = 0 AS flush, ts FROM events),
  o AS (SELECT *, lead(ts) OVER (PARTITION BY doc_id, line_no ORDER BY ts, event_id) AS later FROM e)
SELECT doc_id, line_no, event_id, text FROM o WHERE text <> original AND (flush OR later >= ts + INTERVAL 1 HOUR OR (later IS NULL AND ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 10 SECOND))""")
def str2_commits(spark, d):
    rows = Views(spark, d).table("events").selectExpr(
        "user_id as doc_id", "cast(get_json_object(props, '$.k') as bigint) % 4 as line_no", "event_id", "event_type as text", "case when event_id % 3 = 0 then event_type else '' end as original", "event_id % 7 = 0 as flush", "ts"
    )
    stream, folder = _stream(spark, d, rows)
    return J.drain(J.edit_commits(stream, "1 hour"), folder, "commits")


@query("str3_confusion_stream")
def str3(spark, d):
    v = Views(spark, d)
    mined = C.mine(v.ref_hyp.filter("lower(ref) <> lower(hyp)").selectExpr("hyp as prediction", "ref as correction"), longest=None).filter("op = 'substitute'").select("a", "b", "n")
    stream, folder = _stream(spark, d, mined)
    return J.drain(J.confusion_updates(stream), folder, "costs", "update").drop("batch")


_DOC_EVENTS = [
    "user_id as doc_id", "event_id", "ts", "case when event_id % 41 = 0 then 'complete' when event_id % 17 = 0 then 'metadata' else 'line' end as kind",
    "cast(event_id % 3 as int) as page", "event_id % 30 as line", "concat(event_type, ' ', event_id) as text", "event_id % 20 as total",
]


@query("str4_document_assembly", """
WITH e AS (SELECT user_id AS doc_id, event_id, ts, CASE WHEN event_id % 41 = 0 THEN 'complete' WHEN event_id % 17 = 0 THEN 'metadata' ELSE 'line' END AS kind, event_id % 3 AS page, event_id % 30 AS line,
    event_type || ' ' || event_id AS text, event_id % 20 AS total FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS pos FROM e),
  r AS (SELECT doc_id, max(pos) FILTER (kind <> 'line') AS since, max(pos) AS last_pos, max_by(event_id, pos) AS event_id FROM n GROUP BY doc_id),
  s AS (SELECT r.doc_id, r.event_id, coalesce(since, 0) AS since, last_pos - coalesce(since, 0) AS decoded, n.kind, n.text, CASE WHEN n.kind = 'metadata' AND n.total > 0 THEN n.total ELSE 13 END AS expected
    FROM r LEFT JOIN n ON n.doc_id = r.doc_id AND n.pos = r.since),
  l AS (SELECT n.doc_id, page, line, min(pos) AS place, max_by(n.text, pos) AS text FROM n JOIN s ON n.doc_id = s.doc_id AND pos > since GROUP BY n.doc_id, page, line),
  p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY place) AS t FROM l GROUP BY doc_id, page),
  f AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page) AS t FROM p GROUP BY doc_id)
SELECT s.doc_id, event_id, decoded, CASE WHEN kind = 'complete' AND decoded = 0 THEN 100 ELSE least(95, 30 + 65 * decoded // expected) END AS progress, coalesce(kind = 'complete' AND decoded = 0, false) AS complete,
  CASE WHEN kind = 'complete' AND decoded = 0 THEN text ELSE coalesce(t, '') END AS full_text FROM s LEFT JOIN f ON f.doc_id = s.doc_id""")
def str4(spark, d):
    # in three runs by time: state goes on from one to the next, and the last version of each document stays
    rows = Views(spark, d).table("events").selectExpr(*_DOC_EVENTS)
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    for part in _thirds(rows):
        part.write.mode("append").parquet(f"{folder}/in")
        versions = J.drain(J.document_assembly(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder, "documents", "update")
    last = versions.groupBy("doc_id").agg(F.max_by(F.struct("event_id", "decoded", "progress", "complete", "full_text"), "batch").alias("v"))
    return last.select("doc_id", "v.*")


def _thirds(rows):
    """The rows by time, cut at days 10 and 20 of the events' month."""
    day = F.dayofmonth("ts")
    return [rows.filter(day < 10), rows.filter((day >= 10) & (day < 20)), rows.filter(day >= 20)]


@query("str5_job_status", """
WITH e AS (SELECT user_id AS job_id, event_id, ts, event_type AS status, floor(value / 50)::BIGINT AS progress FROM events),
  w AS (SELECT *, lag(status) OVER o AS s, lag(progress) OVER o AS p, lag(ts) OVER o AS before, lead(ts) OVER o AS after FROM e WINDOW o AS (PARTITION BY job_id ORDER BY ts, event_id))
SELECT job_id, event_id, status, progress, ts AS at FROM w WHERE status IS DISTINCT FROM s OR progress IS DISTINCT FROM p OR before + CASE WHEN s IN ('purchase', 'error') THEN INTERVAL 6 HOUR ELSE INTERVAL 30 DAY END <= ts
UNION ALL SELECT job_id, event_id, 'expired', progress, ts + INTERVAL 6 HOUR FROM w
WHERE status IN ('purchase', 'error') AND (after >= ts + INTERVAL 6 HOUR OR (after IS NULL AND ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR))""")
def str5(spark, d):
    rows = Views(spark, d).table("events").selectExpr("user_id as job_id", "event_id", "ts", "event_type as status", "floor(value / 50) as progress")
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    for part in _thirds(rows):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        changes = J.drain(J.job_changes(stream, ("purchase", "error"), "6 hours"), folder, "changes")
    return changes.withColumn("at", F.col("at").cast("timestamp_ntz"))


#: Rows come in three runs by time; every fiftieth comes a run late.
_ARRIVALS = "WITH e AS (SELECT *, CASE WHEN day(ts) < 10 THEN 0 WHEN day(ts) < 20 THEN 1 ELSE 2 END + (event_id % 50 = 0)::INT AS run FROM events), m AS (SELECT r, (SELECT max(ts) FROM e WHERE run < r) - INTERVAL 10 MINUTE AS closed FROM range(4) t(r)),\n  a AS (SELECT e.*, time_bucket(INTERVAL 1 HOUR, ts) AS start, coalesce(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= closed, false) AS late FROM e JOIN m ON run = r)"


def _late_runs(spark, d):
    rows = Views(spark, d).table("events")
    run = F.expr("case when dayofmonth(ts) < 10 then 0 when dayofmonth(ts) < 20 then 1 else 2 end + case when event_id % 50 = 0 then 1 else 0 end")
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(4):
        rows.filter(run == k).write.mode("append").parquet(f"{folder}/in")
        yield spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder


@query("str6_step_metrics", f"""
{_ARRIVALS} SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(sum(value) / count(*), 4) AS mean, round(count(*) / 3600.0::DOUBLE, 6) AS rate
FROM a WHERE NOT late AND start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE GROUP BY start, event_type""")
def str6(spark, d):
    for stream, folder in _late_runs(spark, d):
        out = J.drain(J.windowed_metrics(stream), folder, "hours")
    return out


@query("str6_late_steps", f"{_ARRIVALS} SELECT event_id, event_type, start FROM a WHERE late")
def str6_late(spark, d):
    for stream, folder in _late_runs(spark, d):
        side = J.LateRows(f"{folder}/side")
        J.side_output(stream, f"{folder}/side", side)
    return side.read(spark).select("event_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"))


@query("str6_sliding_metrics", """
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(sum(value) / count(*), 4) AS mean, round(count(*) / 3600.0::DOUBLE, 6) AS rate
FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS start, event_type, value FROM events)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def str6_sliding(spark, d):
    stream, folder = _stream(spark, d)
    return J.drain(J.windowed_metrics(stream, "1 hour", "30 minutes"), folder, "sliding")
