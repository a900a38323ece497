"""Streams against plain Python, over several runs of one checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.streaming import jobs as J

START = dt.datetime(2024, 1, 1)
AT = lambda s: START + dt.timedelta(seconds=s)


def runs(spark, tmp_path, parts, schema):
    """The stream of a folder as each of ``parts`` has been added."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        yield spark.readStream.schema(schema).parquet(f"{tmp_path}/in")


def cut(rows, k):
    size = -(-len(rows) // k)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_documents_go_on_from_run_to_run(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for e in range(90):
        kind = rng.choice(["line"] * 8 + ["metadata", "complete"])
        rows.append((e % 4, e, AT(e), kind, rng.randrange(1, 3), rng.randrange(5), f"t{e}", rng.randrange(9)))
    rows.append((9, 500, AT(500), "line", 2, 1, "alone", 0))
    want, state = {}, {}
    for doc, e, _, kind, page, line, text, total in rows:
        expected, decoded, lines, whole = state.get(doc, (13, 0, {}, None))
        if kind == "line":
            decoded, whole = decoded + 1, None
            lines = {**lines, (page, line): text}
        else:
            expected, decoded, lines = (total or 13) if kind == "metadata" else 13, 0, {}
            whole = text if kind == "complete" else None
        state[doc] = expected, decoded, lines, whole
        pages = {}
        for (p, _), t in lines.items():
            pages.setdefault(p, []).append(t)
        full = "\n\n".join("\n".join(pages[p]) for p in sorted(pages)) if whole is None else whole
        want[doc] = (e, decoded, 100 if whole is not None else min(95, 30 + 65 * decoded // expected), whole is not None, full)
    schema = "doc_id long, event_id long, ts timestamp, kind string, page int, line long, text string, total long"
    for stream in runs(spark, tmp_path, cut(rows, 3), schema):
        out = J.drain(J.document_assembly(stream), f"file://{tmp_path}", "docs", "update")
    last = out.groupBy("doc_id").agg(F.max_by(F.struct("event_id", "decoded", "progress", "complete", "full_text"), "batch").alias("v")).collect()
    assert {r.doc_id: tuple(r.v) for r in last} == want


def test_terminal_jobs_expire_once(spark, tmp_path):
    rows = [(1, 1, AT(0), "RUNNING", 10), (1, 2, AT(60), "RUNNING", 10), (1, 3, AT(120), "COMPLETED", 100), (2, 4, AT(130), "RUNNING", 5), (3, 5, AT(140), "FAILED", 0)]
    rows += [(3, 6, AT(140 + 3600), "FAILED", 0), (4, 7, AT(90_000), "RUNNING", 1), (4, 8, AT(90_001), "RUNNING", 2)]
    schema = "job_id long, event_id long, ts timestamp, status string, progress long"
    for stream in runs(spark, tmp_path, cut(rows, 2), schema):
        out = J.drain(J.job_changes(stream), f"file://{tmp_path}", "jobs")
    got = sorted((r.job_id, r.event_id, r.status, r.at) for r in out.collect())
    want = [(1, 1, "RUNNING", AT(0)), (1, 3, "COMPLETED", AT(120)), (1, 3, "expired", AT(3720)), (2, 4, "RUNNING", AT(130))]
    want += [(3, 5, "FAILED", AT(140)), (3, 5, "expired", AT(3740)), (3, 6, "FAILED", AT(3740)), (3, 6, "expired", AT(7340)), (4, 7, "RUNNING", AT(90_000)), (4, 8, "RUNNING", AT(90_001))]
    assert got == sorted(want)


def test_closed_windows_leave_the_state_and_late_rows_go_aside(spark, tmp_path):
    hours = [[(k, AT(3600 * h + k % 3600), "a", 1.0) for k in range(6)] for h in range(5)]
    hours[3].append((99, AT(10), "a", 50.0))  # its window closed two runs ago
    schema = "event_id long, ts timestamp, event_type string, value double"
    held, side = [], J.LateRows(f"file://{tmp_path}/side")
    for stream in runs(spark, tmp_path, hours, schema):
        query = J.windowed_metrics(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out")
        query = query.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        J.side_output(stream, f"file://{tmp_path}/side", side)
    assert max(held) <= 2 and held[-1] <= 2  # of five windows
    out = {r.start: (r.n, r.total, r.mean, r.rate) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {AT(3600 * h): (6, 6.0, 1.0, round(6 / 3600, 6)) for h in range(len(out))} and len(out) >= 3
    assert [r.event_id for r in side.read(spark).collect()] == [99]
    # a batch that is run again overwrites what it wrote
    side(spark.createDataFrame(hours[3], schema), 3)
    assert [r.event_id for r in side.read(spark).collect()] == [99]


def test_anonymous_rows_are_submissions_of_their_own(spark, tmp_path):
    rows = [(None, 1, "x", AT(1)), (None, 2, "x", AT(2)), ("s", 3, "x", AT(3)), ("s", 4, "x", AT(4)), ("s", 5, "y", AT(5))]
    for stream in runs(spark, tmp_path, [rows], "submission_id string, event_id long, fingerprint string, ts timestamp"):
        out = J.drain(J.feedback_verdicts(stream), f"file://{tmp_path}", "verdicts")
    assert {r.event_id: r.verdict for r in out.collect()} == {1: "accepted", 2: "accepted", 3: "accepted", 4: "replayed", 5: "conflict"}


@pytest.mark.parametrize("times", [1, 3])
def test_live_costs_fold_updates(spark, tmp_path, times):
    rows = [("a", "o", 3), ("a", "o", 2), ("c", "e", 400)]
    cost = 1.2
    for _ in range(5):
        cost = max(0.15, round(cost * 0.95, 4))
    for stream in runs(spark, tmp_path, cut(rows, times), "a string, b string, n long"):
        out = J.drain(J.confusion_updates(stream), f"file://{tmp_path}", "costs", "update")
    last = out.groupBy("a", "b").agg(F.max_by(F.struct("cost", "update_count"), "update_count").alias("v")).collect()
    assert {(r.a, r.b): tuple(r.v) for r in last} == {("a", "o"): (cost, 5), ("c", "e"): (0.15, 400)}


def test_state_of_many_ids_is_shared_and_each_id_ends_on_its_own(spark, tmp_path):
    def run(day, rows):
        frame = spark.createDataFrame([(i, e, f, f"2024-01-{day:02d} 00:00:00") for i, e, f in rows], "submission_id string, event_id long, fingerprint string, ts string")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("submission_id string, event_id long, fingerprint string, ts timestamp").parquet(f"{tmp_path}/in")
        query = J.feedback_verdicts(stream, "1 day", 4).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        return {p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress}

    assert max(run(1, [(f"s{k}", k, "x") for k in range(500)] + [("s7", 600, "y")])) <= 4
    run(5, [("late", 700, "x")])
    run(5, [("late", 701, "x")])
    assert max(run(5, [("late", 702, "x"), ("s7", 703, "y")])) <= 4
    got = {r.event_id: r.verdict for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 505 and got[600] == "conflict"
    assert (got[701], got[702], got[703]) == ("accepted", "replayed", "accepted")  # the first is forgotten as the watermark comes to day 4
