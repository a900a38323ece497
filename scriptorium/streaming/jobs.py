"""Streams of corrections, edits, job events, document events and step metrics.

Event time is ``ts``; late rows are dropped after the watermark. State is keyed and bounded by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State of ``transformWithStateInPandas`` needs this store.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def own_id() -> Column:
    """A submission's id; an anonymous one gets an id of its own from its event."""
    return F.coalesce("submission_id", F.concat(F.lit("event:"), F.col("event_id").cast("string")))


def accept_feedback(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The accept path of idempotent submissions: the first row of each id within the watermark; anonymous
    rows are all accepted."""
    return _timed(stream, late).withColumn("submission_id", own_id()).dropDuplicatesWithinWatermark(["submission_id"])


def feedback_verdicts(stream: DataFrame, late: str = "1 day", buckets: int = 1024) -> DataFrame:
    """Every row with its verdict: accepted, replayed (same id and content) or conflict (same id,
    other content). ``stream`` has submission_id, event_id, fingerprint, ts; see ``own_id`` for null ids.

    Ids share ``buckets`` of state, as a call into Python for each of millions of ids costs more than its rows; each id still
    has its own end: it is forgotten once the watermark is ``late`` beyond that of its last row."""

    kept_ms = max(1, int(pd.Timedelta(late).total_seconds() * 1000))  # an id is remembered as long as it may come again

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = max(state.getCurrentWatermarkMs(), 0)
        held = {i: (fp, end) for i, fp, end in zip(*state.get, strict=True)} if state.exists else {}
        seen = set()
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            verdicts = []
            for i, fp in zip(rows["submission_id"].tolist(), rows["fingerprint"].tolist(), strict=True):
                first = held[i][0] if i in held else None
                verdicts.append("accepted" if first is None else "replayed" if fp == first else "conflict")
                if i not in seen:
                    held[i] = (fp if first is None else first, now + kept_ms)
                    seen.add(i)
            yield rows[["submission_id", "event_id"]].assign(verdict=verdicts)
        left = [(i, fp, end) for i, (fp, end) in held.items() if i in seen or end >= now]
        if left:
            state.update(tuple(list(c) for c in zip(*left, strict=True)))
            state.setTimeoutTimestamp(min(end for *_, end in left))
        elif state.exists:
            state.remove()

    keyed = _timed(stream, late).withColumn("submission_id", own_id()).withColumn("bucket", F.pmod(F.hash("submission_id"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInPandasWithState(
        judge, "submission_id string, event_id long, verdict string", "ids array<string>, fingerprints array<string>, ends array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def debounced(stream: DataFrame, quiet: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last value of each burst of edits to a line, as session windows close."""
    bursts = _timed(stream, late).groupBy(F.session_window("ts", quiet).alias("w"), "doc_id", "line_no")
    return bursts.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n")).select("doc_id", "line_no", "w.start", "event_id", "n")


def edit_commits(stream: DataFrame, quiet: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """What an editor commits of each line: doc_id, line_no, event_id, text. An edit is committed once no
    other came for ``quiet``, or at once with ``flush``; an edit that is the original text is not.

    ``stream`` has doc_id, line_no, event_id, text, original, flush, ts. One pending edit is held per line.
    """
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)
    columns = ["event_id", "text", "original", "at"]

    def commit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, done = (tuple(state.get) if state.exists else None), []
        if state.hasTimedOut:
            done.append(pending)
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            rows["at"] = rows["ts"].astype("datetime64[ms]").astype("int64")
            for flush, *edit in rows[["flush", *columns]].itertuples(index=False):
                if pending is not None and edit[3] - pending[3] >= wait:
                    done.append(pending)
                pending = tuple(edit)
                if flush:
                    done.append(pending)
                    pending = None
            if pending is not None:
                state.update(pending)
                state.setTimeoutTimestamp(max(pending[3] + wait, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        kept = [(key[0], key[1], e[0], e[1]) for e in done if e[1] != e[2]]
        yield pd.DataFrame(kept, columns=["doc_id", "line_no", "event_id", "text"])

    return _timed(stream, late).groupBy("doc_id", "line_no").applyInPandasWithState(
        commit, "doc_id long, line_no long, event_id long, text string", "event_id long, text string, original string, at long", "append", GroupStateTimeout.EventTimeTimeout
    )


def confusion_updates(stream: DataFrame, rate: float = 0.05, floor: float = 0.15, start: float = 1.20, late: str = "1 day") -> DataFrame:
    """Costs per unordered pair as mined steps arrive: a, b, previous_cost, cost, update_count."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cost, n = state.get if state.exists else (start, 0)
        before = cost
        for frame in frames:
            for times in frame["n"]:
                n += int(times)
                for _ in range(int(times)):
                    lower = max(floor, round(cost * (1 - rate), 4))
                    if lower == cost:
                        break
                    cost = lower
        state.update((cost, n))
        yield pd.DataFrame({"a": [key[0]], "b": [key[1]], "previous_cost": [before], "cost": [cost], "update_count": [n]})

    return stream.groupBy("a", "b").applyInPandasWithState(
        update, "a string, b string, previous_cost double, cost double, update_count long", "cost double, n long", "update", GroupStateTimeout.NoTimeout
    )


#: Lines expected of a document that did not announce how many it has.
EXPECTED = 13


class _Assembly(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "page int, line long", "place long, text string")
        self.counts = handle.getValueState("counts", "expected long, decoded long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        expected, decoded = self.counts.get() if self.counts.exists() else (EXPECTED, 0)
        held = {tuple(k): tuple(v) for k, v in self.lines.iterator()}
        before, whole = dict(held), None
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for kind, page, line, text, total in zip(*(events[c].tolist() for c in ("kind", "page", "line", "text", "total")), strict=True):
            if kind == "line":
                at = (int(page), int(line))
                decoded, whole = decoded + 1, None
                held[at] = (held[at][0] if at in held else decoded, text)
            else:  # a new start, or the result that replaces all lines
                expected, decoded = (int(total) or EXPECTED) if kind == "metadata" else EXPECTED, 0
                held, whole = {}, text if kind == "complete" else None
        for at in before.keys() - held.keys():
            self.lines.removeKey(at)
        for at in held:
            if before.get(at) != held[at]:
                self.lines.updateValue(at, held[at])
        if held or whole is None:
            self.counts.update((expected, decoded))
        else:
            self.counts.clear()  # nothing is held of a complete document
        pages: dict[int, list] = {}
        for (page, _), (place, text) in sorted(held.items(), key=lambda x: x[1][0]):
            pages.setdefault(page, []).append(text)
        full = whole if whole is not None else "\n\n".join("\n".join(pages[p]) for p in sorted(pages))
        progress = 100 if whole is not None else min(95, 30 + 65 * decoded // max(1, expected))
        last = int(events["event_id"].iloc[-1])
        yield pd.DataFrame({"doc_id": [key[0]], "event_id": [last], "decoded": [decoded], "progress": [progress], "complete": [whole is not None], "full_text": [full]})


def document_assembly(stream: DataFrame) -> DataFrame:
    """The document as it stands after each batch that touched it: doc_id, event_id, decoded, progress,
    complete, full_text.

    ``stream`` has doc_id, event_id, ts, kind, page, line, text, total. ``metadata`` starts a document of ``total`` lines,
    ``line`` puts a line in, at the place where it first came, and ``complete`` replaces all lines by its
    text; state is a map of the lines of documents that are not complete. Events apply in order of arrival,
    those of a batch by time. Pages stand in order, lines without metadata count against ``EXPECTED``.
    """
    kinds = "doc_id long, event_id long, decoded long, progress long, complete boolean, full_text string"
    return stream.groupBy("doc_id").transformWithStateInPandas(_Assembly(), kinds, "Update", "None")


class _Jobs(StatefulProcessor):
    def __init__(self, terminal: tuple[str, ...], retention: int, forget: int):
        self.terminal, self.retention, self.forget = terminal, retention, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, status string, progress long, at long")

    def _ends(self, last) -> int:
        return last[3] + (self.retention if last[1] in self.terminal else self.forget)

    def _timer(self, last) -> int:
        return -(-self._ends(last) // 1000)  # in ms

    def _expired(self, key, last) -> list[tuple]:
        return [(key[0], last[0], "expired", last[2], self._ends(last))] if last[1] in self.terminal else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, out = (tuple(self.last.get()) if self.last.exists() else None), []
        if last is not None:
            self.handle.deleteTimer(self._timer(last))
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        events["at"] = events["ts"].astype("datetime64[us]").astype("int64")
        for now in events[["event_id", "status", "progress", "at"]].itertuples(index=False, name=None):
            if last is not None and now[3] >= self._ends(last):
                out += self._expired(key, last)
                last = None
            if last is None or (last[1], last[2]) != (now[1], now[2]):
                out.append((key[0], *now))
            last = now
        self.last.update(last)
        self.handle.registerTimer(self._timer(last))
        yield _changes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get())
        self.last.clear()
        yield _changes(self._expired(key, last))


def _changes(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["job_id", "event_id", "status", "progress", "at"])
    return out.assign(at=pd.to_datetime(out["at"].astype("int64"), unit="us"))


def job_changes(
    stream: DataFrame, terminal: tuple[str, ...] = ("COMPLETED", "FAILED"), retention: str = "1 hour", forget: str = "30 days", late: str = "1 hour"
) -> DataFrame:
    """Events that change a job's status or progress, and ``expired`` once a terminal job has had no event for
    ``retention`` after its last one: job_id, event_id, status, progress, at.

    An expired job is gone, so what comes later is a new one. One event-time timer a job, set anew by each event,
    ends its state; jobs that never end are forgotten without a row after ``forget``.
    """
    spans = [pd.Timedelta(x) // pd.Timedelta("1us") for x in (retention, forget)]
    kinds = "job_id long, event_id long, status string, progress long, at timestamp"
    return _timed(stream, late).groupBy("job_id").transformWithStateInPandas(_Jobs(terminal, *spans), kinds, "Append", "EventTime")


def windowed_metrics(stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding sums, means and rates a second of a step stream, a row for each window once the
    watermark has passed its end; its state goes then, and later rows of it are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    sums = _timed(stream, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    seconds = pd.Timedelta(size).total_seconds()
    return sums.select(
        F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"),
        F.round(F.col("total") / F.col("n"), 4).alias("mean"), F.round(F.col("n") / seconds, 6).alias("rate"),
    )


class LateRows:
    """A side output for ``windowed_metrics``: the rows that came when all their windows were closed.

    Call it from ``foreachBatch`` over the same source. Each batch writes its late rows and its latest time
    under its own number and overwrites them if it is run again; the watermark of a batch is that of all before it.
    """

    def __init__(self, folder: str, size: str = "1 hour", late: str = "10 minutes"):
        self.folder, self.size, self.late = folder, size, late

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        marks = f"{self.folder}/marks"
        seen = None
        if number:
            before = spark.read.schema("high timestamp, batch long").parquet(marks).filter(F.col("batch") < number)
            seen = before.agg(F.max("high") - F.expr(f"interval {self.late}")).first()[0]
        closed = F.window("ts", self.size)["end"] <= F.lit(seen) if seen is not None else F.lit(False)
        rows.filter(closed).write.mode("overwrite").parquet(f"{self.folder}/late/batch={number}")
        rows.agg(F.max("ts").alias("high")).write.mode("overwrite").parquet(f"{marks}/batch={number}")

    def read(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/late")


def side_output(stream: DataFrame, folder: str, write) -> None:
    """Runs ``write(batch, number)`` over what the source has now."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has now and returns what it wrote.

    Append results go to files with a checkpoint in ``folder``. Update and complete results have no
    file sink, so each batch is written by ``foreachBatch`` under its own number, which a batch that is run again
    overwrites; the last version of complete results stays. Called again, it goes on from its checkpoint.
    """
    out, spark = f"{folder}/{name}", stream.sparkSession
    spark.conf.set(*_STORE)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        place = (lambda k: "") if mode == "complete" else (lambda k: f"/batch={k}")
        query = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}{place(k)}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
