"""Operator corrections: validation with reasons, totals, and batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reasons(columns: list[str]) -> Column:
    """All codes that speak against a correction; none if it is good. Page, line id and box, which is [ymin, xmin, ymax, xmax]
    within 0 and 1 and may be null, are looked at where ``columns`` has them."""
    box = F.col("bbox")
    span = lambda a, b: F.get(box, F.lit(a)) < F.get(box, F.lit(b))
    inside = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    long = lambda c: F.coalesce(F.length(c), F.lit(0)) > 500
    conf = F.col("confidence")
    rules = {
        "blank_document_id": blank("document_id"), "blank_original": F.col("original").isNull(), "blank_correction": F.col("correction").isNull(),
        "original_too_long": long("original"), "correction_too_long": long("correction"),
        "confidence_out_of_range": conf.isNotNull() & (F.isnan(conf) | (conf < 0) | (conf > 1)),
        "bad_submission_id": F.col("submission_id").isNotNull() & ~F.col("submission_id").rlike("^[a-zA-Z0-9_-]{1,100}$"), "demo": F.coalesce(F.col("is_demo"), F.lit(False)),
    }
    placed = {
        "page_number": ("bad_page", F.col("page_number").isNull() | (F.col("page_number") < 1)), "line_id": ("blank_line_id", blank("line_id")),
        "bbox": ("bad_bbox", box.isNotNull() & ~F.coalesce((F.size(box) == 4) & inside & span(0, 2) & span(1, 3), F.lit(False))),
    }
    rules |= dict(v for c, v in placed.items() if c in columns)
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]), lambda r: r.isNotNull())


def validate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their ``reasons``)."""
    checked = rows.withColumn("reasons", reasons(rows.columns))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def fingerprint() -> Column:
    """A digest of a correction without its time; null and empty fields differ."""
    cells = [F.col(c).cast("string").alias(c) for c in ("confidence", "correction", "document_id", "line_no", "original")]
    return F.sha2(F.to_json(F.struct(*cells)), 256)


def first_submissions(rows: DataFrame) -> DataFrame:
    """Batch form of the idempotent stream: each submission's first row, how often it was replayed, and
    how often its id came with other content. Each row without an id is a submission of its own."""
    own = F.concat(F.lit("event:"), F.col("event_id").cast("string"))
    rows = rows.withColumn("submission_id", F.coalesce("submission_id", own))
    first = F.min_by(F.struct("document_id", "line_no", "correction", "fp"), F.struct("ts", "event_id"))
    marked = rows.withColumn("fp", fingerprint())
    top = marked.groupBy("submission_id").agg(first.alias("f"), F.count("*").alias("n"))
    same = marked.join(top.select("submission_id", F.col("f.fp").alias("first_fp")), "submission_id").groupBy("submission_id").agg(F.count_if(F.col("fp") == F.col("first_fp")).alias("same"))
    return top.join(same, "submission_id").select("submission_id", "f.document_id", "f.line_no", (F.col("same") - 1).alias("replays"), (F.col("n") - F.col("same")).alias("conflicts"))


def debounce(edits: DataFrame, quiet: str = "500 milliseconds") -> DataFrame:
    """Batch form of the debounced editor: the last value of each burst of edits."""
    late = F.lead("ts").over(Window.partitionBy("doc_id", "line_no").orderBy("ts", "event_id"))
    gap = F.expr(f"ts + interval {quiet}")
    return edits.withColumn("late", late).filter(F.col("late").isNull() | (F.col("late") >= gap)).drop("late")


def status_changes(events: DataFrame) -> DataFrame:
    """Batch form of the job stream: events that change a job's status or progress."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    same = F.lag("status").over(w).eqNullSafe(F.col("status")) & F.lag("progress").over(w).eqNullSafe(F.col("progress"))
    return events.withColumn("same", same).filter(~F.col("same")).drop("same")
