"""Readers of the file shapes in which transcriptions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .manifests import first_of, read_manifest

__all__ = ["asset_inventory", "read_feedback", "read_forms", "read_labels", "read_line_index", "read_manifest", "read_metric_log", "read_private_labels", "with_forms"]


def read_line_index(spark: SparkSession, path: str) -> DataFrame:
    """Space-delimited line indexes: comments, blanks and rows of fewer than eight fields are skipped, bars
    are spaces, numbers that are none are 0, and a row without words has an empty text."""
    f = F.split("value", " ")
    number = lambda k: F.coalesce(F.get(f, F.lit(k)).try_cast("int"), F.lit(0))
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != "") & (F.size(f) >= 8))
    line = F.get(f, F.lit(0))
    return rows.select(
        line.alias("line_id"), F.get(f, F.lit(1)).alias("status"), number(2).alias("threshold"), number(3).alias("components"),
        *[number(k).alias(n) for k, n in ((4, "x"), (5, "y"), (6, "w"), (7, "h"))],
        F.replace(F.array_join(F.slice(f, F.lit(9), F.greatest(F.size(f) - 8, F.lit(0))), " "), F.lit("|"), F.lit(" ")).alias("text"),
        F.substring_index(line, "-", 2).alias("form_id"), F.get(F.split(line, "-"), F.lit(1)).alias("writer"),
    )


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """form_id, form_writer of a space-delimited list of forms; comments, blanks and short rows are skipped."""
    f = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).filter(~F.startswith(F.trim("value"), F.lit("#")) & (F.size(f) >= 2))
    # of a form that is listed twice the last writer would hold; rows of a split file have no order, so the largest does
    return rows.select(F.get(f, F.lit(0)).alias("form_id"), F.get(f, F.lit(1)).alias("writer")).groupBy("form_id").agg(F.max("writer").alias("form_writer"))


def with_forms(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """Lines with the writer of their form where the forms know it."""
    return lines.join(forms, "form_id", "left").withColumn("writer", F.coalesce("form_writer", "writer")).drop("form_writer")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``filename<TAB>text`` labels, split on the first tab only; rows without a tab are not labels."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).filter(F.contains("value", F.lit("\t")))
    name = F.get(parts, F.lit(0))
    return rows.select(name.alias("filename"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.get(parts, F.lit(1)).alias("text"))


PRIVATE = ["filename", "text", "source_id", "writer_hash", "crop_box", "human_corrected"]


def read_private_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, rows put aside) of tab-separated labels with six fields; rows with fewer are put aside."""
    f = F.split("value", "\t")
    raw = spark.read.text(path).filter(F.trim("value") != "")
    rows = raw.filter(F.size(f) >= len(PRIVATE)).select(*[F.get(f, F.lit(k)).alias(c) for k, c in enumerate(PRIVATE)])
    yes = F.lower(F.trim("human_corrected")).isin("1", "true", "yes")
    return rows.withColumn("human_corrected", yes), raw.filter(F.size(f) < len(PRIVATE))


def read_feedback(spark: SparkSession, path: str, max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(corrections, malformed lines). Aliases are resolved and evaluation-only rows left out; at most
    ``max_samples`` corrections, those of the smallest ids, are kept where that is given."""
    names = {
        "feedback_id": ("feedback_id", "sample_id", "id"),
        "crop": ("line_crop", "crop_path", "image_path", "relative_image_path", "image_crop_path", "image"),
        "text": ("operator_correction", "text", "transcription", "ground_truth", "label", "correction"),
    }
    fields = ", ".join(f"{c} string" for of in names.values() for c in of)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    record = F.from_json("value", f"{fields}, is_demo boolean, evaluation_only boolean, bad string", options)
    raw = spark.read.text(path).filter(F.trim("value") != "").select(record.alias("r")).select("r.*")
    good = raw.filter("bad is null and not coalesce(is_demo, false) and not coalesce(evaluation_only, false)")
    picked = good.select(*[first_of(*of).alias(c) for c, of in names.items()]).filter("text is not null")
    picked = picked if max_samples is None else picked.orderBy("feedback_id", "crop", "text").limit(max_samples)
    return picked, raw.filter("bad is not null").select("bad")


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Training logs with any of the known headers: the epoch under either name or by row, stage
    ``stage1`` by default, and numbers that are none as 0."""
    raw = spark.read.option("header", True).csv(path)
    for c in ("global_epoch", "epoch", "stage", "run", "train_loss", "val_loss", "val_cer"):
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("string"))
    row = F.row_number().over(Window.partitionBy("run").orderBy(F.monotonically_increasing_id()))
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    return raw.select("run", F.coalesce(F.col("global_epoch").try_cast("long"), F.col("epoch").try_cast("long"), row.cast("long")).alias("epoch"), F.coalesce("stage", F.lit("stage1")).alias("stage"), number("train_loss"), number("val_loss"), number("val_cer"))


#: (format, leading bytes in hex)
MAGIC = (("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("bmp", "424D"), ("webp", "52494646"))


def asset_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per binary file: format by magic bytes, PNG size, digest, and whether it is below 32 x 16."""
    raw = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 24))
    kind = F.lit("unknown")
    for name, magic in reversed(MAGIC):
        kind = F.when(head.startswith(magic), name).otherwise(kind)
    size = lambda at: F.when(F.col("format") == "png", F.conv(F.substring(F.col("head"), 2 * at + 1, 8), 16, 10).cast("long"))
    rows = raw.select("path", F.col("length").alias("bytes"), head.alias("head"), kind.alias("format"), F.sha2("content", 256).alias("sha256"))
    sized = rows.withColumns({"width": size(16), "height": size(20)}).drop("head")
    return sized.withColumn("too_small", F.coalesce((F.col("width") < 32) | (F.col("height") < 16), F.lit(False)))
