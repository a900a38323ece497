"""Exact duplicates by distributed most-significant-digit radix partitioning.

Groups start as the whole table and are split by successive characters of the normalised text, a
digit of growing width a round, until a group is a single row or its texts have ended. Digits are
compared as they are, so equality needs no digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, settle, table

FIRST_DIGIT = 32
DIGIT_GROWTH = 8


def _split(active: DataFrame, start: int, width: int, name: str) -> DataFrame:
    """One radix round over ``active(id, gid, text, sha)``: each row learns its group's size and
    largest id; ``goes_on`` marks rows of groups of two or more whose texts have not ended.

    Group sizes are counted with map-side partial sums, and rows learn them by a join that AQE may
    split, so a group holding a third of all rows is never in one task.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = active.withColumns(
        {"digit": ascii_lower(F.substring(text, start, width)), "ended": F.length(text) < start + width}
    )
    groups = (
        keyed.groupBy("gid", "digit", "ended")
        .agg(F.count("*").alias("n"), F.max("id").alias("top"))
        .filter("n > 1")
        .withColumn("next_gid", F.monotonically_increasing_id())
    )
    # always a merge join: the shared groups grow with the input
    groups = materialize(groups, f"{name}-groups").hint("merge")
    joined = keyed.join(groups, ["gid", "digit", "ended"], "left")
    goes_on = F.col("n").isNotNull() & ~F.col("ended")
    sha = F.sha2(ascii_lower(F.col("text")).cast("binary"), 256) if start == 1 else F.col("sha")
    return materialize(
        joined.select(
            "id",
            sha.alias("sha"),
            F.col("next_gid").alias("gid"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top")).alias("keep_id"),
            F.when(goes_on, F.col("text")).alias("text"),
            goes_on.alias("goes_on"),
        ),
        name,
    )


def _radix(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("gid"), F.col(text_col).cast("string").alias("text"), F.lit("").alias("sha")
    )
    out, start, width, k = None, 1, FIRST_DIGIT, 0
    while True:
        state = _split(rows, start, width, f"radix{k}")
        done = state.filter(~F.col("goes_on")).drop("goes_on").withColumn("round", F.lit(k))
        out = done if out is None else out.union(done)
        rows = state.filter("goes_on").select("id", "gid", "text", "sha")
        if rows.isEmpty():
            break
        start, width, k = start + width, width * DIGIT_GROWTH, k + 1
    # only rows whose id equals the group's largest come here: one a group but for repeated ids
    last = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("group_size") > 1)
    one = F.row_number().over(Window.partitionBy("round", "gid").orderBy("id")) == 1
    return out.filter(last).withColumn("kept", one).union(
        out.filter(~last).withColumn("kept", F.col("group_size") == 1)
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. A null text counts as empty, and
    all empty texts are one group. The row with the largest id stays; a null id is below all
    others; of rows that repeat both text and id exactly one stays. An empty table gives no rows,
    and other columns of ``docs`` are not read.
    """
    return _radix(docs, id_col, text_col).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay by the rule of ``exact_duplicates``, with all their columns.

    Only ids and digests of the rows that go are kept meanwhile, and one anti-join drops them. Of
    rows that repeat both id and text any one stays, with its own other columns.
    """

    def gone() -> DataFrame:
        rows = _radix(docs, id_col, text_col).groupBy("id", "sha").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
        return rows.filter("not kept or n > 1").select("id", "sha", "kept")

    found = settle(gone, "exact-dropped")
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    sha = F.sha2(ascii_lower(F.col(at[text_col]).cast("string")).cast("binary"), 256)
    rows = docs.toDF(*names).withColumns({"id": F.col(at[id_col]).cast("long"), "sha": sha})
    same = lambda part: rows["id"].eqNullSafe(part["id"]) & (rows["sha"] == part["sha"])
    every, again = found.hint("merge"), found.filter("kept").hint("merge")
    lone = rows.join(every, same(every), "left_anti").select(*names)
    # one of each repeated row, by partial aggregates
    one = rows.join(again, same(again), "left_semi").groupBy("id", "sha").agg(F.first(F.struct(*names)).alias("r")).select("r.*")
    return lone.union(one).toDF(*docs.columns)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
