"""Documents as text: JSON, markdown, numbered sections of a batch; and edits of lines with their reverts.

Groups are the lines of a page, the pages of a document, and the edits of a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"


def _pages(lines: DataFrame) -> DataFrame:
    """doc_id, name, pages: each document's pages in order, each with its lines in order."""
    line = F.struct("line_number", "text", F.coalesce(F.nullif("original_text", F.lit("")), "text").alias("original_text"), "is_edited", "confidence")
    pages = lines.groupBy("doc_id", "name", "page_number").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    page = F.struct("page_number", text.alias("full_text"), "lines")
    return pages.groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.avg(F.expr("aggregate(lines, 0D, (a, x) -> a + coalesce(x.confidence, 0D), a -> a / size(lines))")).alias("mean"))


def as_json(lines: DataFrame) -> DataFrame:
    """doc_id and the document as one JSON object with its pages and lines."""
    body = F.struct(F.col("doc_id").alias("document_id"), F.col("name").alias("filename"), F.size("pages").alias("total_pages"), F.round("mean", 4).alias("mean_confidence"), "pages")
    return _pages(lines).select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def as_text(lines: DataFrame) -> DataFrame:
    """doc_id, name and the document's pages as plain text."""
    return _pages(lines).select("doc_id", "name", F.array_join(F.transform("pages", lambda p: p["full_text"]), PAGE_BREAK).alias("text"))


def as_markdown(lines: DataFrame) -> DataFrame:
    """doc_id and the document as markdown: title, mean confidence, pages; empty lines are left out, and a
    single page has no heading."""
    full = lambda p: F.array_join(F.filter(F.transform(p["lines"], lambda x: x["text"]), lambda t: t != ""), "\n")
    head = lambda p: F.when(F.size("pages") > 1, F.concat(F.lit("## Page "), p["page_number"].cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    parts = F.transform("pages", lambda p: F.concat(head(p), full(p), F.lit("\n")))
    top = F.concat(F.lit("# "), F.coalesce(F.nullif("name", F.lit("")), F.lit("Document")), F.lit("\n*Mean Confidence: "), F.format_string("%.1f", F.col("mean") * 100 + 1e-9), F.lit("%*\n*Total Pages: "), F.size("pages").cast("string"), F.lit("*\n"))
    return _pages(lines).select("doc_id", F.rtrim(F.concat_ws("\n", top, F.array_join(parts, "\n")), F.lit("\n")).alias("markdown"))


def batch_sections(documents: DataFrame, batch: str = "batch") -> DataFrame:
    """A row for each document of a batch, numbered in the order of ids, with its heading and text: to be
    written in that order, so that no batch is one string."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy("doc_id"))
    heading = F.concat(F.lit("=== DOCUMENT "), place.cast("string"), F.lit(": "), F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("doc_"), place.cast("string"))), F.lit(" ==="))
    return documents.select(batch, "doc_id", place.cast("long").alias("place"), F.concat(heading, F.lit("\n\n"), "text").alias("section"))


def edited_lines(words: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines after their edits: doc_id, line_no, text, is_edited, reviewed.

    ``edits`` has doc_id, line_no, kind, word_no, text, ts, event_id. A ``line`` edit replaces all words, a
    ``revert`` brings the original back, and a ``word`` edit holds until either of them; of several
    the latest counts. A word edit beyond the line's end changes nothing. A line is edited by any word
    edit, and by a line edit if its text differs from the original.
    """
    key, when = ["doc_id", "line_no"], F.struct("ts", "event_id")
    whole = edits.filter("kind in ('line', 'revert')").groupBy(*key).agg(F.max_by(F.struct("kind", "text", when.alias("at")), when).alias("w"))
    later = edits.filter("kind = 'word'").join(whole.select(*key, F.col("w.at").alias("since")), key, "left").filter(F.col("since").isNull() | (when > F.col("since")))
    last = later.groupBy(*key, "word_no").agg(F.max_by("text", when).alias("new"))
    changes = last.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word_no").cast("int"), "new"))).alias("changes"))
    lines = words.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]).alias("original"))
    joined = lines.join(whole, key, "left").join(changes, key, "left")
    base = F.when(F.col("w.kind") == "line", F.filter(F.split("w.text", r"\s+"), lambda x: x != "")).otherwise(F.col("original"))
    known = F.filter(F.map_keys("changes"), lambda k: k < F.size("base"))
    done = joined.withColumn("base", base).withColumn("now", F.transform("base", lambda x, i: F.coalesce(F.try_element_at("changes", i), x)))
    by_word = F.coalesce(F.size(known) > 0, F.lit(False))
    by_line = F.coalesce((F.col("w.kind") == "line") & (F.col("w.text") != F.array_join("original", " ")), F.lit(False))
    return done.select(*key, F.array_join("now", " ").alias("text"), (by_word | by_line).alias("is_edited"), (by_word | F.coalesce(F.col("w.kind") == "line", F.lit(False))).alias("reviewed"))
