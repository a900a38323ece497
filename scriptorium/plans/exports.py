"""Queries of exports, line edits and the rescoring callback."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import confusion as C
from scriptorium.operators import exports as X

from .catalog import query
from .views import Views

_LINES = """x AS (SELECT doc_id, 'doc ' || doc_id AS name, line_no // 20 AS page_number, line_no + 1 AS line_number, text, CASE WHEN line_no % 3 = 0 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM lines),
  p AS (SELECT doc_id, name, page_number, string_agg(text, chr(10) ORDER BY line_number) AS full_text, sum(confidence) / count(*) AS c FROM x GROUP BY ALL)"""


def _lines(spark, d):
    return Views(spark, d).lines.selectExpr(
        "doc_id", "concat('doc ', doc_id) as name", "line_no div 20 as page_number", "line_no + 1 as line_number", "text", "'' as original_text", "false as is_edited",
        "case when line_no % 3 = 0 then 0.5D else 0.75D end as confidence",
    )


@query("snk3_json_export", f"""
WITH {_LINES} SELECT doc_id, count(*) AS pages, round(avg(c), 4) AS mean_confidence, string_agg(full_text, '|' ORDER BY page_number) AS texts FROM p GROUP BY doc_id""", "lines")
def snk3_json(spark, d):
    """The JSON objects, read back."""
    got = F.from_json("json", "total_pages long, mean_confidence double, pages array<struct<page_number:long,full_text:string>>")
    back = X.as_json(_lines(spark, d)).select("doc_id", got.alias("j"))
    return back.select("doc_id", F.col("j.total_pages").alias("pages"), F.col("j.mean_confidence").alias("mean_confidence"), F.array_join("j.pages.full_text", "|").alias("texts"))


@query("snk3_markdown_export", f"""
WITH {_LINES}, m AS (SELECT doc_id, name, count(*) AS n, avg(c) AS mean, list({{'p': page_number, 't': full_text}} ORDER BY page_number) AS pages FROM p GROUP BY ALL)
SELECT doc_id, rtrim('# ' || name || chr(10) || '*Mean Confidence: ' || printf('%.1f', mean * 100 + 1e-9) || '%*' || chr(10) || '*Total Pages: ' || n || '*' || chr(10) || chr(10)
  || array_to_string(list_transform(pages, lambda y: CASE WHEN n > 1 THEN '## Page ' || y.p || chr(10) ELSE '' END || y.t || chr(10)), chr(10)), chr(10)) AS markdown FROM m""", "lines")
def snk3_markdown(spark, d):
    return X.as_markdown(_lines(spark, d))


@query("snk3_batch_export", f"""
WITH {_LINES}, t AS (SELECT doc_id, name, string_agg(full_text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page_number) AS text FROM p GROUP BY ALL)
SELECT batch, doc_id, place, '=== DOCUMENT ' || place || ': ' || name || ' ===' || chr(10) || chr(10) || text AS section FROM (SELECT *, doc_id // 50 AS batch, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS place FROM t)""", "lines")
def snk3_batch(spark, d):
    return X.batch_sections(X.as_text(_lines(spark, d)).withColumn("batch", F.expr("doc_id div 50")))


@query("join15_line_edits", r"""
WITH e AS (SELECT user_id AS doc_id, event_id % 20 AS line_no, CASE event_id % 5 WHEN 0 THEN 'line' WHEN 1 THEN 'revert' ELSE 'word' END AS kind, event_id % 9 AS word_no, 'new ' || event_type || ' ' || event_id AS text, (ts, event_id) AS moment FROM events),
  w AS (SELECT doc_id, line_no, max_by(kind, moment) AS kind, max_by(text, moment) AS new, max(moment) AS since FROM e WHERE kind <> 'word' GROUP BY ALL),
  c AS (SELECT doc_id, line_no, word_no, max_by(e.text, moment) AS text FROM e LEFT JOIN w USING (doc_id, line_no) WHERE e.kind = 'word' AND (since IS NULL OR moment > since) GROUP BY ALL),
  o AS (SELECT doc_id, line_no, list(text ORDER BY word_no) AS original FROM words GROUP BY ALL),
  b AS (SELECT o.*, kind, new, CASE WHEN kind = 'line' THEN string_split(new, ' ') ELSE original END AS base FROM o LEFT JOIN w USING (doc_id, line_no)),
  t AS (SELECT doc_id, line_no, kind, new, original, unnest(base) AS x, generate_subscripts(base, 1) - 1 AS word_no FROM b)
SELECT doc_id, line_no, string_agg(coalesce(c.text, x), ' ' ORDER BY word_no) AS text, bool_or(c.text IS NOT NULL OR coalesce(kind = 'line' AND new <> array_to_string(original, ' '), false)) AS is_edited,
  bool_or(c.text IS NOT NULL OR coalesce(kind = 'line', false)) AS reviewed FROM t LEFT JOIN c USING (doc_id, line_no, word_no) GROUP BY doc_id, line_no""", "words")
def join15_lines(spark, d):
    v = Views(spark, d)
    edits = v.table("events").selectExpr(
        "user_id as doc_id", "event_id % 20 as line_no", "case event_id % 5 when 0 then 'line' when 1 then 'revert' else 'word' end as kind", "event_id % 9 as word_no",
        "concat('new ', event_type, ' ', event_id) as text", "ts", "event_id",
    )
    return X.edited_lines(v.words, edits)


def _longest(texts: list[str], scores: list[float]) -> tuple[str, float]:
    """A callback for the query: the longest candidate, the first of them on ties; no candidate may be empty."""
    best = max(range(len(texts)), key=lambda k: (len(texts[k]), -k))
    if not texts[best]:
        raise ValueError("empty")
    return texts[best], scores[best]


@query("udf5_rescoring_callback", """
WITH b AS (SELECT doc_id, line_no, k, CASE k WHEN 0 THEN hyp WHEN 1 THEN ref ELSE replace(ref, 'm', 'rn') END AS text FROM ref_hyp, (SELECT unnest(range(3)) AS k))
SELECT doc_id, line_no, max_by(text, (length(text), -k)) AS text FROM b GROUP BY doc_id, line_no""", "ref_hyp")
def udf5(spark, d):
    beams = F.array("hyp", "ref", F.replace("ref", F.lit("m"), F.lit("rn")))
    rows = Views(spark, d).ref_hyp.select("doc_id", "line_no", F.posexplode(beams).alias("beam_no", "text")).withColumn("log_prob", -0.1 * F.col("beam_no"))
    return C.rescore_with(rows, _longest).select("doc_id", "line_no", "text")
