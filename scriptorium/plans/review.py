"""Document review queries: geometry, queues, status, corrections, exports, page text."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import documents as D
from scriptorium.operators import metrics as M
from scriptorium.operators import pages as P
from scriptorium.sources.files import scratch

from .catalog import query
from .views import Views

_BOX = """u AS (SELECT page, box_no, least(greatest(ymin, 0), 1) AS a, least(greatest(ymax, 0), 1) AS b, least(greatest(xmin, 0), 1) AS c, least(greatest(xmax, 0), 1) AS d FROM boxes),
  o AS (SELECT page, box_no, least(a, b) AS y0, greatest(a, b) AS y1, least(c, d) AS x0, greatest(c, d) AS x1 FROM u)"""


@query("prj6_bbox_geometry", f"""
WITH {_BOX} SELECT page, box_no, y0, x0, y1, x1, x1 - x0 < 0.05 OR y1 - y0 < 0.03 OR y1 <= 0.075 AS sliver, greatest(1, floor((x1 - x0) * 1000 + 0.5))::BIGINT AS pixel_width,
  greatest(1, floor((y1 - y0) * 1400 + 0.5))::BIGINT AS pixel_height, CASE WHEN x1 > x0 AND y1 > y0 THEN greatest(0, floor((x0 - (x1 - x0) * 0.04::DOUBLE) * 1000))::BIGINT || ',' || greatest(0, floor((y0 - (y1 - y0) * 0.04::DOUBLE) * 1400))::BIGINT
  || ',' || least(1000, ceil((x1 + (x1 - x0) * 0.04::DOUBLE) * 1000))::BIGINT || ',' || least(1400, ceil((y1 + (y1 - y0) * 0.04::DOUBLE) * 1400))::BIGINT END AS crop FROM o""", "boxes")
def prj6(spark, d):
    return D.box_geometry(Views(spark, d).boxes)


@query("prj7_word_layout", """
WITH l AS (SELECT doc_id, line_no // 20 AS page_no, line_no, (doc_id % 10) / 100.0::DOUBLE AS xmin, 1 - (line_no % 10) / 100.0::DOUBLE AS xmax, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM lines),
  e AS (SELECT doc_id, page_no, line_no, xmin, (xmax - xmin) / len(w) AS span, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS text FROM l)
SELECT doc_id, 'p' || page_no || '_l' || line_no || '_w' || k AS word_id, text, floor((xmin + k * span) * 10000 + 0.500001) / 10000 AS x0, floor((xmin + k * span + 0.95::DOUBLE * span) * 10000 + 0.500001) / 10000 AS x1, regexp_matches(text, '^[A-Z][a-zA-Z''-]+[.]?$') AS is_proper_noun FROM e""", "lines")
def prj7(spark, d):
    lines = Views(spark, d).lines.selectExpr("doc_id", "line_no div 20 as page_no", "line_no", "text", "(doc_id % 10) / 100.0D as xmin", "1 - (line_no % 10) / 100.0D as xmax")
    return D.word_layout(lines)


@query("prj8_confidence_tier", """
SELECT doc_id, count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium, count(*) FILTER (confidence IS NULL OR confidence < 0.7) AS low FROM words GROUP BY doc_id""", "words")
def prj8(spark, d):
    return D.confidence_tiers(Views(spark, d).words)


@query("flt5_review_queue", """
SELECT doc_id, page_no, line_no, word_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, line_no, word_no) AS rank FROM words
WHERE confidence IS NULL OR confidence < 0.7 OR (regexp_matches(text, '^[A-Z][a-zA-Z''-]+[.]?$') AND confidence < 0.9)""", "words")
def flt5(spark, d):
    return D.review_queue(Views(spark, d).words).select("doc_id", "page_no", "line_no", "word_no", "rank")


_MARKED = "concat(text, case line_no % 7 when 0 then ' Signed by' when 1 then ' witness J.' when 2 then ' Dr. Rx' else '' end)"


@query("flt6_signature_candidates", r"""
SELECT doc_id, line_no, kind, confidence FROM (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN 0.0 ELSE 0.5 END AS confidence, CASE WHEN regexp_matches(t, '(?i)\b(witness|notary|authorized\s+sign)') THEN 'witness_mark'
  WHEN regexp_matches(t, '(?i)\b(signature|signed|sign-off|signoff|undersigned)\b') THEN 'sign_off_line' END AS kind
  FROM (SELECT *, text || CASE line_no % 7 WHEN 0 THEN ' Signed by' WHEN 1 THEN ' witness J.' WHEN 2 THEN ' Dr. Rx' ELSE '' END AS t FROM lines)) WHERE kind IS NOT NULL""", "lines")
def flt6(spark, d):
    lines = Views(spark, d).lines.selectExpr("doc_id", "line_no", f"{_MARKED} as text", "case when line_no % 3 = 0 then null else 0.5D end as confidence")
    return D.signature_candidates(lines).select("doc_id", "line_no", "kind", "confidence")


@query("join10_review_status", """
WITH c AS (SELECT user_id AS page, event_id AS line FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT DISTINCT user_id AS page, event_id AS line, CASE WHEN value > 20 THEN 'accepted' ELSE 'rejected' END AS decision FROM events WHERE value > 10)
SELECT page, coalesce(decision, 'pending') AS decision, count(*) AS n FROM c LEFT JOIN r USING (page, line) GROUP BY ALL""")
def join10(spark, d):
    e = Views(spark, d).table("events")
    candidates = e.filter("event_type in ('click', 'view')").selectExpr("user_id as page", "event_id as line")
    reviews = e.filter("value > 10").selectExpr("user_id as page", "event_id as line", "case when value > 20 then 'accepted' else 'rejected' end as decision").distinct()
    return D.review_status(candidates, reviews).groupBy("page", "decision").agg(F.count("*").alias("n"))


@query("join12_box_iou_match", f"""
WITH {_BOX}, b AS (SELECT page, page * 10 + box_no AS id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM o GROUP BY page, box_no), e AS (SELECT * FROM b WHERE id % 2 = 0), p AS (SELECT * FROM b WHERE id % 2 = 1),
  m AS (SELECT e.page, e.id AS expected_id, p.id AS predicted_id, (least(e.x1, p.x1) - greatest(e.x0, p.x0)) * (least(e.y1, p.y1) - greatest(e.y0, p.y0)) AS i, (e.x1 - e.x0) * (e.y1 - e.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS s
    FROM e JOIN p ON e.page = p.page AND e.x0 < p.x1 AND p.x0 < e.x1 AND e.y0 < p.y1 AND p.y0 < e.y1)
SELECT page, expected_id, predicted_id, round(iou, 6) AS iou FROM (SELECT *, i / (s - i) AS iou, row_number() OVER (PARTITION BY expected_id ORDER BY i / (s - i) DESC, predicted_id) AS r FROM m WHERE i / (s - i) >= 0.5) WHERE r = 1""", "boxes")
def join12(spark, d):
    boxes = _boxes(spark, d)
    return D.match_boxes(boxes.filter("id % 2 = 0"), boxes.filter("id % 2 = 1")).withColumn("iou", F.round("iou", 6))


@query("join12_match_quality", f"""
WITH {_BOX}, b AS (SELECT page, page * 10 + box_no AS id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM o GROUP BY page, box_no), e AS (SELECT * FROM b WHERE id % 2 = 0), p AS (SELECT * FROM b WHERE id % 2 = 1),
  m AS (SELECT e.page, e.id AS expected_id, p.id AS predicted_id, (least(e.x1, p.x1) - greatest(e.x0, p.x0)) * (least(e.y1, p.y1) - greatest(e.y0, p.y0)) AS i, (e.x1 - e.x0) * (e.y1 - e.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS s
    FROM e JOIN p ON e.page = p.page AND e.x0 < p.x1 AND p.x0 < e.x1 AND e.y0 < p.y1 AND p.y0 < e.y1),
  g AS (SELECT page, expected_id, arg_max(predicted_id, (i / (s - i), -predicted_id)) AS predicted_id FROM m WHERE i / (s - i) >= 0.5 GROUP BY ALL),
  c AS (SELECT page, count(*) FILTER (id % 2 = 0) AS expected, count(*) FILTER (id % 2 = 1) AS predicted FROM b GROUP BY page), h AS (SELECT page, count(*) AS m, count(DISTINCT predicted_id) AS used FROM g GROUP BY page)
SELECT page, expected, predicted, coalesce(m, 0) AS matched, CASE WHEN predicted > 0 THEN round(coalesce(used, 0) / predicted, 6) ELSE 0.0 END AS precision, CASE WHEN expected > 0 THEN round(coalesce(m, 0) / expected, 6) ELSE 0.0 END AS recall FROM c LEFT JOIN h USING (page)""", "boxes")
def join12_quality(spark, d):
    boxes = _boxes(spark, d)
    return D.match_quality(boxes.filter("id % 2 = 0"), boxes.filter("id % 2 = 1"))


def _boxes(spark, d):
    return D.box_geometry(Views(spark, d).boxes).groupBy("page", (F.col("page") * 10 + F.col("box_no")).alias("id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("join14_feedback_outbox", """
WITH s AS (SELECT DISTINCT submission_id, document_id FROM feedback), a AS (SELECT submission_id FROM feedback WHERE confidence < 0.2), g AS (SELECT user_id AS document_id FROM events WHERE value > 300)
SELECT document_id, count(*) FILTER (submission_id NOT IN (SELECT submission_id FROM a)) AS pending, count(*) FILTER (document_id IN (SELECT document_id FROM g)) AS cascaded FROM s GROUP BY document_id""", "feedback")
def join14(spark, d):
    v = Views(spark, d)
    submitted = v.feedback.select("submission_id", "document_id").distinct()
    pending, gone = D.outbox(submitted, v.feedback.filter("confidence < 0.2").select("submission_id").distinct(), v.table("events").filter("value > 300").select(F.col("user_id").alias("document_id")))
    both = submitted.select("document_id", F.lit(0).alias("p"), F.lit(0).alias("c")).union(pending.select("document_id", F.lit(1), F.lit(0))).union(gone.select("document_id", F.lit(0), F.lit(1)))
    return both.groupBy("document_id").agg(F.sum("p").alias("pending"), F.sum("c").alias("cascaded"))


@query("join15_apply_corrections", """
WITH c AS (SELECT user_id AS doc_id, event_id % 20 AS line_no, CAST(json_extract(props, '$.k') AS BIGINT) % 12 AS word_no, upper(event_type) AS correction, ts, event_id FROM events),
  k AS (SELECT doc_id, line_no, word_no, max_by(correction, (ts, event_id)) AS correction FROM c GROUP BY doc_id, line_no, word_no),
  m AS (SELECT doc_id, line_no, word_no, coalesce(correction, text) AS new, correction IS NOT NULL AS reviewed, coalesce(correction, text) <> text AS edited FROM words LEFT JOIN k USING (doc_id, line_no, word_no))
SELECT doc_id, line_no, string_agg(new, ' ' ORDER BY word_no) AS text, count(*) FILTER (edited) AS edited_words, bool_or(reviewed) AS reviewed FROM m GROUP BY doc_id, line_no""", "words")
def join15(spark, d):
    v = Views(spark, d)
    corrections = v.table("events").selectExpr("user_id as doc_id", "event_id % 20 as line_no", "cast(get_json_object(props, '$.k') as bigint) % 12 as word_no", "upper(event_type) as correction", "ts", "event_id")
    return D.apply_corrections(v.words, corrections)


@query("agg15_document_kpis", """
WITH p AS (SELECT doc_id, page_no, count(DISTINCT line_no) AS lines, count(*) AS words, count(*) FILTER (coalesce(confidence, 0) < 0.7) AS low, CASE WHEN count(*) = count(confidence) THEN floor(avg(confidence) * 1000 + 0.500001) / 1000 END AS mean FROM words GROUP BY doc_id, page_no)
SELECT doc_id, count(*) AS pages, sum(lines)::BIGINT AS lines, sum(words)::BIGINT AS words, sum(low)::BIGINT AS low_words, CASE WHEN count(*) = count(mean) THEN floor(avg(mean) * 1000 + 0.500001) / 1000 END AS mean_confidence FROM p GROUP BY doc_id""", "words")
def agg15(spark, d):
    return D.document_kpis(Views(spark, d).words)


@query("snk2_token_csv_export", """
WITH w AS (SELECT doc_id::VARCHAR AS doc_id, page_no::VARCHAR AS page, (line_no + 1)::VARCHAR AS line_number, 'L' || line_no AS line_id, '-' || word_no AS w, confidence, text, word_no % 7 = 0 AS e, line_no, word_no FROM words)
SELECT doc_id, page, line_number, line_id, '''' || w AS word_id, CASE WHEN confidence IS NOT NULL THEN printf('%.4f', confidence) END AS confidence,
  CASE WHEN regexp_matches(text, '^[=+@-]') THEN '''' ELSE '' END || text || CASE WHEN e THEN '!' ELSE '' END AS text,
  CASE WHEN regexp_matches(text, '^[=+@-]') THEN '''' ELSE '' END || text AS original_text, CASE WHEN e THEN 'TRUE' ELSE 'FALSE' END AS is_edited,
  printf('%.5f', (line_no % 20) / 20.0::DOUBLE) AS ymin, printf('%.5f', (word_no % 10) / 10.0::DOUBLE) AS xmin, printf('%.5f', (line_no % 20 + 1) / 20.0::DOUBLE) AS ymax, printf('%.5f', (word_no % 10 + 1) / 10.0::DOUBLE) AS xmax FROM w""", "words")
def snk2(spark, d):
    words = Views(spark, d).words.selectExpr(
        "doc_id", "page_no as page", "line_no + 1 as line_number", "concat('L', line_no) as line_id", "concat('-', word_no) as word_id", "confidence",
        "case when word_no % 7 = 0 then concat(text, '!') else text end as text", "text as original_text", "word_no % 7 = 0 as is_edited",
        "(line_no % 20) / 20.0D as ymin", "(word_no % 10) / 10.0D as xmin", "(line_no % 20 + 1) / 20.0D as ymax", "(word_no % 10 + 1) / 10.0D as xmax",
    )
    path = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    # the cells of a word take many times its own bytes, most of them again and again
    D.token_export(words).write.options(**options, compression="gzip", **{"zlib.compress.level": "BEST_SPEED"}).csv(path)
    return spark.read.schema(D.TOKEN_EXPORT).options(**options).csv(path)


@query("snk3_document_export", r"""
WITH p AS (SELECT doc_id, line_no // 20 AS page_no, string_agg(text, chr(10) ORDER BY line_no) AS text, count(*) AS n FROM lines GROUP BY doc_id, line_no // 20)
SELECT doc_id, string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page_no) AS text, sum(n)::BIGINT AS lines FROM p GROUP BY doc_id""", "lines")
def snk3(spark, d):
    lines = Views(spark, d).lines.withColumn("page_no", F.expr("line_no div 20"))
    pages = D.ordered_text(lines, ["doc_id", "page_no"], "line_no", "text", "\n")
    n = lines.groupBy("doc_id").agg(F.count("*").alias("lines"))
    return D.ordered_text(pages, ["doc_id"], "page_no", "text", "\n\n--- PAGE BREAK ---\n\n").join(n, "doc_id")


@query("snk4_worst_tsv", """
SELECT doc_id || '/' || line_no AS image_path, ref AS reference, hyp AS hypothesis, round(edits / ref_chars, 6) AS cer FROM scored ORDER BY cer DESC, doc_id, line_no LIMIT 100""", "scored")
def snk4(spark, d):
    path = f"{scratch(spark)}/worst-{uuid.uuid4().hex}"
    worst = M.worst_rows(Views(spark, d).ref_hyp, 100).select(F.concat_ws("/", "doc_id", "line_no").alias("image_path"), F.col("ref").alias("reference"), F.col("hyp").alias("hypothesis"), "cer")
    options = {"sep": "\t", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    worst.write.options(**options).csv(path)
    return spark.read.schema("image_path string, reference string, hypothesis string, cer double").options(**options).csv(path)


@query("flt7_loop_collapse")
def flt7(spark, d):
    # a repeated line read as one text loops; the tests hold it against a plain scan
    lines = Views(spark, d).lines.select("doc_id", "line_no", F.when(F.col("line_no") % 4 == 0, F.repeat(F.concat("text", F.lit(" ")), F.lit(6))).otherwise(F.col("text")).alias("text"))
    return D.collapse_loops(lines.withColumn("text", F.trim("text")))


_NOISE = "case line_no % 9 when 0 then 'Jump to search' when 1 then concat('Sorry, ', text) when 2 then '#tag one' else text end"


@query("flt3_page_noise_filter", """
SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, lower(CASE line_no % 9 WHEN 0 THEN 'Jump to search' WHEN 1 THEN 'Sorry, ' || text WHEN 2 THEN '#tag one' ELSE text END) AS t FROM lines)
WHERE NOT (t = 'jump to search' OR starts_with(t, 'sorry') OR t = '#tag one' OR regexp_replace(t, '[.,!?;:]+$', '') IN ('', 'edit')) GROUP BY doc_id""", "lines")
def flt3(spark, d):
    lines = Views(spark, d).lines.selectExpr("doc_id", f"{_NOISE} as text")
    return P.noise_filter(lines).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("prj4_line_text_repair")
def prj4(spark, d):
    lines = Views(spark, d).lines.selectExpr("doc_id", "line_no", "concat(text, case line_no % 5 when 0 then ' .' when 1 then ' MARIANB.' when 2 then ', Which' when 3 then '...' else ' x' end) as text")
    fixed = P.repair(lines)
    # counted without exploding: a filter on the rules' outcome would be pushed through every rule
    counts = fixed.agg(*[F.count_if(F.array_contains("fixes", r[0])).alias(r[0]) for r in P.REPAIRS])
    return counts.unpivot([], [r[0] for r in P.REPAIRS], "rule", "n")


def _page_lines(spark, d):
    return Views(spark, d).lines.selectExpr("doc_id * 1000 + line_no div 40 as page", "line_no as line", "text")


@query("win6_page_finalize_core", """
SELECT page, count(*) AS kept FROM (SELECT page, row_number() OVER (PARTITION BY page, lower(text) ORDER BY line) AS r FROM (SELECT doc_id * 1000 + line_no // 40 AS page, line_no AS line, text FROM lines)
  WHERE regexp_replace(lower(text), '[.,!?;:]+$', '') NOT IN ('', 'edit') AND NOT (starts_with(text, '#') AND len(regexp_split_to_array(text, ' +')) <= 4)) WHERE r = 1 GROUP BY page""", "lines")
def win6_core(spark, d):
    return P.finalize_core(_page_lines(spark, d)).groupBy("page").agg(F.count("*").alias("kept"))


@query("win6_page_finalize")
def win6(spark, d):
    return P.finalize(_page_lines(spark, d))


@query("win7_line_continuation")
def win7(spark, d):
    return P.continue_lines(_page_lines(spark, d))


@query("join11_escalate", r"""
WITH t AS (SELECT doc_id, line_no, text, regexp_extract_all(text, '[\pL][\pL'']*') AS t FROM lines), u AS (SELECT doc_id, line_no, unnest(t) AS w FROM t),
  o AS (SELECT DISTINCT doc_id, line_no FROM u WHERE NOT regexp_matches(w, '^\p{Lu}(\p{Ll}+)?$') AND lower(w) NOT IN (SELECT key FROM lexicon))
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN len(t) = 0 THEN 'blank' WHEN lower(t[1]) IN ('the', 'la') THEN 'first_word' WHEN regexp_matches(text, '["“”]') THEN 'quotes'
  WHEN len(t) <= 3 AND len(list_filter(t, lambda w: regexp_matches(w, '^\p{Lu}(\p{Ll}+)?$'))) > 0 THEN 'name' WHEN o.doc_id IS NOT NULL THEN 'unknown_word' ELSE 'none' END AS reason
  FROM t LEFT JOIN o USING (doc_id, line_no)) GROUP BY reason""", "lines lexicon")
def join11_escalate(spark, d):
    v = Views(spark, d)
    found = P.escalate(v.lines, ["doc_id", "line_no"], v.lexicon, ("the", "la"))
    return found.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("join11_reader_fusion")
def join11(spark, d):
    rows = Views(spark, d).ref_hyp
    fused = P.fuse_readers(rows.select("doc_id", "line_no", F.col("hyp").alias("text")), rows.select("doc_id", "line_no", F.col("ref").alias("text")), ["doc_id", "line_no"], Views(spark, d).lexicon)
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)  # a row per rule
    return fused.groupBy("rule").agg(F.count("*").alias("n")).withColumn("share", share)
