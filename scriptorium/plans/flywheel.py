"""Confusion, beam and feedback queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import confusion as C
from scriptorium.operators import feedback as B

from .catalog import query
from .views import Views
from .views_sql import distance


def _corrections(spark, d):
    return Views(spark, d).ref_hyp.filter("lower(ref) <> lower(hyp)").selectExpr("hyp as prediction", "ref as correction")


@query("agg13_confusion_mining")
def agg13(spark, d):
    return C.mine(_corrections(spark, d), longest=None)


#: Lines in which one shape was written for another: ``rn`` for ``m`` once, ``mcg`` for ``mg``, and ``rn`` for ``m`` with a space lost.
_PLANTED = """CASE (doc_id * 31 + line_no) % 3 WHEN 0 THEN 'x rn ' || text WHEN 1 THEN text || ' 5 mcg' ELSE 'in torn papers ' || text END"""
_MISREAD = """CASE (doc_id * 31 + line_no) % 3 WHEN 0 THEN 'x m ' || text WHEN 1 THEN text || ' 5 mg' ELSE 'in tompapers ' || text END"""
_PLANTED_SQL = """
SELECT op, a, b, count(*) AS n FROM (SELECT unnest(CASE (doc_id * 31 + line_no) % 3 WHEN 0 THEN [{'op': 'substitute', 'a': 'm', 'b': 'rn'}]
  WHEN 1 THEN [{'op': 'substitute', 'a': 'mcg', 'b': 'mg'}] ELSE [{'op': 'substitute', 'a': 'm', 'b': 'rn'}, {'op': 'delete', 'a': '', 'b': ' '}] END, recursive := true)
  FROM lines WHERE length(text) < 900) GROUP BY op, a, b"""
_ALL_PLANTED_SQL = _PLANTED_SQL.replace(" WHERE length(text) < 900", "")


def _all_planted(spark, d):
    return Views(spark, d).lines.selectExpr("doc_id", "line_no", "text", f"{_PLANTED} AS prediction", f"{_MISREAD} AS correction")


def _planted(spark, d):
    return _all_planted(spark, d).filter("length(text) < 900").drop("text")


@query("agg13_planted_shapes", _PLANTED_SQL, "lines")
def agg13_planted(spark, d):
    return C.mine(_planted(spark, d))


@query("udf2_lateral_align", _ALL_PLANTED_SQL, "lines")
def udf2(spark, d):
    C.register_align(spark)
    return spark.sql(
        """SELECT op, least(source, target) AS a, greatest(source, target) AS b, count(*) AS n
        FROM (SELECT collect_list(prediction) AS p, collect_list(correction) AS c FROM {rows} GROUP BY doc_id div 400), LATERAL align(p, c) GROUP BY ALL""",
        rows=_all_planted(spark, d),
    )


@query("udf2_align_table", _PLANTED_SQL, "lines")
def udf2_table(spark, d):
    C.register_align(spark)
    return spark.sql(
        "SELECT op, least(source, target) AS a, greatest(source, target) AS b, count(*) AS n FROM align_pairs(TABLE (SELECT doc_id AS id, prediction AS a, correction AS b FROM {rows})) GROUP BY ALL",
        rows=_planted(spark, d),
    )


def _costs(spark):
    return spark.createDataFrame([(a, b, c) for (a, b), c in C.COSTS.items()], "a string, b string, cost double")


@query("agg14_confusion_recalibrate")
def agg14(spark, d):
    return C.recalibrate(C.mine(_corrections(spark, d), longest=None), _costs(spark))


def _beams(spark, d):
    rows = Views(spark, d).ref_hyp
    beams = F.array(F.col("hyp"), F.col("ref"), F.lower("ref"), F.replace(F.col("ref"), F.lit("a"), F.lit("o")))
    return rows.select("doc_id", "line_no", F.posexplode(beams).alias("beam_no", "text")).withColumn("log_prob", -0.45 - 0.1 * F.col("beam_no"))


@query("win5_beam_rescore")
def win5(spark, d):
    return C.rescore(_beams(spark, d), Views(spark, d).lexicon.select("key", "weight"))


#: Component scores that both engines can compute, in place of those of a lexicon.
_GIVEN = ["(length(text) * 13 % 8) / 2.0D as lex", "((doc_id + beam_no) % 5 - 2) / 2.0D as context", "(line_no * beam_no % 4) / 8.0D as confusion"]


@query("win5_stage_ablation", f"""
WITH b AS (SELECT doc_id, line_no, ref, beam_no, [hyp, ref, lower(ref), replace(ref, 'a', 'o')][beam_no + 1] AS text, hyp AS top, -0.45::DOUBLE - 0.1::DOUBLE * beam_no AS log_prob FROM ref_hyp, range(4) r(beam_no)
    WHERE line_no % 7 > 0 OR beam_no = 0),
  c AS (SELECT *, {", ".join(_GIVEN).replace("2.0D", "2.0::DOUBLE").replace("8.0D", "8.0::DOUBLE")} FROM b),
  w(stage, wl, wx, wc) AS (VALUES ('baseline', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('lexicon', 1.0, 0.0, 0.0), ('lexicon_confusion', 1.0, 0.0, 0.5), ('full', 1.0, 0.8, 0.5)),
  s AS (SELECT *, log_prob + wl * lex + wx * context AS base, log_prob + wl * lex + wx * context - wc * confusion AS score FROM c, w),
  r AS (SELECT *, row_number() OVER (l ORDER BY score DESC, beam_no) AS rank, count(*) OVER l AS beams, score - max(score) FILTER (text = top) OVER l AS delta,
    sum(exp(greatest(score - m, -20))) OVER l AS total FROM (SELECT *, max(score) OVER (PARTITION BY stage, doc_id, line_no) AS m FROM s) WINDOW l AS (PARTITION BY stage, doc_id, line_no)),
  f AS (SELECT *, text <> top OR delta > 0.01::DOUBLE AS applied, {distance("ref", "text")} AS e,
    round(CASE WHEN beams = 1 THEN 1 / (1 + exp(-greatest(-10, least(10, base)))) ELSE greatest(0.01::DOUBLE, least(0.99::DOUBLE, 1 / total)) END, 4) AS confidence FROM r WHERE rank = 1)
SELECT stage, count(*) AS n, count(*) FILTER (applied) AS applied, count(*) FILTER (text <> top) AS changed, count(*) FILTER (e = 0) AS exact, sum(e)::BIGINT AS edits, round(sum(e) / sum(length(ref)), 4) AS cer,
  round(avg(confidence), 3) AS confidence, round(avg(round(delta, 4)), 3) AS delta FROM f GROUP BY stage""", "ref_hyp")
def win5_stages(spark, d):
    given = _beams(spark, d).filter("line_no % 7 > 0 or beam_no = 0").selectExpr("*", *_GIVEN)
    top = F.first("text").over(Window.partitionBy("doc_id", "line_no").orderBy(F.desc("log_prob"), "beam_no"))
    return C.ablation_report(C.rank_stages(given.withColumn("top", top), C.ABLATION), Views(spark, d).ref_hyp.select("doc_id", "line_no", "ref"))


@query("win5_ablation")
def win5_ablation(spark, d):
    parts = C.beam_components(_beams(spark, d), Views(spark, d).lexicon.select("key", "weight"))
    return C.ablation_report(C.rank_stages(parts, C.ABLATION), Views(spark, d).ref_hyp.select("doc_id", "line_no", "ref"))


@query("win13_rank_flip")
def win13(spark, d):
    cheaper = {k: max(C.FLOOR, v * 0.5) for k, v in C.COSTS.items()}
    parts = C.beam_components(_beams(spark, d), Views(spark, d).lexicon.select("key", "weight"), other_costs={"cheaper": cheaper})
    weights = (1.0, 0.8, 0.5)
    return C.flips(C.rank_stages(parts, {"before": weights, "after": weights}, {"after": "cheaper"}), "before", "after")


@query("agg20_beam_language_pick")
def agg20(spark, d):
    return C.language_pick(_beams(spark, d), Views(spark, d).lexicon)


_REASONS = """list_filter([CASE WHEN original IS NULL THEN 'blank_original' END, CASE WHEN correction IS NULL THEN 'blank_correction' END, CASE WHEN coalesce(length(original), 0) > 500 THEN 'original_too_long' END,
  CASE WHEN coalesce(length(correction), 0) > 500 THEN 'correction_too_long' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END, CASE WHEN is_demo THEN 'demo' END], lambda r: r IS NOT NULL)"""


@query("flt1_feedback_validate", f"""
WITH c AS (SELECT event_id, {_REASONS} AS r FROM feedback), e AS (SELECT unnest(CASE WHEN len(r) = 0 THEN ['accepted'] ELSE r END) AS reason FROM c) SELECT reason, count(*) AS n FROM e GROUP BY reason""", "feedback")
def flt1(spark, d):
    good, bad = B.validate(Views(spark, d).feedback)
    return good.select(F.lit("accepted").alias("reason")).union(bad.select(F.explode("reasons"))).groupBy("reason").agg(F.count("*").alias("n"))


_PLACED = ["event_id % 40 as page_number", "case when event_id % 37 = 0 then '  ' when event_id % 41 > 0 then concat('l', line_no) end as line_id",
           "case when event_id % 11 = 0 then null when event_id % 59 = 0 then array(0.1D, 0.2D, 0.5D) when event_id % 53 = 0 then array(0.1D, double('NaN'), 0.5D, 0.6D) else array(0.1D, (event_id % 10) / 10.0D, 0.5D, (event_id % 7) / 4.0D) end as bbox"]


@query("flt1_placed_feedback", f"""
WITH f AS (SELECT *, event_id % 40 AS page_number, CASE WHEN event_id % 37 = 0 OR event_id % 41 = 0 OR line_no IS NULL THEN '' ELSE 'l' END AS line_id, (event_id % 10) / 10.0::DOUBLE AS xmin, (event_id % 7) / 4.0::DOUBLE AS xmax FROM feedback),
  c AS (SELECT event_id, list_concat({_REASONS}, list_filter([CASE WHEN page_number < 1 THEN 'bad_page' END, CASE WHEN line_id = '' THEN 'blank_line_id' END,
    CASE WHEN event_id % 11 > 0 AND (event_id % 59 = 0 OR event_id % 53 = 0 OR xmax > 1 OR xmin >= xmax) THEN 'bad_bbox' END], lambda r: r IS NOT NULL)) AS r FROM f)
SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(r) = 0 THEN ['accepted'] ELSE r END) AS reason FROM c) GROUP BY reason""", "feedback")
def flt1_placed(spark, d):
    good, bad = B.validate(Views(spark, d).feedback.selectExpr("*", *_PLACED))
    return good.select(F.lit("accepted").alias("reason")).union(bad.select(F.explode("reasons"))).groupBy("reason").agg(F.count("*").alias("n"))


@query("agg12_feedback_stats", """
SELECT count(*) FILTER (trim(coalesce(correction, '')) <> '') AS records, count(DISTINCT submission_id) AS submissions, count(*) FILTER (NOT is_demo AND correction IS NOT NULL) AS crops, max(ts) AS last_ts FROM feedback""", "feedback")
def agg12(spark, d):
    return Views(spark, d).feedback.agg(
        F.count_if(F.trim(F.coalesce("correction", F.lit(""))) != "").alias("records"), F.count_distinct("submission_id").alias("submissions"),
        F.count_if(~F.col("is_demo") & F.col("correction").isNotNull()).alias("crops"), F.max("ts").alias("last_ts"),
    )


_FP = "md5(coalesce(document_id::VARCHAR, '') || '|' || coalesce(line_no::VARCHAR, '') || '|' || coalesce(original, '') || '|' || coalesce(correction, '') || '|' || coalesce(confidence::VARCHAR, ''))"


@query("str1_feedback_first", f"""
WITH m AS (SELECT *, {_FP} AS fp FROM feedback), t AS (SELECT submission_id, min_by({{'d': document_id, 'l': line_no, 'fp': fp}}, (ts, event_id)) AS f, count(*) AS n FROM m GROUP BY submission_id),
  s AS (SELECT submission_id, count(*) FILTER (fp = f.fp) AS same FROM m JOIN t USING (submission_id) GROUP BY submission_id)
SELECT submission_id, f.d AS document_id, f.l AS line_no, same - 1 AS replays, n - same AS conflicts FROM t JOIN s USING (submission_id)""", "feedback")
def str1_first(spark, d):
    return B.first_submissions(Views(spark, d).feedback)


@query("str2_debounce_batch", """
SELECT doc_id, line_no, event_id, ts FROM (SELECT user_id AS doc_id, k % 4 AS line_no, event_id, ts, lead(ts) OVER (PARTITION BY user_id, k % 4 ORDER BY ts, event_id) AS late FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))
WHERE late IS NULL OR late >= ts + INTERVAL 1 HOUR""")
def str2_batch(spark, d):
    e = Views(spark, d).table("events").selectExpr("user_id as doc_id", "cast(get_json_object(props, '$.k') as bigint) % 4 as line_no", "event_id", "ts")
    return B.debounce(e, "1 hour")


@query("str5_job_status_batch", """
SELECT job_id, event_id, status, progress FROM (SELECT *, lag(status) OVER w IS NOT DISTINCT FROM status AND lag(progress) OVER w IS NOT DISTINCT FROM progress AS same
  FROM (SELECT user_id AS job_id, event_id, ts, event_type AS status, floor(value / 50)::BIGINT AS progress FROM events) WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) WHERE NOT same""")
def str5_batch(spark, d):
    e = Views(spark, d).table("events").selectExpr("user_id as job_id", "event_id", "ts", "event_type as status", "floor(value / 50) as progress")
    return B.status_changes(e).select("job_id", "event_id", "status", "progress")
