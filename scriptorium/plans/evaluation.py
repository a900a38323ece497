"""Evaluation queries: normalisation, error rates, reports, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import metrics as M

from .catalog import query
from .views import Views
from .views_sql import distance


@query("prj1_transcription_clean", r"""
SELECT source, count(*) AS n_rows, count(*) FILTER (label = '') AS dropped, round(count(*) FILTER (label = '') / count(*), 4) AS drop_rate, sum(length(label))::BIGINT AS chars FROM (
  SELECT source, CASE WHEN t IN ('', '.', '-', '--', '---', 'nan', 'None', 'null') THEN '' ELSE t END AS label FROM (
    SELECT source, trim(regexp_replace(replace(text, '|', ' '), '\s+', ' ', 'g')) AS t FROM lines)) GROUP BY source""", "lines")
def prj1(spark, d):
    rows = Views(spark, d).lines.select("source", T.clean_label(F.col("text")).alias("label"))
    dropped = F.count_if(F.col("label") == "")
    return rows.groupBy("source").agg(
        F.count("*").alias("n_rows"), dropped.alias("dropped"), F.round(dropped / F.count("*"), 4).alias("drop_rate"), F.sum(F.length("label")).alias("chars")
    )


@query("prj1_raw_labels", """
WITH k AS (SELECT doc_id, line_no, md5(text) AS m FROM lines)
SELECT doc_id, line_no, unnest([{'kind': 'bytes', 'label': CASE WHEN line_no % 5 = 0 THEN 'a' || chr(65533) || m ELSE 'a ' || m END},
  {'kind': 'nested', 'label': '{"a": [' || line_no || ', 2], "m": "x,:' || m || '", "z": ' || CASE WHEN line_no % 3 = 0 THEN 'null' ELSE '"b"' END || '}'},
  {'kind': 'map', 'label': '{"k x": ' || line_no || ', "l": 7}'}, {'kind': 'flag', 'label': CASE WHEN line_no % 2 = 0 THEN 'True' ELSE 'False' END}], recursive := true) FROM k""", "lines")
def prj1_raw(spark, d):
    rows = Views(spark, d).lines.selectExpr(
        "doc_id", "line_no", "concat(cast('a' as binary), case when line_no % 5 = 0 then X'FF' else cast(' | ' as binary) end, cast(md5(text) as binary)) as bytes",
        "named_struct('z', case when line_no % 3 > 0 then 'b' end, 'm', concat('x,:', md5(text)), 'a', array(line_no, 2)) as nested", "map('l', 7, 'k|x', line_no) as map", "line_no % 2 = 0 as flag",
    )
    labels = [F.struct(F.lit(c).alias("kind"), T.clean_label(T.raw_label(F.col(c), rows.schema[c].dataType)).alias("label")) for c in ("bytes", "nested", "map", "flag")]
    return rows.select("doc_id", "line_no", F.inline(F.array(*labels)))


@query("prj2_text_normalize", r"""
SELECT doc_id, line_no, trim(regexp_replace(translate(lower(regexp_replace(lower(text), '\bthe\b', 'a', 'g')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+', ' ', 'g')) AS normal FROM lines""", "lines")
def prj2(spark, d):
    rows = Views(spark, d).lines
    return rows.select("doc_id", "line_no", T.normalize(F.col("text"), replacements={r"\bthe\b": "a"}, punctuation=True).alias("normal"))


@query("agg1_cer_wer", r"""
WITH w AS (SELECT *, list_filter(string_split(ref, ' '), lambda x: x <> '') AS a, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS b FROM scored)
SELECT lang, count(*) AS n, sum(edits)::BIGINT AS char_edits, sum(ref_chars)::BIGINT AS ref_chars, sum(we)::BIGINT AS word_edits, sum(len(a))::BIGINT AS ref_words,
  round(sum(edits) / sum(ref_chars), 4) AS cer, round(sum(we) / sum(len(a)), 4) AS wer
FROM (SELECT *, len(list_filter(list_zip(a, b), lambda p: p[1] IS DISTINCT FROM p[2])) AS we FROM w) GROUP BY lang""", "scored")
def agg1(spark, d):
    # these lines are corrupted word for word, so the oracle counts the places at which words differ; the
    # tests hold the word distance against a plain implementation on any texts
    return M.error_rates(Views(spark, d).ref_hyp, ["lang"])


@query("agg1_word_errors")
def agg1_words(spark, d):
    return M.error_rates(Views(spark, d).ref_hyp, ["lang", "source"])


@query("agg2_edit_breakdown")
def agg2(spark, d):
    return M.edit_breakdown(Views(spark, d).ref_hyp, ["lang"])


@query("agg3_metric_bundle", """
WITH w AS (SELECT *, list_filter(string_split(ref, ' '), lambda x: x <> '') AS a, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS b FROM scored)
SELECT count(*) AS n, round(sum(edits) / sum(ref_chars), 4) AS cer, round(sum(len(list_filter(list_zip(a, b), lambda p: p[1] IS DISTINCT FROM p[2]))) / sum(len(a)), 4) AS wer,
  round(sum(edits_uncased) / sum(ref_chars), 4) AS cer_uncased, round(avg(edits / ref_chars), 4) AS mean_row_cer, round(avg((ref = hyp)::INT), 4) AS exact_rate,
  round(avg(abs(length(ref) - length(hyp)) / length(ref)), 4) AS length_gap FROM w""", "scored")
def agg3(spark, d):
    return M.metric_bundle(Views(spark, d).ref_hyp)


def _flagged(spark, d):
    v = Views(spark, d)
    return v.ref_hyp.join(v.samples.selectExpr("sample_id as doc_id", "category", "is_lasa"), "doc_id")


#: Words that differ by place, and words, of lines corrupted word for word.
_PLACES = """len(list_filter(list_zip(list_filter(string_split(ref, ' '), lambda x: x <> ''), list_filter(string_split(hyp, ' '), lambda x: x <> '')), lambda p: p[1] IS DISTINCT FROM p[2]))"""
_WORDS = "len(list_filter(string_split(ref, ' '), lambda x: x <> ''))"


@query("agg4_stratified_metrics", f"""
SELECT category, is_lasa, count(*) AS n, sum(edits)::BIGINT AS edits, round(sum(edits) / sum(ref_chars), 4) AS cer,
  sum({_PLACES})::BIGINT AS word_edits, round(sum({_PLACES}) / sum({_WORDS}), 4) AS wer, count(*) FILTER (edits = 0) AS exact
FROM scored JOIN (SELECT sample_id AS doc_id, category, is_lasa FROM samples) USING (doc_id) GROUP BY GROUPING SETS ((category), (is_lasa), ())""", "scored samples")
def agg4(spark, d):
    return M.stratified(_flagged(spark, d), "category", "is_lasa")


@query("agg5_name_accuracy", r"""
SELECT is_lasa, count(*) AS n, round(avg((first_ref = first_hyp OR pr = ph)::INT), 4) AS name_accuracy FROM (
  SELECT is_lasa, pr, ph, regexp_split_to_array(pr, ' +')[1] AS first_ref, regexp_split_to_array(ph, ' +')[1] AS first_hyp FROM (
    SELECT is_lasa, trim(regexp_replace(lower(ref), '[^\pL\pN ]', '', 'g')) AS pr, trim(regexp_replace(lower(hyp), '[^\pL\pN ]', '', 'g')) AS ph
    FROM ref_hyp JOIN (SELECT sample_id AS doc_id, is_lasa FROM samples) USING (doc_id))) WHERE pr <> '' GROUP BY is_lasa""", "ref_hyp samples")
def agg5(spark, d):
    return M.name_accuracy(_flagged(spark, d), ["is_lasa"])


@query("agg6_win_tie_loss", f"""
SELECT stage_no, count(*) FILTER (gap < -1e-5) AS wins, count(*) FILTER (abs(gap) <= 1e-5) AS ties, count(*) FILTER (gap > 1e-5) AS losses FROM (
  SELECT stage_no, cer - max(CASE WHEN stage_no = 1 THEN cer END) OVER (PARTITION BY doc_id, line_no) AS gap
  FROM (SELECT *, {distance("ref", "hyp")} / length(ref) AS cer FROM stage_hyp)) GROUP BY stage_no""", "stage_hyp")
def agg6(spark, d):
    return M.win_tie_loss(Views(spark, d).stage_hyp)


@query("agg7_tier_compare", rf"""
SELECT stage_no, round(rate, 4) AS cer, round(f - rate, 4) AS gain, CASE WHEN f > 0 THEN round((f - rate) / f * 100, 2) ELSE 0.0 END AS relative_gain, wer, name_accuracy, p50_ms, exact FROM (
  SELECT *, first_value(rate) OVER (ORDER BY stage_no) AS f FROM (
    SELECT stage_no, sum(e) / sum(length(ref)) AS rate, round(sum({_PLACES}) / sum({_WORDS}), 4) AS wer, round(quantile_cont(ms, 0.5), 2) AS p50_ms, count(*) FILTER (e = 0) AS exact,
      round(avg(CASE WHEN pr <> '' THEN (regexp_split_to_array(pr, ' +')[1] = regexp_split_to_array(ph, ' +')[1] OR pr = ph)::INT END), 4) AS name_accuracy
    FROM (SELECT *, {distance("ref", "hyp")} AS e, (length(ref) * (4 + stage_no) + doc_id % 7) / 4.0::DOUBLE AS ms,
      trim(regexp_replace(lower(ref), '[^\pL\pN ]', '', 'g')) AS pr, trim(regexp_replace(lower(hyp), '[^\pL\pN ]', '', 'g')) AS ph FROM stage_hyp) GROUP BY stage_no))""", "stage_hyp")
def agg7(spark, d):
    return M.tier_compare(Views(spark, d).stage_hyp.withColumn("ms", F.expr("(length(ref) * (4 + stage_no) + doc_id % 7) / 4.0D")))


@query("agg1_lost_words", """
WITH l AS (SELECT lang, length(text) AS rc, string_split(text, ' ') AS w FROM lines)
SELECT lang, count(*) AS n, sum(CASE WHEN len(w) > 1 THEN length(w[2]) + 1 ELSE 7 END)::BIGINT AS char_edits, sum(rc)::BIGINT AS ref_chars, count(*) AS word_edits, sum(len(w))::BIGINT AS ref_words,
  round(sum(CASE WHEN len(w) > 1 THEN length(w[2]) + 1 ELSE 7 END) / sum(rc), 4) AS cer, round(count(*) / sum(len(w)), 4) AS wer FROM l GROUP BY lang""", "lines")
def agg1_lost(spark, d):
    # the second word is lost, or one of six letters comes before a single word: distances are known by construction
    w = F.split("text", " ")
    hyp = F.when(F.size(w) > 1, F.array_join(F.concat(F.slice(w, 1, 1), F.slice(w, F.lit(3), F.size(w))), " ")).otherwise(F.concat(F.lit("before "), "text"))
    return M.error_rates(Views(spark, d).lines.select("lang", F.col("text").alias("ref"), hyp.alias("hyp")), ["lang"])


@query("agg8_latency_throughput", """
WITH r AS (SELECT 1 + event_id % 8 AS batch_size, value AS ms, length(event_type) AS chars, 1 + user_id % 5 AS words FROM events),
  e AS (SELECT ms / batch_size AS each, unnest(range(batch_size)) FROM r),
  q AS (SELECT round(quantile_cont(each, 0.5), 2) AS p50_ms, round(quantile_cont(each, 0.9), 2) AS p90_ms, round(quantile_cont(each, 0.95), 2) AS p95_ms, round(quantile_cont(each, 0.99), 2) AS p99_ms,
    round(stddev_pop(each), 2) AS std_ms, round(min(each), 2) AS min_ms, round(max(each), 2) AS max_ms FROM e),
  t AS (SELECT sum(batch_size)::BIGINT AS samples, round(sum(ms) / sum(batch_size), 2) AS mean_ms, round(sum(batch_size) / (sum(ms) / 1000), 2) AS samples_per_s,
    round(sum(chars) / (sum(ms) / 1000), 2) AS chars_per_s, round(sum(words) / (sum(ms) / 1000), 2) AS words_per_s FROM r)
SELECT * FROM q, t""")
def agg8(spark, d):
    rows = Views(spark, d).table("events").selectExpr("1 + event_id % 8 as batch_size", "value as ms", "length(event_type) as chars", "1 + user_id % 5 as words")
    return M.latency_profile(rows)


_STEP = "(t_data + t_transfer + t_fwd + t_bwd + t_opt)"


@query("agg9_step_profile", f"""
SELECT run, count(*) FILTER (c) AS steps, round(sum(num_samples) FILTER (c) / (sum(t) FILTER (c) / 1000), 2) AS samples_per_s, round(quantile_cont(t, 0.5) FILTER (c), 2) AS p50_ms,
  round(avg(t) FILTER (c), 2) AS mean_ms, {", ".join(f"round(sum({p}) FILTER (c) / sum(t) FILTER (c) * 100, 2) AS {p}_pct" for p in M.PHASES)},
  max(mem) AS peak_mem, max_by(mem, step) AS last_mem
FROM (SELECT *, {_STEP} AS t, step > 10 OR count(*) OVER (PARTITION BY run) <= 10 AS c FROM steps) GROUP BY run""", "steps")
def agg9(spark, d):
    return M.step_profile(Views(spark, d).steps)


@query("agg10_benchmark_compare", f"""
SELECT CASE WHEN f > 0 THEN round(b / f, 4) ELSE 0.0 END AS speedup, CASE WHEN b > 0 THEN round((b - f) / b * 100, 2) ELSE 0.0 END AS latency_cut_pct,
  CASE WHEN wb > 0 THEN round((wb - wf) / wb * 100, 2) ELSE 0.0 END AS wait_cut_pct FROM (
  SELECT avg({_STEP}) FILTER (mode = 'baseline') AS b, avg({_STEP}) FILTER (mode = 'accelerated') AS f, avg(t_data) FILTER (mode = 'baseline') AS wb,
    avg(t_data) FILTER (mode = 'accelerated') AS wf FROM steps)""", "steps")
def agg10(spark, d):
    return M.compare_modes(Views(spark, d).steps)


@query("agg21_calibration_bins", """
SELECT bin, n, mean_confidence, error, round(mean_confidence + error - 1, 4) AS gap FROM (
  SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg((length(text) % 3 = 0)::INT), 6) AS error
  FROM words WHERE confidence IS NOT NULL GROUP BY 1)""", "words")
def agg21(spark, d):
    return M.calibration_bins(Views(spark, d).words.withColumn("is_error", F.length("text") % 3 == 0))


@query("agg4_stratified_words", r"""
WITH w AS (SELECT *, list_filter(string_split(ref, ' '), lambda x: x <> '') AS a, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS b FROM ref_hyp)
SELECT lang, source, sum(len(list_filter(list_zip(a, b), lambda p: p[1] IS DISTINCT FROM p[2])))::BIGINT AS word_edits, sum(len(a))::BIGINT AS ref_words FROM w GROUP BY lang, source""", "ref_hyp")
def agg4_words(spark, d):
    return M.error_rates(Views(spark, d).ref_hyp, ["lang", "source"]).select("lang", "source", "word_edits", "ref_words")


@query("win4_worst_n", """
SELECT doc_id, line_no, ref, hyp, round(edits / ref_chars, 6) AS cer FROM scored ORDER BY cer DESC, doc_id, line_no LIMIT 100""", "scored")
def win4(spark, d):
    return M.worst_rows(Views(spark, d).ref_hyp, 100)


@query("set3_token_overlap", r"""
SELECT doc_id, line_no, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0.0 END AS overlap FROM (
  SELECT doc_id, line_no, list_distinct(string_split(lower(ref), ' ')) AS a, list_distinct(string_split(lower(hyp), ' ')) AS b FROM ref_hyp)""", "ref_hyp")
def set3(spark, d):
    return M.token_overlap(Views(spark, d).ref_hyp, "ref", "hyp").select("doc_id", "line_no", F.round("overlap", 6).alias("overlap"))


@query("win9_best_epoch", """
SELECT run, epoch, b.val_cer AS best_metric, b.epoch AS best_epoch, f.epoch = epoch AS is_final_best, last <= 5 AS kept FROM (
  SELECT run, epoch, min({'val_cer': val_cer, 'train_loss': train_loss, 'epoch': epoch}) OVER (PARTITION BY run ORDER BY epoch) AS b,
    min({'val_cer': val_cer, 'train_loss': train_loss, 'epoch': epoch}) OVER (PARTITION BY run) AS f, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS last FROM epochs)""", "epochs")
def win9(spark, d):
    return M.best_epochs(Views(spark, d).epochs).withColumn("epoch", F.col("epoch").cast("long"))


@query("win14_train_progress", f"""
SELECT run, max(step) AS step, round(count(*) / s, 4) AS steps_per_s, round(sum(num_samples) / s, 4) AS samples_per_s, round((1000 - max(step)) / (count(*) / s) / 60, 4) AS eta_minutes, max_by(mem, step) AS last_mem
FROM steps JOIN (SELECT run, sum({_STEP}) / 1000 AS s FROM steps GROUP BY run) USING (run) GROUP BY run, s""", "steps")
def win14(spark, d):
    return M.train_progress(Views(spark, d).steps, 1000)
