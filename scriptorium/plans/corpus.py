"""Curation queries: conforming, splitting, filtering, summarising."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import curation as C
from scriptorium.sources.files import scratch

from .catalog import query
from .views import Views

_SPLIT = "CASE doc_id % 4 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' WHEN 2 THEN 'Train' ELSE 'other' END"


@query("prj3_conform_record", f"""
SELECT sample_id, source, category, language, split, source || '::' || CASE WHEN doc_id % 3 = 0 THEN sample_id ELSE 'w' || (doc_id % 97) END AS writer_id, text, length(text) AS n_chars, raw_split AS origin FROM (
  SELECT *, source || '_' || split || '_' || lpad(doc_id::VARCHAR, greatest(8, length(doc_id::VARCHAR))::INT, '0') AS sample_id FROM (
    SELECT doc_id, source, lang AS language, 'prose' AS category, text, {_SPLIT} AS raw_split, CASE doc_id % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents))""")
def prj3(spark, d):
    docs = Views(spark, d).table("documents")
    config = docs.select("source").distinct().select("source", F.lit("prose").alias("category"), F.concat(F.lit("https://"), F.col("source")).alias("homepage"))
    raw = docs.selectExpr("source", "doc_id as row_index", "lang as language", "text as label", f"{_SPLIT} as raw_split", "case when doc_id % 3 = 0 then '' else concat('w', doc_id % 97) end as writer")
    return C.conform(raw, config).withColumn("origin", F.col("metadata")["origin"]).drop("metadata")


@query("flt4_stage_filter", """
SELECT source, sample_id, category, is_lasa FROM (SELECT *, max((category IN ('de', 'fr') OR is_lasa)::INT) OVER (PARTITION BY source) AS m FROM samples)
WHERE category IN ('de', 'fr') OR is_lasa OR m = 0""", "samples")
def flt4(spark, d):
    return C.stage_filter(Views(spark, d).samples, ["de", "fr"], "source").select("source", "sample_id", "category", "is_lasa")


@query("flt8_source_allow_deny", """
WITH requested AS (SELECT DISTINCT source AS key FROM documents UNION SELECT DISTINCT 'feed-' || lang FROM documents),
  enabled AS (SELECT DISTINCT source AS key FROM documents), excluded AS (SELECT source AS key FROM documents GROUP BY source HAVING max(n_chars) > 25000)
SELECT key, CASE WHEN key IN (SELECT key FROM excluded) THEN 'excluded' WHEN key IN (SELECT key FROM enabled) THEN 'accepted' ELSE 'unknown' END AS status FROM requested""")
def flt8(spark, d):
    docs = Views(spark, d).table("documents")
    enabled = docs.select(F.col("source").alias("key")).distinct()
    excluded = docs.groupBy(F.col("source").alias("key")).agg(F.max("n_chars").alias("m")).filter("m > 25000").select("key")
    return C.allow_deny(enabled.union(docs.selectExpr("concat('feed-', lang)").distinct()), enabled, excluded)


@query("win1_writer_split_ratio", """
WITH w AS (SELECT DISTINCT writer_id FROM samples), r AS (SELECT writer_id, row_number() OVER (ORDER BY md5('7:' || writer_id), writer_id) AS r, count(*) OVER () AS n FROM w),
  k AS (SELECT *, greatest(1, round_even(n * 0.70, 0)) AS t0, CASE WHEN n <= 2 THEN 0 ELSE greatest(1, round_even(n * 0.15, 0)) END AS v FROM r),
  t AS (SELECT *, CASE WHEN n > 1 AND t0 + v >= n THEN t0 - 1 ELSE t0 END AS t FROM k)
SELECT sample_id, writer_id, CASE WHEN r <= t THEN 'train' WHEN r <= t + v THEN 'val' ELSE 'test' END AS split FROM samples JOIN t USING (writer_id)""", "samples")
def win1(spark, d):
    return C.split_by_ratio(Views(spark, d).samples).select("sample_id", "writer_id", "split")


_HASH = "('0x' || substr(md5('42:' || writer_id), 1, 8))::BIGINT % 100"


@query("win2_writer_split_hash", f"""
SELECT sample_id, writer_id, CASE WHEN {_HASH} < 80 THEN 'train' WHEN {_HASH} < 90 THEN 'val' ELSE 'test' END AS split FROM samples""", "samples")
def win2(spark, d):
    return C.split_by_hash(Views(spark, d).samples).select("sample_id", "writer_id", "split")


@query("win2_shipped_splits", f"""
WITH s AS (SELECT *, CASE WHEN sample_id % 9 = 0 AND source < 's2' THEN 'Valid' WHEN sample_id % 9 = 1 AND source < 's2' THEN ' test ' WHEN sample_id % 9 = 2 THEN 'train' END AS raw FROM samples),
  k AS (SELECT source, bool_or(raw IN ('Valid', ' test ')) AS shipped FROM s GROUP BY source)
SELECT sample_id, writer_id, CASE WHEN coalesce(shipped, false) THEN CASE raw WHEN 'Valid' THEN 'val' WHEN ' test ' THEN 'test' ELSE 'train' END
  WHEN {_HASH} < 80 THEN 'train' WHEN {_HASH} < 90 THEN 'val' ELSE 'test' END AS split FROM s JOIN k ON s.source IS NOT DISTINCT FROM k.source""", "samples")
def win2_shipped(spark, d):
    k = F.col("sample_id") % 9
    some = F.col("source") < "s2"
    raw = F.when((k == 0) & some, "Valid").when((k == 1) & some, " test ").when(k == 2, "train")
    return C.split_or_keep(Views(spark, d).samples.withColumn("raw_split", raw)).select("sample_id", "writer_id", "split")


@query("win8_source_cap", """
SELECT source, sample_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sample_id) AS rank FROM samples) WHERE rank <= 32""", "samples")
def win8(spark, d):
    return C.cap_per_source(Views(spark, d).samples, ["sample_id"], 32).select("source", "sample_id", F.col("rank").cast("long").alias("rank"))


_SPLIT_SAMPLES = f"s AS (SELECT *, CASE WHEN {_HASH} < 80 THEN 'train' WHEN {_HASH} < 90 THEN 'val' ELSE 'test' END AS split FROM samples)"


@query("agg11_dataset_summary", f"""
WITH {_SPLIT_SAMPLES}, g AS (
  SELECT 'split' AS kind, split AS value, count(*) AS n, count(DISTINCT writer_id) AS writers, count(*) FILTER (is_lasa) AS n_lasa FROM s GROUP BY split
  UNION ALL SELECT 'source', source, count(*), count(DISTINCT writer_id), count(*) FILTER (is_lasa) FROM s GROUP BY source
  UNION ALL SELECT 'category', category, count(*), count(DISTINCT writer_id), count(*) FILTER (is_lasa) FROM s GROUP BY category
  UNION ALL SELECT 'language', language, count(*), count(DISTINCT writer_id), count(*) FILTER (is_lasa) FROM s GROUP BY language
  UNION ALL SELECT 'all', '', count(*), count(DISTINCT writer_id), count(*) FILTER (is_lasa) FROM s)
SELECT *, round(n / (SELECT count(*) FROM s), 4) AS share FROM g""", "samples")
def agg11(spark, d):
    return C.dataset_summary(C.split_by_hash(Views(spark, d).samples))


@query("set1_source_union", """
SELECT 'documents' AS origin, doc_id AS id, lang AS language, NULL AS role, length(text) AS n_chars FROM documents UNION ALL
SELECT 'conversations', conv_id, NULL, role, length(text) FROM conversations UNION ALL SELECT 'benchmark', item_id, NULL, NULL, length(text) FROM benchmark""")
def set1(spark, d):
    v = Views(spark, d)
    docs = v.table("documents").selectExpr("'documents' as origin", "doc_id as id", "lang as language", "length(text) as n_chars")
    talk = v.table("conversations").selectExpr("'conversations' as origin", "conv_id as id", "role", "length(text) as n_chars")
    bench = v.table("benchmark").selectExpr("'benchmark' as origin", "item_id as id", "length(text) as n_chars")
    return docs.unionByName(talk, allowMissingColumns=True).unionByName(bench, allowMissingColumns=True)


@query("set2_writer_overlap", f"""
WITH {_SPLIT_SAMPLES}, g AS (SELECT writer_id, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM s GROUP BY writer_id)
SELECT count(*) AS writers, count(*) FILTER (a AND b) AS train_val, count(*) FILTER (a AND c) AS train_test, count(*) FILTER (b AND c) AS val_test FROM g""", "samples")
def set2(spark, d):
    return C.writer_overlap(C.split_by_hash(Views(spark, d).samples))


_HOLDOUT = "SELECT sha256(text) AS digest FROM benchmark UNION SELECT sha256(text) FROM lines WHERE (doc_id * 31 + line_no) % 37 = 0"


@query("join8_holdout_exclusion", f"""
WITH h AS ({_HOLDOUT}), m AS (SELECT source, sha256(text) IN (SELECT digest FROM h) AS held FROM lines)
SELECT source, count(*) FILTER (NOT held) AS kept, count(*) FILTER (held) AS contaminated FROM m GROUP BY source""", "lines")
def join8(spark, d):
    v = Views(spark, d)
    digest = F.sha2("text", 256)
    holdout = v.table("benchmark").select(digest.alias("digest")).union(v.lines.filter("(doc_id * 31 + line_no) % 37 = 0").select(digest)).distinct()
    clean, held = C.exclude_holdout(v.lines, holdout, digest)
    both = clean.select("source", F.lit(False).alias("held")).union(held.select("source", F.lit(True)))
    return both.groupBy("source").agg(F.count_if(~F.col("held")).alias("kept"), F.count_if("held").alias("contaminated"))


@query("snk1_split_manifest_write", f"""
WITH {_SPLIT_SAMPLES} SELECT split, sample_id, source, is_lasa FROM s""", "samples")
def snk1(spark, d):
    path = f"{scratch(spark)}/manifest-{uuid.uuid4().hex}"
    rows = C.split_by_hash(Views(spark, d).samples).select("split", "sample_id", "source", "is_lasa")
    rows.write.partitionBy("split").json(path)
    return spark.read.schema("sample_id long, source string, is_lasa boolean, split string").json(path)


@query("win3_replay_batches")
def win3(spark, d):
    v = Views(spark, d)
    feedback = v.table("conversations").selectExpr("concat(conv_id, ':', turn) as key")
    return C.replay_batches(feedback, v.table("documents").selectExpr("cast(doc_id as string) as key"), 16, 0.25)


@query("win10_revision_retention", """
SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20""")
def win10(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return Views(spark, d).table("events").withColumn("r", F.row_number().over(w)).filter("r <= 20").select("user_id", "event_id", "ts")


@query("win12_active_review_time", """
SELECT user_id, count(*) AS n, (sum(CASE WHEN gap <= 60000000 THEN gap ELSE 0 END) // 1000)::BIGINT AS active_ms FROM (
  SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events WHERE event_type <> 'error') GROUP BY user_id""")
def win12(spark, d):
    # a demonstration's interactions do not count
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = Views(spark, d).table("events").filter("event_type <> 'error'").withColumn("gap", us - F.lag(us).over(w))
    return gaps.groupBy("user_id").agg(F.count("*").alias("n"), F.expr("sum(case when gap <= 60000000 then gap else 0 end) div 1000").alias("active_ms"))


@query("win11_latest_upsert", """
SELECT user_id, k, max_by(event_type, (ts, event_id)) AS decision, max(ts) AS decided_at, min(event_id) AS first_seq FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id, k""")
def win11(spark, d):
    e = Views(spark, d).table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("user_id", "k").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"), F.max("ts").alias("decided_at"), F.min("event_id").alias("first_seq"))
