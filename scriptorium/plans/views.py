"""The derived views over the driver tables as DataFrames; ``views_sql`` has the same in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import word_key
from scriptorium.sources.files import stored


class Views:
    """Lazily defined views of one data folder. Texts keep all characters but control characters."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def lines(self) -> DataFrame:
        # whole texts are cleaned, so that no filter or column of lines does it again
        clean = F.regexp_replace(F.regexp_replace("text", r"[\x00-\x09\x0B-\x1F\x7F]", ""), " {2,}", " ")
        split = spread(self.table("documents")).select("doc_id", "lang", "source", F.posexplode(F.split(clean, "\n")).alias("line_no", "raw"))
        return split.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "lang", "source", F.trim("raw").alias("text")).filter("text <> ''")

    @property
    def ref_hyp(self) -> DataFrame:
        return self.lines.selectExpr(
            "doc_id", "line_no", "lang", "source", "text as ref",
            """case (doc_id * 31 + line_no) % 5 when 0 then text when 1 then replace(replace(text, 'rn', 'm'), 'in', 'm') when 2 then replace(text, 'e', 'c')
               when 3 then case when length(text) > 4 then left(text, length(text) - 2) else text end else translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') end as hyp""",
        )

    @property
    def stage_hyp(self) -> DataFrame:
        same = F.lower("hyp") == F.lower("ref")
        third = (F.col("doc_id") * 31 + F.col("line_no")) % 5 == 2
        by_stage = F.array(
            F.col("hyp"), F.when(same, F.col("ref")).otherwise(F.col("hyp")),
            F.when(same | third, F.col("ref")).otherwise(F.col("hyp")), F.col("ref"),
        )
        staged = self.ref_hyp.select("doc_id", "line_no", "ref", F.posexplode(by_stage).alias("s", "hyp"))
        return staged.select((F.col("s") + 1).alias("stage_no"), "doc_id", "line_no", "ref", "hyp")

    @property
    def samples(self) -> DataFrame:
        labels = self.table("labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        return self.table("documents").join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("sample_id"), F.concat(F.lit("w"), F.col("doc_id") % 97).alias("writer_id"), "source",
            F.col("lang").alias("category"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_lasa"), "text", F.col("lang").alias("language"),
        )

    @property
    def tokens(self) -> DataFrame:
        # the key of a line has the keys of its tokens at their places, so that it is made once a line
        keys = self.lines.select("doc_id", "line_no", F.posexplode(F.split(word_key(F.col("text")), " ")).alias("pos", "key"))
        return keys.select("doc_id", "line_no", F.col("pos").cast("long").alias("pos"), "key").filter("key <> ''")

    @property
    def key_lines(self) -> DataFrame:
        """The keys of each line's tokens in order."""
        return self.lines.select("doc_id", "line_no", F.filter(F.split(word_key(F.col("text")), " "), lambda k: k != "").alias("keys"))

    @cached_property
    def counts(self) -> DataFrame:
        """The distinct keys of all tokens with their number, counted in whole texts and written once."""
        clean = F.regexp_replace("text", r"[\x00-\x09\x0B-\x1F\x7F]", "")
        keys = spread(self.table("documents").select("doc_id", "text")).select(F.explode(F.split(word_key(clean), "[ \n]+")).alias("key"))
        return stored(keys.filter("key <> ''").groupBy("key").agg(F.count("*").alias("n")), "counts")

    @cached_property
    def lexicon(self) -> DataFrame:
        """Written once, so that Catalyst knows its size before tokens meet it."""
        n = F.col("n")
        weight = F.when(n >= 200, 3.0).when(n >= 50, 2.0).otherwise(1.5)
        frequent = self.counts.filter("length(key) >= 2 and n >= 20")
        part = self.table("part")
        entries = (
            frequent.select("key", F.col("key").alias("word"), weight.alias("weight"))
            .union(part.selectExpr("p_name", "p_name", "2.0D").distinct())
            .union(part.selectExpr("lower(p_type)", "lower(p_type)", "1.0D").distinct())
        )
        return stored(entries.groupBy("key").agg(F.max("word").alias("word"), F.max("weight").alias("weight")), "lexicon")

    @cached_property
    def pairs(self) -> DataFrame:
        """Twenty pairs of frequent words that stand in for look-alike names."""
        counted = self.counts.filter("length(key) >= 4 and key rlike '^[a-z]+$'").select("key", F.col("n").alias("count"))
        top = counted.orderBy(F.desc("count"), "key").limit(40).groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "key"))).alias("k"))
        pairs = top.filter(F.size("k") >= 2).select(F.explode(F.sequence(F.lit(0), F.size("k") - 2, F.lit(2))).alias("i"), "k").selectExpr("k[i].key as drug_a", "k[i + 1].key as drug_b")
        return stored(pairs, "pairs")

    @property
    def swapped(self) -> DataFrame:
        """``ref_hyp`` in which hypotheses have one name for another: document k swaps pair k % 20."""
        order = F.row_number().over(Window.orderBy("drug_a")) - 1  # twenty rows
        pairs = self.pairs.select(order.alias("pair"), "drug_a", "drug_b")
        rows = self.ref_hyp.withColumn("pair", (F.col("doc_id") % 20).cast("int")).join(pairs, "pair", "left")
        padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
        swap = F.trim(F.replace(padded("hyp"), padded("drug_a"), padded("drug_b")))
        return rows.withColumn("hyp", F.coalesce(swap, "hyp")).drop("pair", "drug_a", "drug_b")

    @property
    def words(self) -> DataFrame:
        split = self.lines.select("doc_id", "line_no", F.posexplode(F.split("text", " ")).alias("w", "text"))
        split = split.select("doc_id", "line_no", F.col("w").cast("long").alias("word_no"), "text")
        h = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "line_no", "word_no")), 1, 8), 16, 10).cast("long")
        return split.withColumn("h", h).selectExpr(
            "doc_id", "line_no div 20 as page_no", "line_no", "word_no", "text", "case when h % 11 = 0 then null else (h % 1000) / 1000.0D end as confidence"
        )

    @property
    def feedback(self) -> DataFrame:
        e = self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
        lines = self.lines.selectExpr("doc_id", "line_no as l", "text as original")
        return e.join(lines, (F.col("doc_id") == F.col("user_id")) & (F.col("l") == F.col("k")), "left").selectExpr(
            "concat('s', event_id div 2) as submission_id", "user_id as document_id", "k as line_no", "original",
            "case when event_id % 3 = 0 then original else replace(original, 'e', 'c') end as correction",
            "value / 100 as confidence", "ts", "event_type = 'error' as is_demo", "event_id",
        )

    @property
    def boxes(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey as page", "l_linenumber as box_no", "l_discount * 9 as ymin", "l_tax * 8 as xmin", "(l_quantity - 5) / 40 as ymax", "(l_suppkey % 12) / 10.0D as xmax"
        )

    @property
    def steps(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_suppkey as run", "row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) as step",
            "case when l_returnflag = 'N' then 'baseline' else 'accelerated' end as mode", "l_quantity as t_data", "l_discount * 100 as t_transfer",
            "l_tax * 100 as t_fwd", "l_quantity / 2 as t_bwd", "l_discount * 50 as t_opt", "l_linenumber as num_samples", "l_extendedprice as mem", "l_shipdate as ts",
        )

    @property
    def epochs(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_custkey as run", "row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as epoch", "o_totalprice / 1000 as train_loss",
            "o_totalprice / 900 as val_loss", "round((o_orderkey % 50) / 100.0D, 2) as val_cer",
        )


#: Bytes of a stored table for each task, and tasks at most.
TASK_BYTES, MOST_TASKS = 8 << 20, 4096


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deals the rows of a table out by ``key``, whatever its files are like: a file of any size may be one row group, which
    is one task's work however many splits there are. What follows by ``key`` and more needs no further exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(min(MOST_TASKS, max(cores, size // TASK_BYTES)), key)
