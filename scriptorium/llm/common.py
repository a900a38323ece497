"""What the corpus operators share: scratch tables, text rules, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's own setting: the shuffle files of a query go when it has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The scratch tables of each ``settle`` that runs, the innermost last.
_open: list[list[DataFrame]] = []
#: The folder of a local master without the setting.
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A folder of our own only on a local master, where
    driver and executors are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors,
    and gives the planner the true size."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append(out)
    return out


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what ``make`` returns and drop all scratch tables made on the way to it."""
    _open.append([])
    try:
        out = materialize(make(), name)
    finally:
        made = _open.pop()
    for done in made:
        if done is not out:
            drop_table(done)
    if _open:
        _open[-1].append(out)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more; none if that is done already."""
    jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def n_words(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, component)``, component = smallest node.

    Alternating large-star and small-star rounds: each is one pre-aggregated minimum per node and
    one join on it, so that neither a node's neighbours nor a component meet in one task; about
    log(n) rounds. Nodes without edges are not returned.
    """
    edges = materialize(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "cc",
    )
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # each node keeps its own smallest neighbour as well, or it would drop out
        large = large.union(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(edges)
        edges = after
        if mark == before or not mark[0]:
            break
        before = mark
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
