"""Corpus curation: conforming records, splits, caps, set checks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_split(col: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    return F.when(name.isin("val", "valid", "validation"), "val").when(name == "test", "test").otherwise("train")


def conform(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Raw rows joined with their source's configuration, in the shape of curated samples."""
    joined = rows.join(config, "source")
    sample_id = F.format_string("%s_%s_%08d", "source", canonical_split(F.col("raw_split")), F.col("row_index"))
    writer = F.coalesce(F.nullif(F.col("writer"), F.lit("")), sample_id)
    return joined.select(
        sample_id.alias("sample_id"), "source", "category", "language", canonical_split(F.col("raw_split")).alias("split"),
        F.concat_ws("::", "source", writer).alias("writer_id"), F.col("label").alias("text"), F.length("label").cast("long").alias("n_chars"),
        F.map_from_arrays(F.array(F.lit("homepage"), F.lit("origin")), F.array("homepage", "raw_split")).alias("metadata"),
    )


def stage_filter(rows: DataFrame, categories: list[str], group: str | None = None) -> DataFrame:
    """Rows of the wanted categories or flagged; all rows where nothing survives. One pass."""
    match = F.coalesce(F.col("category").isin(categories) | F.col("is_lasa"), F.lit(False))
    any_match = rows.withColumn("m", match).groupBy(*([group] if group else [])).agg(F.max("m").alias("any_match"))
    joined = rows.join(any_match, group) if group else rows.crossJoin(any_match)  # one row
    return joined.filter(match | ~F.col("any_match")).drop("any_match")


def allow_deny(requested: DataFrame, enabled: DataFrame, excluded: DataFrame) -> DataFrame:
    """Requested keys with their fate: accepted, excluded, or unknown."""
    known = requested.join(enabled.withColumn("known", F.lit(True)), "key", "left").join(excluded.withColumn("banned", F.lit(True)), "key", "left")
    return known.select("key", F.when(F.col("banned"), "excluded").when(F.col("known"), "accepted").otherwise("unknown").alias("status"))


def split_by_ratio(rows: DataFrame, seed: int = 7, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Writers in hash order: the first share trains, the next validates, the rest tests.

    Only the distinct writers, each one row, are ordered, by hash ranges; samples inherit by a join.
    """
    owned = rows.withColumn("writer_id", F.coalesce("writer_id", F.concat(F.lit("w_"), F.col("sample_id"))))
    writers = owned.select(F.col("writer_id").alias("key")).distinct()
    ranked = numbered(writers, salt=f"{seed}:").select(F.col("key").alias("writer_id"), (F.col("place") + 1).alias("r"), "n")
    n_train = F.greatest(F.lit(1), F.bround(F.col("n") * train).cast("int"))
    n_val = F.when(F.col("n") <= 2, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("n") * val).cast("int")))
    short = (F.col("n") > 1) & (n_train + n_val >= F.col("n"))
    kept = F.when(short, n_train - 1).otherwise(n_train)
    split = F.when(F.col("r") <= kept, "train").when(F.col("r") <= kept + n_val, "val").otherwise("test")
    return owned.join(ranked.select("writer_id", split.alias("split")), "writer_id")


def hash_bucket(writer: Column, seed: int = 42) -> Column:
    text = F.concat(F.lit(f"{seed}:"), writer)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100


def split_by_hash(rows: DataFrame, seed: int = 42) -> DataFrame:
    """80/10/10 by a hash of the writer; no exchange at all."""
    bucket = hash_bucket(F.col("writer_id"), seed)
    return rows.withColumn("split", F.when(bucket < 80, "train").when(bucket < 90, "val").otherwise("test"))


def split_or_keep(rows: DataFrame, seed: int = 42) -> DataFrame:
    """The splits of ``raw_split`` for sources that ship any validation or test rows, and those of ``split_by_hash`` for
    the others. Which sources do is one aggregate of a row a source."""
    own = canonical_split(F.col("raw_split"))
    shipped = rows.groupBy("source").agg(F.max((own != "train").cast("int")).alias("shipped"))
    hashed = split_by_hash(rows, seed).withColumn("own", own)
    joined = hashed.join(shipped.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("split", F.when(F.col("shipped") == 1, F.col("own")).otherwise(F.col("split"))).drop("own", "shipped", "of")


def cap_per_source(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each source; Spark limits each task's groups before the exchange."""
    w = Window.partitionBy("source").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Counts and shares by split, source, category and language in one pass of grouping sets."""
    dims = ["split", "source", "category", "language"]
    sets = [[F.col(d)] for d in dims] + [[]]
    kind = F.coalesce(*[F.when(F.grouping(d) == 0, d) for d in dims], F.lit("all"))
    total = F.max(F.when(F.col("kind") == "all", F.col("n"))).over(Window.partitionBy())  # a row per value
    return (
        rows.groupingSets(sets, *[F.col(d) for d in dims])
        .agg(kind.alias("kind"), F.coalesce(*dims, F.lit("")).alias("value"), F.count("*").alias("n"), F.count_distinct("writer_id").alias("writers"), F.count_if("is_lasa").alias("n_lasa"))
        .select("kind", "value", "n", "writers", "n_lasa").withColumn("share", F.round(F.col("n") / total, 4))
    )


def writer_overlap(rows: DataFrame) -> DataFrame:
    """Writers shared by each pair of splits; a leak-free corpus has none."""
    seen = rows.groupBy("writer_id").agg(F.collect_set("split").alias("s"))  # three splits at most
    pair = lambda a, b: F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}")
    return seen.agg(F.count("*").alias("writers"), pair("train", "val"), pair("train", "test"), pair("val", "test"))


def exclude_holdout(rows: DataFrame, holdout: DataFrame, digest: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose digest is not held out, the contaminated ones)."""
    marked = rows.withColumn("digest", digest)
    return marked.join(holdout, "digest", "left_anti"), marked.join(holdout, "digest", "left_semi")


def replay_batches(feedback: DataFrame, anchors: DataFrame, batch_size: int, ratio: float, drop_last: bool = False, max_batches: int | None = None) -> DataFrame:
    """Batches of a fixed share of feedback: every batch draws ``n_fb`` feedback and the rest anchor
    rows; the smaller pool starts over, in another order each cycle: batch, pool, cycle, key.

    As many batches as the larger need of either pool; ``drop_last`` leaves out one that its pool cannot
    fill. Each pool comes once a cycle, numbered by hash ranges, so that none is ordered in one task.
    """
    n_fb = min(max(round(batch_size * ratio), 1 if 0 < ratio < 1 else 0), batch_size - (1 if 0 < ratio < 1 else 0))
    take = {"feedback": n_fb, "anchor": batch_size - n_fb}
    pools = {"feedback": feedback, "anchor": anchors}
    sizes = {k: p.count() for k, p in pools.items()}
    needs = [sizes[k] // take[k] if drop_last else -(-sizes[k] // take[k]) for k in take if take[k] and sizes[k]]
    batches = max([0 if drop_last else 1, *needs])
    batches = batches if max_batches is None else min(batches, max_batches)
    out = None
    for kind, n in take.items():
        if not n or not sizes[kind]:
            continue
        cycles = F.sequence(F.lit(0).cast("long"), F.lit(max(0, -(-batches * n // sizes[kind]) - 1)).cast("long"))
        again = pools[kind].select("key", F.explode(cycles).alias("cycle"))
        slot = F.col("cycle") * sizes[kind] + F.col("place")
        drawn = numbered(again, ["cycle"]).filter(slot < batches * n)
        part = drawn.select(F.floor(slot / n).alias("batch"), F.lit(kind).alias("pool"), "cycle", "key")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return feedback.select(F.lit(0).cast("long").alias("batch"), F.lit("").alias("pool"), F.lit(0).cast("long").alias("cycle"), "key").limit(0)
    return out


def numbered(pool: DataFrame, within: list[str] | None = None, salt: str = "") -> DataFrame:
    """``place`` 0, 1, ... of the pool's keys in the order of an MD5 of salt, group and key, for each group
    of ``within``, with the group's size ``n``: by counts of hash ranges and ranks inside them."""
    by = within or []
    digest = F.md5(F.concat(F.lit(salt), *[c for g in by for c in (F.col(g).cast("string"), F.lit(":"))], F.col("key").cast("string")))
    hashed = pool.select("key", *by, digest.alias("digest")).withColumn("range", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"))
    counts = hashed.groupBy(*by, "range").agg(F.count("*").alias("here"))  # 4,096 rows a group at most
    group = Window.partitionBy(*by)
    before = F.sum("here").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*by, "range", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(group).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by, "range").orderBy("digest", "key"))
    placed = hashed.withColumn("rank", rank).join(counts, [*by, "range"])
    return placed.select("key", *by, (F.col("before") + F.col("rank") - 1).alias("place"), "n")
