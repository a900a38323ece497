"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks by a hash of their id. A source's target decides how many
times each block is taken. The taken blocks are the quotas at the root of a binary tree over the
output shards: each node deals half its blocks to either child, drawing how many of each source by
the multivariate hypergeometric law, so that every shard's quotas are exact and sum to the whole.
Shards then take disjoint runs of each source's permuted blocks and order their rows by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, settle, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Blocks per source; bounds every window over blocks whatever the input.
BLOCKS = 1024
SHARDS = 16
#: Parts in which a shard's rows are shuffled.
PARTS = 64
SEED = 20240


def _hash(*cols: Column | str) -> Column:
    return F.xxhash64(F.lit(SEED), *cols)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` with its target added.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words;
    a target stops at ``most`` times its source's size and the excess is reshared by weight. In
    order of cap per weight the sources that stop come first, which windows over the (few) sources
    decide without iterating.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    all_rows = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("budget", F.sum("source_size").over(all_rows) * share)
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
    )
    stops = F.col("cap") * F.col("w_left") <= (F.col("budget") - F.col("caps_before")) * F.col("w")
    first_open = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), F.col("caps_before"), F.col("w_left")))).over(all_rows)
    out = ranked.withColumn("stops", stops).withColumn("open", first_open)
    share_of = (F.col("budget") - F.col("open.caps_before")) / F.col("open.w_left") * F.col("w")
    return out.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(share_of).alias("target"))


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 8, good to 1e-12."""
    y = x + 8.0
    series = y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * y * y * y)
    below = F.lit(1.0)
    for k in range(1, 9):
        below = below * (x + float(k))
    return series - F.log(below)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` from ``total`` are among ``marked``, by inversion at ``u``."""
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked))
    high = F.least(marked, drawn)

    def step(acc: Column, k: Column) -> Column:
        log_p = _log_choose(marked.cast("double"), k.cast("double")) + _log_choose(
            (total - marked).cast("double"), (drawn - k).cast("double")
        ) - _log_choose(total.cast("double"), drawn.cast("double"))
        mass = acc["mass"] + F.exp(log_p)
        return F.struct(mass.alias("mass"), F.when(acc["mass"] < u, k).otherwise(acc["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("mass"), low.alias("k"))
    return F.aggregate(F.sequence(low, high), start, step, lambda acc: acc["k"])


def shard_quotas(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``quotas(src, quota)`` dealt to ``shards`` (a power of two): src, shard, quota.

    One row per node holds the quotas of all sources; a level of the tree splits every node once.
    """
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("src", "quota"))).alias("q")).withColumn("node", F.lit(1).cast("long"))
    total = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x["quota"])
    for _ in range(int(math.log2(shards))):

        def deal(acc: Column, x: Column) -> Column:
            u = (F.pmod(_hash(F.col("node"), x["src"]), F.lit(2**31)) + 0.5) / float(2**31)
            k = _hypergeometric(acc["total"], x["quota"], acc["drawn"], u)
            return F.struct(
                (acc["total"] - x["quota"]).alias("total"),
                (acc["drawn"] - k).alias("drawn"),
                F.array_append(acc["left"], F.struct(x["src"].alias("src"), k.alias("quota"))).alias("left"),
            )

        start = F.struct(
            F.col("total").alias("total"),
            F.expr("total div 2").alias("drawn"),
            F.expr("cast(array() as array<struct<src:string,quota:bigint>>)").alias("left"),
        )
        split = nodes.withColumn("total", total(F.col("q"))).withColumn("left", F.aggregate("q", start, deal, lambda a: a["left"]))
        right = F.zip_with("q", "left", lambda a, b: F.struct(a["src"].alias("src"), (a["quota"] - b["quota"]).alias("quota")))
        child = F.explode(
            F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
                F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")),
            )
        )
        nodes = split.select(child.alias("c")).select("c.node", "c.q")
    return nodes.select((F.col("node") - shards).alias("shard"), F.inline("q")).filter("quota > 0")


def plan_mix(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, src, size, source_size, target, mix_shards.

    ``mix_shards`` lists the output shard of each time the mix takes the row (none, one or two).
    A null text has size 0; a null source is a source of its own; repeated ids count as separate
    rows but share a block; sources without words have target 0 and nothing of them is taken.
    """
    base = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("src"),
            n_words(F.col("text")).alias("size"),
            F.pmod(_hash(F.col("doc_id")), F.lit(blocks)).alias("block"),
        ),
        "mix-sizes",
    )
    by_block = materialize(base.groupBy("src", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    source = F.when(F.col("src") != "null", F.substring("src", 2, 2**31 - 1))
    targets = source_targets(by_block.groupBy("src").agg(F.sum("words").alias("source_size")).withColumn("source", source).select("source", "source_size"))
    targets = materialize(
        targets.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("src"), "source_size", "target"),
        "mix-targets",
    )
    # whole rounds over the source, then permuted blocks as long as they fit; the smallest block
    # that did not fit is cut between documents
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per_source = (
        by_block.filter("words > 0")
        .groupBy("src")
        .agg(F.array_sort(F.collect_list(F.struct(_hash("src", "block").alias("h"), "block", "words"))).alias("permuted"))
        .join(targets, "src")
        .withColumn("whole", whole)
    )

    def spend(acc: Column, x: Column) -> Column:
        fits = x["words"] <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - x["words"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, acc["cut"]).otherwise(F.least(acc["cut"], F.struct(x["words"].alias("words"), x["block"].alias("block")))).alias("cut"),
            F.array_append(acc["fits"], fits).alias("fits"),
        )

    start = F.struct(
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        F.lit(None).cast("struct<words:bigint,block:bigint>").alias("cut"),
        F.expr("cast(array() as array<boolean>)").alias("fits"),
    )
    spent = per_source.withColumn("s", F.aggregate("permuted", start, spend))
    plan = spent.select(
        "src", "source_size", "target", "whole", F.col("s.left").alias("left"), F.col("s.cut.block").alias("cut"),
        F.explode(F.arrays_zip("permuted", F.col("s.fits").alias("fits"))).alias("b"),
    ).select(
        "src", "source_size", "target", "left", F.col("b.permuted.block").alias("block"),
        F.coalesce(F.col("cut") == F.col("b.permuted.block"), F.lit(False)).alias("boundary"),
        F.col("b.fits").alias("fits"), "whole",
    )
    plan = plan.withColumn("copies", F.col("whole") + (F.col("fits") | F.col("boundary")).cast("long"))
    plan = materialize(plan.drop("fits", "whole"), "mix-plan")
    # block copies are dealt to shards
    dealt = shard_quotas(plan.groupBy("src").agg(F.sum("copies").alias("quota")), shards)
    upto = F.sum("quota").over(Window.partitionBy("src").orderBy("shard"))
    slots = dealt.withColumn("end", upto).select("src", "shard", F.explode(F.expr("sequence(end - quota + 1, end)")).alias("rank"))
    items = plan.filter("copies > 0").select("src", "block", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(_hash("src", "block", "copy"), "block", "copy")).cast("long"))
    homes = ranked.join(slots, ["src", "rank"]).groupBy("src", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("homes")
    )
    plan = materialize(plan.join(homes, ["src", "block"], "left"), "mix-homes")
    known = targets.select("src", "source_size", "target")
    placed = base.join(known, "src").join(plan.drop("source_size", "target"), ["src", "block"], "left").select(
        "doc_id", "src", "block", "size", "source_size", "target", "left", F.coalesce("boundary", F.lit(False)).alias("boundary"),
        F.when(F.col("size") > 0, F.col("homes")).alias("homes"),
    )
    # the block in which a source's last round ends is cut between documents, at the nearest end; rows
    # that repeat an id within a source are taken alike, so that their id names the decision
    edge = placed.filter("boundary")
    units = edge.groupBy("src", "doc_id").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    inside = Window.partitionBy("src").orderBy("words", _hash("doc_id"), "doc_id")
    before = F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(before, F.lit(0)) + F.col("words") / 2 > F.col("left")
    units = units.select(F.col("src").alias("u_src"), F.col("doc_id").alias("u_id"), cut.alias("cut"))
    ends = edge.join(units, (F.col("src") == F.col("u_src")) & F.col("doc_id").eqNullSafe(F.col("u_id")))
    ends = ends.withColumn("homes", F.when(F.col("cut"), F.expr("slice(homes, 1, size(homes) - 1)")).otherwise(F.col("homes")))
    return placed.filter("not boundary").union(ends.select(*placed.columns)).select(
        "doc_id", "src", "size", "source_size", "target",
        F.coalesce("homes", F.expr("cast(array() as array<bigint>)")).alias("mix_shards"),
    )


def _taken(docs: DataFrame, shards: int, blocks: int, parts: int) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., with mix_shard and mix_order, a row for each time it is taken."""

    def homes() -> DataFrame:
        plan = plan_mix(docs.select("doc_id", "source", "text"), shards, blocks)
        # rows of one id differ only in that those without words have no shards
        return plan.filter("size(mix_shards) > 0").groupBy("doc_id", "src").agg(F.max("mix_shards").alias("mix_shards"))

    taken = settle(homes, "mix-docs").toDF("mix_id", "mix_src", "mix_shards")
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    same = at["doc_id"].cast("long").eqNullSafe(F.col("mix_id")) & (F.coalesce(F.concat(F.lit("="), at["source"]), F.lit("null")) == F.col("mix_src"))
    # a merge join at every size: both sides grow with the input
    rows = docs.toDF(*names).join(taken.hint("merge"), same).filter(n_words(at["text"]) > 0)
    out = rows.select(*names, F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    out = out.withColumn("mix_order", _hash(at["doc_id"].cast("long"), "mix_copy")).withColumn("mix_part", F.pmod(F.xxhash64("mix_order"), F.lit(parts)))
    out = out.repartition("mix_shard", "mix_part").sortWithinPartitions("mix_shard", "mix_part", "mix_order")
    return out.select(*names, "mix_shard", "mix_order")


def mix(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, parts: int = PARTS) -> DataFrame:
    """The mixed rows: the columns of ``docs``, then mix_shard and mix_order, a row for each time it is taken.

    Rows are dealt to shards, each in ``parts`` parts by hash, and lie in the order of mix_order within
    a part. Rows without words are never taken; rows that repeat id and source are taken alike. An
    empty table stays empty. Columns of ``docs`` named mix_shard or mix_order are left out for these.
    """
    out = _taken(docs, shards, blocks, parts)
    kept = [(n, c) for n, c in zip(out.columns, docs.columns, strict=False) if c not in ("mix_shard", "mix_order")]
    return out.select(*[n for n, _ in kept], "mix_shard", "mix_order").toDF(*[c for _, c in kept], "mix_shard", "mix_order")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``mix`` with the columns of ``docs`` alone, whatever their names."""
    out = _taken(docs, SHARDS, BLOCKS, PARTS)
    return out.select(*out.columns[: len(docs.columns)]).toDF(*docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("mix_shards")).cast("long").alias("taken"), "mix_shards"
    )
