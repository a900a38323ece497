"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest reference points in order. Inverted lists hold, for each
label and pivot, the classes of equal vectors that have the pivot among their nearest. Two that share at
least ``MIN_SHARED`` pivots are verified by cosine in double precision, once: in the list of the
smallest pivot they share. Lists longer than a block are dealt as pairs of blocks, and only sums and
spanning links leave a block, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, table

THRESHOLD = 0.93
#: Nearest pivots that describe a vector, and how many of them a candidate pair must share.
NEAREST = 8
MIN_SHARED = 2
#: Pivots: one for each so many distinct vectors, within bounds that keep them broadcastable: the most are
#: 8 MB at 64 dimensions. Of pairs at a cosine of exactly 0.93 there, 8 nearest pivots share 2 in all cases
#: with 64 pivots, in 0.991 with 2,048 and in 0.970 with 16,384.
VECTORS_PER_PIVOT = 400
PIVOTS = (64, 16_384)
BLOCK = 1024


def choose_pivots(classes: DataFrame, n_classes: int) -> np.ndarray:
    """Reference points: a bounded sample of the distinct directions by hash of the class."""
    k = int(min(max(n_classes // VECTORS_PER_PIVOT, PIVOTS[0]), PIVOTS[1]))
    rows = classes.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(2 * k).select("vector").toPandas()["vector"]
    width = max(map(len, rows), default=0)
    found, n = np.zeros((min(k, len(rows)), width)), 0
    for row in rows:
        v = np.pad(np.asarray(row, float), (0, width - len(row)))
        # near copies of a pivot would only split its list
        if n < len(found) and (not n or (found[:n] @ v).max() < THRESHOLD):
            found[n] = v
            n += 1
    return found[:n]


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link, as unit vectors: id, label, vector (array of double). Vectors are scaled by
    their largest component first, so that no finite one is lost to overflow or underflow."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull() & finite)
    rows = rows.withColumn("top", F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).filter("top > 0")
    rows = rows.withColumn("scaled", F.transform("embedding", lambda x: x.cast("double") / F.col("top")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select("id", "label", F.transform("scaled", lambda x: x / F.col("norm")).alias("vector"))


def _index(classes: DataFrame, pivots_b) -> DataFrame:
    """Each class with its vector's nearest pivots, nearest first; ties by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = pivots_b.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                rows = [np.asarray(v) for v in piece.column("vector").to_pylist()]
                width = pivots.shape[1]
                dense = np.stack([np.pad(v[:width], (0, width - min(len(v), width))) for v in rows])
                near = np.argsort(-(dense @ pivots.T), axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(list(near), pa.list_(pa.int32()))], names=["cid", "label", "vector", "n", "near"])

    return classes.select("cid", "label", "vector", "n").mapInArrow(run, "cid long, label long, vector array<double>, n long, near array<int>")


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Link counts and spanning links of one pair of blocks of one inverted list."""
    pivot, lo, hi = (int(group[c].iat[0]) for c in ("pivot", "lo", "hi"))
    group = group.reset_index(drop=True)
    left = group[group["own"] == lo]
    right = left if lo == hi else group[group["own"] == hi]
    none = pd.DataFrame({"cid": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "to": np.zeros(0, np.int64), "linked": np.zeros(0, bool)})
    if not len(left) or not len(right):
        return none
    lengths = group["vector"].map(len).to_numpy()
    dense = np.stack([np.pad(v, (0, lengths.max() - len(v))) for v in group["vector"]])
    # which pivots each row has, of those that any has, in order
    have, near = np.unique(np.stack(group["near"]), return_inverse=True)
    near = near.reshape(len(group), -1)
    has = np.zeros((len(group), len(have)), np.float32)
    np.put_along_axis(has, near, 1, 1)
    i, j, before = left.index.to_numpy(), right.index.to_numpy(), int(np.searchsorted(have, pivot))
    # verified in the list of the smallest pivot that two rows share
    hit = (has[i] @ has[j].T >= min(MIN_SHARED, near.shape[1])) & (has[i, :before] @ has[j, :before].T == 0) & (dense[i] @ dense[j].T >= THRESHOLD)
    hit &= lengths[i][:, None] == lengths[j][None, :]
    ids, others = left["cid"].to_numpy(), right["cid"].to_numpy()
    if lo == hi:
        np.fill_diagonal(hit, False)
    counts = [(ids, hit @ right["n"].to_numpy())] + ([] if lo == hi else [(others, hit.T @ left["n"].to_numpy())])
    out = [pd.DataFrame({"cid": i[n > 0], "n": n[n > 0], "to": np.int64(-1), "linked": False}) for i, n in counts]
    # a spanning forest of the block's links
    root: dict[int, int] = {}

    def find(i):
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, row in zip(ids.tolist(), hit, strict=True):
        for j in others[row].tolist():
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
    spans = np.array([(i, find(i)) for i in list(root) if find(i) != i], np.int64).reshape(-1, 2)
    out.append(pd.DataFrame({"cid": spans[:, 0], "n": np.int64(0), "to": spans[:, 1], "linked": True}))
    return pd.concat([none, *out], ignore_index=True)


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are compared only under equal, non-null labels; they link at cosine >= ``THRESHOLD`` in
    double precision. Vectors that are null, empty, zero or hold null or non-finite components, and
    rows with a null id, link with nothing: n_links 0 and their own id as component. Vectors of
    different length do not link. Equal vectors of a label are one class, compared once and counted
    by its rows. Rows that repeat an id share their component, and their links are summed into one
    count. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("long").alias("label")
    )
    usable = materialize(_usable(rows), "vectors")
    classes = usable.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    pivots = choose_pivots(classes, classes.count())
    described = materialize(_index(classes, spark.sparkContext.broadcast(pivots)), "pivots")
    lists = described.withColumn("pivot", F.explode("near"))
    sizes = lists.groupBy("label", "pivot").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = sizes.select("label", "pivot", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        lists.join(sizes, ["label", "pivot"])
        .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        .drop("blocks", "other")
    )
    found = materialize(
        dealt.groupBy("label", "pivot", "lo", "hi").applyInPandas(_block_links, "cid long, n long, to long, linked boolean"),
        "vector-links",
    )
    # merge joins: both sides grow with the input
    member = usable.join(classes.select("label", "vector", "cid").hint("merge"), ["label", "vector"]).select("id", "cid")
    member = materialize(member, "vector-members")
    again = member.groupBy("id").agg(F.min("cid").alias("c0"), F.max("cid").alias("c1")).filter("c0 <> c1")
    edges = found.filter("linked").select(F.col("cid").alias("u"), F.col("to").alias("v"))
    parts = components(edges.union(member.join(again, "id").select("cid", "c0")))
    links = found.filter("not linked").groupBy("cid").agg(F.sum("n").alias("links"))
    each = classes.select("cid", "id", "n").join(links, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    each = each.select("cid", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("root"))
    tops = each.groupBy("root").agg(F.min("id").alias("component"))
    each = materialize(each.join(tops, "root").select("cid", "n_links", "component"), "vector-each")
    linked = member.distinct().join(each.hint("merge"), "cid").groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("component").alias("component"))
    out = rows.select("id").join(linked.hint("merge"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def op3_pivot_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
