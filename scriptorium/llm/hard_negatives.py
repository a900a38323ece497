"""Hard negatives by spanning-tree bounds.

Anchors are taken a block at a time, and a block is small enough to be sent to all tasks. Over the anchors
of a block stands a minimum spanning tree. A candidate is scored exactly at the root; at every other anchor
its score lies within edge length times candidate norm of its score at the parent, or of the bounds
there if it was not scored. Only candidates whose bounds overlap an anchor's window are scored at it.
The first pass has the window above the fifth positive so far, the second the windows below the
positives. Candidates are never moved: tasks send their best few rows of each window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least this share of the positive, in hundredths, and at most as much.
LOW = 80
#: Anchors of a block, and candidates that a task scores at once.
ANCHORS = 2048
CANDIDATES = 2048
SCALE = 256.0
#: Components are cut to this, so that scores of 128 dimensions fit a long.
MOST = 1 << 28


@dataclass
class AnchorTree:
    """``order`` lists the anchors from the root on, each after its parent."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    order: np.ndarray
    parent: np.ndarray
    edge: np.ndarray


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree by Euclidean distance: order, parents (-1 at the root) and edges."""
    n = len(vectors)
    x = vectors.astype(float)
    squares = (x * x).sum(axis=1)
    parent, best = np.full(n, -1), np.full(n, np.inf)
    order, left = np.empty(n, np.int64), np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], left[at] = at, False
        near = squares + squares[at] - 2 * (x @ x[at])
        closer = left & (near < best)
        best[closer], parent[closer] = near[closer], at
        at = int(np.argmin(np.where(left, best, np.inf)))
    edge = np.sqrt(((x - x[parent]) ** 2).sum(axis=1))  # from the differences, without cancellation
    edge[parent < 0] = 0
    return order, parent, edge


def _scores(rows: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as int64: by floating point where all partial sums are exact there."""
    if exact:
        return (rows @ anchor.astype(float)).astype(np.int64)
    return rows.astype(np.int64) @ anchor


class _Best:
    """The first ``k`` candidates of each window so far, by score downwards, then id."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.rows: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2 for _ in range(windows)]

    def floor(self, w: int) -> float:
        """No candidate with a lower score can still come in."""
        score = self.rows[w][0]
        return float(score[-1]) if len(score) == self.k else -math.inf

    def add(self, w: int, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > 4 * self.k:
            keep = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[keep], ids[keep]
        score, ids = np.concatenate([self.rows[w][0], score]), np.concatenate([self.rows[w][1], ids])
        first = np.lexsort((ids, -score))[: self.k]
        self.rows[w] = score[first], ids[first]


def _walk(tree: AnchorTree, rows: np.ndarray, exact: bool, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, places, scores) of the candidates ``rows`` whose bounds at the anchor meet ``wanted(anchor)``,
    intervals of scores."""
    norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
    low, high = {}, {}
    waiting = np.bincount(tree.parent[tree.parent >= 0], minlength=len(tree.ids))
    for a in tree.order:
        p = int(tree.parent[a])
        if p < 0:
            keep = np.arange(len(rows))
            lo, hi = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
        else:
            reach = tree.edge[a] * norms
            reach += 1e-9 * (np.abs(low[p]) + reach) + 1e-6  # what floating point may have lost
            lo, hi = low[p] - reach, high[p] + reach
            meets = np.zeros(len(rows), bool)
            for at, to in wanted(a):
                meets |= (hi >= at) & (lo <= to)
            keep = np.flatnonzero(meets)
            waiting[p] -= 1
            if not waiting[p]:
                del low[p], high[p]
        scores = _scores(rows[keep], tree.vectors[a], exact)
        if waiting[a]:
            lo[keep] = hi[keep] = scores
            low[a], high[a] = lo, hi
        yield int(a), keep, scores


def _whole(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` integers; a vector counts as zero beyond its end."""
    lengths, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _batches(batches: Iterator[pa.RecordBatch], width: int, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            part = batch.slice(at, CANDIDATES)
            rows = _whole(part.column("q"), width)
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), rows.astype(float) if exact else rows


def _positives(shared, width: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        best = _Best(len(tree.ids), POSITIVES)
        for ids, labels, rows in _batches(batches, width, exact):
            for a, keep, scores in _walk(tree, rows, exact, lambda a: [(best.floor(a), math.inf)]):
                own = (labels[keep] == tree.labels[a]) & (ids[keep] != tree.ids[a]) & (scores >= best.floor(a))
                if own.any():
                    best.add(a, scores[own], ids[keep][own])
        yield from _sent(best, anchor=np.arange(len(tree.ids)))

    return run


def _negatives(shared, windows, width: int, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        anchors, places, positives, tops = windows.value
        floors = _least(tops)
        best = _Best(len(anchors), NEGATIVES)
        first, last = np.searchsorted(anchors, [np.arange(len(tree.ids)), np.arange(1, len(tree.ids) + 1)])
        spans = lambda a: [(max(floors[w], best.floor(w)), tops[w]) for w in range(first[a], last[a])]
        for ids, labels, rows in _batches(batches, width, exact):
            for a, keep, scores in _walk(tree, rows, exact, spans):
                other = labels[keep] != tree.labels[a]
                scores, named = scores[other], ids[keep[other]]
                for w, (low, high) in zip(range(first[a], last[a]), spans(a), strict=True):
                    fits = (scores >= low) & (scores <= high)
                    if fits.any():
                        best.add(w, scores[fits], named[fits])
        yield from _sent(best, anchor=anchors, place=places, anchor_id=tree.ids[anchors], positive_id=positives, positive_score=tops)

    return run


def _least(tops: np.ndarray) -> np.ndarray:
    return -((-LOW * tops) // 100)


def _sent(best: _Best, **of_window: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task has found, a row for each window and candidate."""
    sizes = [len(s) for s, _ in best.rows]
    if sum(sizes):
        columns = {k: np.repeat(v, sizes) for k, v in of_window.items()}
        columns |= {"id": np.concatenate([i for _, i in best.rows]), "score": np.concatenate([s for s, _ in best.rows])}
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def _quantized(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label, q of the rows that take part."""
    x, most = F.col("x"), F.lit(float(MOST))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    whole = F.transform(x, lambda v: F.floor(F.greatest(-most, F.least(most, v * SCALE))).cast("int"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite).select("id", "label", whole.alias("q"))


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each window, of at most ``k`` that each task sent."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchors: int = ANCHORS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of
    its ``POSITIVES`` best other rows of its label, the first ``NEGATIVES`` rows of other labels that score
    from ``LOW`` per cent of the positive's score up to that score.

    Scores are inner products of components floor(256 * x), cut to ``MOST`` either way; ties go to the
    smaller id. ``is_anchor`` is a condition on the column ``id``. Rows with a null id, label, vector or component,
    or a non-finite one, take no part. A shorter vector counts as zero beyond its end. Rows that
    repeat an id each take part, but not as positives of their own id; an anchor row that repeats whole
    counts once. An empty table gives no rows, and other columns are not read.

    ``anchors`` of them at a time go through the driver and to all tasks; candidates stay where they are.
    """
    spark = vectors.sparkSession
    rows = materialize(_quantized(vectors, id_col, label_col, vector_col), "quantized")
    chosen = rows.filter(is_anchor).dropDuplicates()
    measure = rows.agg(F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs)))).first()
    width, most = measure[0] or 0, measure[1] or 0
    exact = width * most * most < 1 << 53
    blocks = max(1, -(-chosen.count() // anchors))
    out = None
    for block in range(blocks):
        part = chosen.filter(F.pmod(F.xxhash64("id", "label", "q"), F.lit(blocks)) == block).orderBy("id", "label", "q").toArrow()
        at = _whole(part.column("q").combine_chunks(), width) if len(part) else np.zeros((0, width), np.int64)
        if not len(at):
            continue
        tree = spark.sparkContext.broadcast(AnchorTree(part.column("id").to_numpy(), part.column("label").to_numpy(), at, *spanning_tree(at)))
        sent = rows.mapInArrow(_positives(tree, width, exact), "anchor long, id long, score long")
        found = _first(sent, ["anchor"], POSITIVES).orderBy("anchor", "rank").toArrow()
        columns = [found.column(c).to_numpy().astype(np.int64) for c in ("anchor", "rank", "id", "score")]
        windows = spark.sparkContext.broadcast([c[columns[3] >= 0] for c in columns])  # below zero no score is between the shares
        kinds = "anchor long, place long, anchor_id long, positive_id long, positive_score long, id long, score long"
        negatives = _first(rows.mapInArrow(_negatives(tree, windows, width, exact), kinds), ["anchor", "place"], NEGATIVES)
        negatives = materialize(negatives.select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ), "negatives")
        out = negatives if out is None else out.union(negatives)
        tree.unpersist()
        windows.unpersist()
    if out is None:
        out = spark.range(0).selectExpr("id as anchor_id", "id as positive_id", "0 as rank", "id as negative_id", "id as positive_score", "id as negative_score")
    return out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("id") % 100 == 0)


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (SELECT anchor_id, id, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}
"""
