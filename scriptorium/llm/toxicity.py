"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows is fitted: the TF-IDF weights of all terms that say something of the
label go into an inverted index whose postings are held in blocks of examples with the largest weight of each term and block. A
document visits the blocks of the largest upper bounds, then all blocks that can still reach its
k-th best similarity, so its neighbours are exact. Neighbours vote
with their similarity; the vote is calibrated on the examples themselves, each left out in turn.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, table

#: Labelled rows fitted at most, by label; the rows with the smallest hashes of their ids.
EXAMPLES = {1: 1500, 0: 3000}
#: A term is left out if fewer examples hold it, or if chi-square is below this and the labels use it at rates within this factor.
LEAST_EXAMPLES = 3
LEAST_CHI2 = 50.0
NEUTRAL = 20.0
NEIGHBOURS = 15
BLOCK = 64
FOLDS = 3
#: Blocks visited before the others are pruned.
FIRST = 8
CUT = 0.7
EVIDENCE = 3
_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_CLEAR = bytes.maketrans(bytes(b for b in range(128) if b not in _LETTERS), b" " * (128 - len(_LETTERS)))


def terms_of(text: str | None) -> list[bytes]:
    """ASCII punctuation and white space separate terms; A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAR).lower().split()


@dataclass(frozen=True)
class TermRule:
    """Which terms of the examples are left out; chosen by ``cross_validated`` on learnt rows."""

    examples: int = LEAST_EXAMPLES
    chi2: float = LEAST_CHI2
    neutral: float = NEUTRAL


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + (starts - np.cumsum(sizes) + sizes)[of], of


@dataclass
class BlockMaxIndex:
    vocabulary: dict[bytes, int]
    idf: np.ndarray
    #: postings of cell c: places pointers[c] up to the next
    pointers: np.ndarray
    slots: np.ndarray
    weights: np.ndarray
    maxima: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    blocks: int
    slope: float = 8.0
    shift: float = -4.0
    empty: float = 0.0
    #: cells of term t: firsts[t] up to the next, and their blocks; without them cell t * blocks + b is term t in block b
    firsts: np.ndarray | None = None
    cell_blocks: np.ndarray | None = None

    def __post_init__(self):
        if self.firsts is None:
            self.firsts = np.arange(len(self.maxima) + 1) * self.blocks
            self.cell_blocks = np.arange(len(self.maxima) * self.blocks) % self.blocks
        self.maxima = self.maxima.ravel()

    def vector(self, counts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array([a for a, _ in counts], np.int64)
        w = (1 + np.log(np.array([b for _, b in counts], float))) * self.idf[t]
        return t, w / math.sqrt(float(w @ w)) if len(w) and float(w @ w) > 0 else w

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine and their cosines, largest first; ties by place."""
        cells, by = _ranges(self.firsts[terms], self.firsts[terms + 1])
        at, most = self.cell_blocks[cells], weights[by] * self.maxima[cells]
        bounds = np.bincount(at, most, self.blocks)
        left = np.flatnonzero(bounds > 0)
        left = left[np.argsort(-bounds[left], kind="stable")]
        score = np.zeros(self.blocks * BLOCK)
        for round in (left[:FIRST], left[FIRST:]):
            if len(floor := np.sort(score[score > 0])[-k:]) == k:
                round = round[bounds[round] >= floor[0] - 1e-9]
            visited = np.zeros(self.blocks, bool)
            visited[round] = True
            use = visited[at]
            postings, of = _ranges(self.pointers[cells[use]], self.pointers[cells[use] + 1])
            places = at[use][of] * BLOCK + self.slots[postings]
            score += np.bincount(places, weights[by[use][of]] * self.weights[postings], len(score))
            if skip >= 0:
                score[skip] = 0
        places = np.flatnonzero(score > 0)
        places = places[np.lexsort((places, -score[places]))[:k]]
        return places, score[places]

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        return float((cosines * self.labels[places]).sum() / cosines.sum()) if len(places) else math.nan

    def score(self, vote: float) -> float:
        return self.empty if math.isnan(vote) else 1 / (1 + math.exp(-(self.slope * vote + self.shift)))


def _learnt(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 != 1


def _terms(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
                counts = Counter(terms_of(text))
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array([toxic] * n, pa.int32()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int32())],
                    names=["doc_id", "toxic", "term", "tf"],
                )

    return docs.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, term binary, tf int")


def fit(docs: DataFrame, labels: DataFrame, rule: TermRule = TermRule()) -> BlockMaxIndex:  # noqa: B008
    """The index over the sampled labelled rows of ``docs``; without usable labels of both kinds
    every score is the share of toxic labels, or 0."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & _learnt(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for label, most in EXAMPLES.items():
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    # at most sum(EXAMPLES) rows of two integers
    chosen = F.broadcast(materialize(chosen, "examples"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    terms = materialize(_terms(rows), "example-terms")
    sizes = {r["toxic"]: r["n"] for r in terms.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    # counts of the terms and then the postings of those that are held: both are bounded by the sample
    used = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("df1")).filter(F.col("df") >= rule.examples)
    used = materialize(used, "example-vocabulary")
    counts = used.toArrow().sort_by("term")
    neutral = _neutral(counts["df"].to_numpy().astype(float), counts["df1"].to_numpy().astype(float), sizes.get(0, 0), sizes.get(1, 0), rule)
    held = counts.filter(pa.array(~neutral))
    postings = terms.join(used.select("term"), "term", "left_semi").toArrow()
    for done in (terms, used):
        drop_table(done)
    return _build(held["term"].combine_chunks(), postings, shares, sizes, prior)


def _neutral(df: np.ndarray, df1: np.ndarray, n0: int, n1: int, rule: TermRule) -> np.ndarray:
    """Terms that say nothing of the label. A term of ``rule.examples`` examples that one label alone
    uses, or at ``rule.neutral`` times the other's rate, is never one of them, however common it is."""
    if not n0 or not n1:
        return np.zeros(len(df), bool)
    n, excess = n0 + n1, df1 - df * n1 / (n0 + n1)
    chi2 = np.divide(excess**2 * float(n) ** 3, df * (n - df) * float(n0 * n1), out=np.zeros(len(df)), where=df < n)
    rate0, rate1 = (df - df1) / n0, df1 / n1
    alike = np.maximum(rate0, rate1) < rule.neutral * np.minimum(rate0, rate1)
    return (df < rule.examples) | ((chi2 < rule.chi2) & alike)


def _build(held: pa.Array, postings: pa.Table, shares, sizes, prior) -> BlockMaxIndex:
    """The index over the terms ``held`` of ``postings(doc_id, toxic, term, tf)``, as arrays throughout."""
    place = pc.index_in(postings["term"], value_set=held)
    keep = pc.is_valid(place)
    t = place.filter(keep).to_numpy().astype(np.int64)
    doc, toxic, tf = (postings[c].filter(keep).to_numpy() for c in ("doc_id", "toxic", "tf"))
    order = np.lexsort((t, doc))
    t, doc, toxic, tf = t[order], doc[order], toxic[order], tf[order]
    terms = len(held)
    idf = np.log(max(sum(sizes.values()), 1) / np.maximum(np.bincount(t, minlength=terms), 1))
    ids, starts = np.unique(doc, return_index=True)
    lengths = np.diff(np.append(starts, len(doc)))
    of = np.repeat(np.arange(len(ids)), lengths)
    w = (1 + np.log(tf.astype(float))) * idf[t]
    norm = np.sqrt(np.bincount(of, w * w, len(ids)))[of]
    w = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)
    # examples with the same heaviest term stand together, so that few blocks have high bounds
    heaviest = np.zeros(len(ids), np.int64)
    by_weight = np.lexsort((t, w, of))
    heaviest[of[by_weight]] = t[by_weight]  # the last of each example stays
    stand = np.lexsort((ids, heaviest, toxic[starts]))
    at = np.empty(len(ids), np.int64)
    at[stand] = np.arange(len(ids))
    at = at[of]
    n = len(ids)
    blocks = max(1, -(-n // BLOCK))
    cell = t * blocks + at // BLOCK
    order = np.lexsort((at, cell))
    cells, first = np.unique(cell[order], return_index=True)
    maxima = np.maximum.reduceat(w[order], first) if len(cells) else np.zeros(0)
    index = BlockMaxIndex(
        {x: k for k, x in enumerate(held.to_pylist())}, idf, np.append(first, len(order)), (at % BLOCK)[order], w[order],
        maxima, toxic[starts][stand].astype(float), ids[stand], blocks, empty=prior,
        firsts=np.searchsorted(cells, np.arange(terms + 1) * blocks), cell_blocks=cells % blocks,
    )
    votes, truth = [], []
    for k in range(n):
        span = slice(starts[k], starts[k] + lengths[k])
        votes.append(index.vote(*index.nearest(t[span], w[span], NEIGHBOURS, skip=int(at[starts[k]]))))
        truth.append(int(toxic[starts[k]]))
    _calibrate(index, np.array(votes), np.array(truth), shares, sizes, prior)
    return index


def _calibrate(index, votes, truth, shares, sizes, prior) -> None:
    """Logistic regression of the label on the left-out vote, examples weighted to the labels' shares."""
    if min(sizes.get(0, 0), sizes.get(1, 0)) == 0 or not len(votes):
        index.slope, index.shift, index.empty = 0.0, math.log((prior + 1e-6) / (1 - prior + 1e-6)), prior
        return
    scale = {c: shares[c] / sizes[c] for c in (0, 1)}
    seen = ~np.isnan(votes)
    blank = {c: (sizes[c] - int(((truth == c) & seen).sum())) * scale[c] for c in (0, 1)}
    index.empty = blank[1] / (blank[0] + blank[1]) if blank[0] + blank[1] else prior
    x, y = np.stack([votes[seen], np.ones(seen.sum())]), truth[seen].astype(float)
    weight, beta = np.where(y == 1, scale[1], scale[0]), np.array([8.0, -4.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(beta @ x)))
        hessian = (x * (weight * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, x @ (weight * (y - p)) - 1e-3 * beta)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    index.slope, index.shift = max(0.0, float(beta[0])), float(beta[1])


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., with score and evidence, a row for each row."""
    return _score(docs, fit(docs, labels))


def _score(docs: DataFrame, index: BlockMaxIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = [f"c{k}" for k in range(len(docs.columns))]
    text_at = docs.columns.index("text")
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        find = index.vocabulary.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                scores, shown = [], []
                for text in piece.column(text_at).to_pylist():
                    counts = Counter(map(find, terms_of(text)))
                    counts.pop(None, None)
                    vote, near = math.nan, []
                    if counts:
                        places, cosines = index.nearest(*index.vector(sorted(counts.items())), NEIGHBOURS)
                        vote = index.vote(places, cosines)
                        near = [{"doc_id": int(index.ids[p]), "toxic": int(index.labels[p]), "cosine": float(c)} for p, c in zip(places[:EVIDENCE], cosines[:EVIDENCE], strict=True)]
                    scores.append(index.score(vote))
                    shown.append(near)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores, pa.float64()), pa.array(shown, evidence)], names=[*names, "score", "evidence"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    return docs.toDF(*names).mapInArrow(run, f"{fields}, score double, evidence array<struct<doc_id:bigint,toxic:int,cosine:double>>")


def cross_validated(docs: DataFrame, labels: DataFrame, rules: list[TermRule], folds: int = FOLDS) -> list[dict]:
    """For each rule the counts of hits, misses and false alarms, precision, recall and F1 at ``CUT``, best F1 first: learnt
    rows alone are dealt to folds by a hash of their ids, and each fold is scored from the examples of the others."""
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(folds))
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & _learnt(F.col("doc_id"))).withColumn("fold", fold)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "fold").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for rule in rules:
        sums = np.zeros(3)
        for k in range(folds):
            index = fit(rows, known.filter(F.col("fold") != k), rule)
            held = known.filter(F.col("fold") == k).select("doc_id", F.col("toxic").alias("truth"))
            scored = _score(rows.join(held, "doc_id"), index).select(F.col("c2").alias("truth"), (F.col("score") >= CUT).alias("hit"))
            counts = [F.count_if(c) for c in (F.col("hit") & (F.col("truth") == 1), ~F.col("hit") & (F.col("truth") == 1), F.col("hit") & (F.col("truth") == 0))]
            sums += np.array(scored.agg(*counts).first(), float)
        hits, missed, false = sums
        precision, recall = hits / max(1, hits + false), hits / max(1, hits + missed)
        found.append({"rule": rule, "hits": hits, "missed": missed, "false": false, "precision": precision, "recall": recall, "f1": 2 * hits / max(1, 2 * hits + missed + false)})
    return sorted(found, key=lambda x: -x["f1"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for each row of ``docs``.

    The score uses the text alone. A null or empty text, or one without a term of the index, gets
    the share of toxic labels among such examples. Evidence lists the nearest examples as (doc_id,
    toxic, cosine), nearest first. Repeated rows are scored alike; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(rows, labels).select(
        F.col("c0").alias("doc_id"),
        (~_learnt(F.col("c0"))).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        "evidence",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``CUT``; a null or empty
    text and repeated rows as in ``toxicity``, and a null id does not matter."""
    kept = _scored(docs, labels).filter(F.col("score") < CUT)
    return kept.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
