"""N-gram Jaccard self-join with rare-first prefix filtering.

Each text becomes the set of its word n-grams (as 64-bit hashes), in an order of the whole corpus
that puts rare n-grams first. Texts of Jaccard similarity t or more must share an n-gram in their
prefixes, so only prefixes are joined. Length and positional filters prune what meets, a suffix
filter on binned counts prunes the rest, and each surviving pair is verified once on whole sets.

Texts with equal sets are one class and are joined once. A list in which many similar texts meet
would give the square of its length in pairs. So pairs are taken in rounds: first each text with a
leader of each of its lists, for as long as that links many; then, in lists where different
components still meet, all remaining pairs across components inside blocks, from which only rows
with candidates and links that span components come out. Pairs within a component cannot change it
and are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_table, materialize, settle, table
from .hashing import counted, distinct, gram_hashes, hashed_texts

N = 5
#: Similarity as a whole percentage, so that the bound is exact in integers.
PERCENT = 80
#: Entries of the table of frequent n-grams; it is broadcast, at 16 bytes an entry.
FREQUENT = 200_000
#: Rows of a list compared in one block; longer lists are cut into pairs of blocks.
BLOCK = 512
#: Rows of blocks for each task that looks for candidates, and candidates of a row verified at once.
TASK_ROWS = 4096
VERIFIED = 64
#: Bins of the suffix filter.
BINS = 64
#: Rounds of leaders at most, and the share of texts that a round must link for another to follow.
LEADER_ROUNDS = 4
LINKING = 0.02


def lowered(text: str | None) -> bytes:
    """Lower-cases A-Z only."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            texts = [lowered(t) for t in piece.column("text").to_pylist()]
            yield piece, [distinct(gram_hashes(w, n)) for w in hashed_texts(texts)]


def overlap_needed(a, b, percent: int):
    """Least intersection of sets of sizes a and b at the bound: 100 i >= p (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    """Two sets at the bound share an element among the first so many of either."""
    return size - -(-percent * size // 100) + 1


def bin_counts(grams: np.ndarray) -> np.ndarray:
    return np.bincount((grams >> np.uint64(20)).astype(np.int64) % BINS, minlength=BINS).astype("<u4")


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """Two kinds of rows from one pass. A row per document: doc_id, n_shingles, the set's binned
    counts and its 128-bit class key, empty where there is no word. And, with n_shingles null, rows
    ``gram, times`` of n-grams that repeat within a task's rows."""
    fields = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bins", pa.binary()), ("gram", pa.int64()), ("times", pa.int64())]
    schema = pa.schema(fields)

    def rows(**columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema
        )

    def run(batches):
        pending, times, held = [], {}, 0

        def count():
            grams, counts = counted(np.concatenate(pending))
            pending.clear()
            again = counts > 1
            for g, c in zip(grams[again].view(np.int64).tolist(), counts[again].tolist(), strict=True):
                times[g] = times.get(g, 0) + c

        for piece, sets in _sets(batches, n):
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in sets]
            bins = [bin_counts(s).tobytes() for s in sets]
            yield rows(doc_id=piece.column("doc_id").to_pylist(), n_shingles=[len(s) for s in sets], key=keys, bins=bins)
            pending.extend(sets)
            held += sum(map(len, sets))
            if held > 4_000_000:
                count()
                held = 0
                if len(times) > 1_000_000:
                    yield rows(gram=list(times), times=list(times.values()))
                    times.clear()
        if pending:
            count()
        if times:
            yield rows(gram=list(times), times=list(times.values()))

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key binary, bins binary, gram long, times long")


def _frequent(described: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, ``most`` at most, sorted, with their counts: those above a count that
    a histogram finds, so that no more than is kept comes to the driver. Which n-grams are among them
    decides only the order in which prefixes are taken, never the result."""
    repeats = materialize(described.filter("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")), "ngram-repeats")
    step = F.floor(F.log2("times") * 8).cast("int")
    least, left = None, most
    for r in sorted(repeats.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    top = repeats.filter(step >= least if least is not None else F.lit(False)).toArrow()
    drop_table(repeats)
    grams = top["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], top["times"].to_numpy()[order]


def _rare_first(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    names, counts = frequent
    if not len(names):
        return grams
    at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
    return grams[np.lexsort((grams, np.where(names[at] == grams, counts[at], 0)))]


def _prefixes(docs: DataFrame, n: int, percent: int, frequent_b) -> DataFrame:
    """gram, id, size, pos: the prefix of each class's set in rare-first order."""

    def run(batches):
        for piece, sets in _sets(batches, n):
            ids = piece.column("doc_id").to_pylist()
            grams, owners, sizes, places = [], [], [], []
            for doc, grams_of in zip(ids, sets, strict=True):
                if size := len(grams_of):
                    k = prefix_length(size, percent)
                    grams.append(_rare_first(grams_of, frequent_b.value)[:k])
                    owners.append(np.full(k, doc, np.int64))
                    sizes.append(np.full(k, size, np.int32))
                    places.append(np.arange(k, dtype=np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ([g.view(np.int64) for g in grams], owners, sizes, places)],
                    names=["gram", "id", "size", "pos"],
                )

    return docs.mapInArrow(run, "gram long, id long, size int, pos int")


def _whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """id, size, grams: the distinct sets of each id, for ids may repeat."""

    def run(batches):
        for piece, sets in _sets(batches, n):
            columns = [piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "grams"])

    return docs.mapInArrow(run, "id long, size int, grams binary").distinct()


def _with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``pairs(u, v)`` with ``column`` of either side as a and b."""
    of = lambda c, name: sets.select(F.col("id").alias(c), F.col(column).alias(name))
    # always merge joins: pairs and sets both grow with the input
    half = pairs.join(of("u", "a").hint("merge"), "u")
    return half.join(of("v", "b").hint("merge"), "v").select("u", "v", "a", "b")


def _verify(pairs: DataFrame, bins: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` at or above the bound: the suffix filter drops most others on their
    binned counts, and what is left is verified once on whole sets, which are made from the texts
    of those pairs alone."""

    def could_link(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), "<u4") for s in (a, b))
                keep.append(int(np.minimum(x, y).sum()) >= overlap_needed(int(x.sum()), int(y.sum()), percent))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def link(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    likely = materialize(_with_both(pairs, bins, "bins").mapInArrow(could_link, "u long, v long"), "ngram-likely")
    ids = likely.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    texts = docs.join(ids.hint("merge"), docs["doc_id"] == ids["id"], "left_semi")
    sets = materialize(_whole_sets(texts, n), "ngram-sets")
    found = materialize(_with_both(likely, sets, "grams").mapInArrow(link, "u long, v long"), "ngram-links")
    for done in (likely, sets):
        drop_table(done)
    return found


def _candidates(group: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of block ``lo`` the rows of block ``hi`` of other components that pass the positional
    and the suffix filter, each pair once; rows are numbered as in ``group``."""
    size, comp, ids, own = (group[c].to_numpy() for c in ("size", "comp", "id", "own"))
    bins = np.stack([np.frombuffer(b, "<u4") for b in group["bins"]]).astype(np.int32)
    lo, hi = int(group["lo"].iat[0]), int(group["hi"].iat[0])
    lists, positions = group["grams"].to_list(), group["places"].to_list()
    row, gram, place = np.repeat(np.arange(len(ids)), [len(g) for g in lists]), np.concatenate(lists), np.concatenate(positions)
    order = np.argsort(gram, kind="stable")
    row, gram, place = row[order], gram[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    end = np.append(begin[1:], len(gram))
    span = dict(zip(gram[begin].tolist(), zip(begin.tolist(), end.tolist(), strict=True), strict=True))
    for i in np.flatnonzero(own == lo).tolist():
        found = []
        for g, at in zip(lists[i], positions[i], strict=True):
            p, q = span[g]
            if q - p > 1:
                j, there = row[p:q], place[p:q]
                # of a linked pair's shared n-grams the first has nothing shared before it
                found.append(j[np.minimum(size[i] - at, size[j] - there) >= overlap_needed(size[i], size[j], percent)])
        others = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        others = others[(comp[others] != comp[i]) & (own[others] == hi) & ((ids[others] > ids[i]) if lo == hi else True)]
        if len(others):
            common = np.minimum(bins[others], bins[i]).sum(axis=1)
            others = others[common >= overlap_needed(size[i], size[others], percent)]
            if len(others):
                yield i, others


def _spanning(group: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Verifies a block's candidates on whole sets; links that join components not yet joined here."""
    ids, size, comp = (group[c].to_numpy() for c in ("id", "size", "comp"))
    sets = [np.frombuffer(s, np.uint64) for s in group["whole"]]
    _, root = np.unique(comp, return_inverse=True)  # the root of each row, kept flat
    out = []
    for i, others in _candidates(group, percent):
        for at in range(0, len(others), VERIFIED):
            some = others[at : at + VERIFIED]
            some = some[root[some] != root[i]]
            if not len(some):
                continue
            both = np.concatenate([sets[j] for j in some.tolist()])
            place = np.minimum(np.searchsorted(sets[i], both), len(sets[i]) - 1)
            starts = np.concatenate([[0], np.cumsum(size[some])[:-1]])
            same = np.add.reduceat((sets[i][place] == both).astype(np.int64), starts)
            for j in some[100 * same >= percent * (size[i] + size[some] - same)].tolist():
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _by_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by (anchor, lo, hi) that have more than one component."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        keys = frame[_BLOCK_KEY].to_numpy()
        last = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0]) if len(keys) else 0
        rest = frame.iloc[last:]
        yield from (g for _, g in frame.iloc[:last].groupby(_BLOCK_KEY, sort=False) if g["comp"].nunique() > 1)
    if rest is not None and len(rest) and rest["comp"].nunique() > 1:
        yield rest


_BLOCK_KEY = ["anchor", "lo", "hi"]
_BLOCK_ROW = "anchor long, lo int, hi int, own int, id long, size int, comp long, grams array<long>, places array<int>, bins binary"


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(max(1, tasks), *_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)


def _across(lists: DataFrame, bins: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links ``(u, v)`` that join all components which pairs of texts of one list link, found in blocks.

    Lists in which the same smallest component meets others hold much the same texts, so they are
    compared together: a text comes once with all its places in them, and its pairs come once
    however many n-grams they share. The texts of such an anchor are cut into blocks of about
    ``BLOCK``, and tasks compare pairs of blocks, twice: first without sets, to keep only the rows
    that have a candidate; then these rows come with their whole sets and are verified. No pair
    leaves its block, only rows and links that span components do, so nothing grows with the
    square of a group.
    """
    met = lists.groupBy("gram").agg(F.min("comp").alias("anchor"), F.max("comp").alias("c1")).filter("anchor <> c1").select("gram", "anchor")
    texts = lists.join(met, "gram").groupBy("anchor", "id", "size").agg(
        F.first("comp").alias("comp"), F.collect_list("gram").alias("grams"), F.collect_list("pos").alias("places")
    )
    texts = materialize(texts, "ngram-anchored")
    blocks = texts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        texts.join(blocks, "anchor")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        .drop("blocks", "other")
    )
    dealt = materialize(dealt.join(bins.hint("merge"), ["id", "size"]).selectExpr(*[c.split()[0] for c in _BLOCK_ROW.split(", ")]), "ngram-dealt")

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _by_block(frames):
            keep = np.zeros(len(group), bool)
            for i, others in _candidates(group, percent):
                keep[i] = True
                keep[others] = True
            if keep.any():
                yield group[keep]

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _by_block(frames):
            if found := _spanning(group, percent):
                yield pd.DataFrame(found, columns=["u", "v"])

    kept = materialize(_dealt(dealt, dealt.count() // TASK_ROWS).mapInPandas(likely, _BLOCK_ROW), "ngram-rest")
    sets = _whole_sets(docs.join(kept.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), n)
    sets = materialize(sets.withColumnRenamed("grams", "whole"), "ngram-sets")
    whole = kept.join(sets.hint("merge"), ["id", "size"])
    found = materialize(_dealt(whole, kept.count() // BLOCK).mapInPandas(link, "u long, v long").distinct(), "ngram-links")
    for done in (texts, dealt, kept, sets):
        drop_table(done)
    return found


def _positions_allow(percent: int):
    """Length and positional filter for a row of a list and its leader ``l``. It is made for the first
    n-gram that a linked pair shares: what is left from there on both sides must reach the bound."""
    need = F.ceil(percent * (F.col("size") + F.col("l.size")) / (100 + percent))
    return F.least(F.col("size") - F.col("pos"), F.col("l.size") - F.col("l.pos")) >= need


def _with_components(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select(
        *rows.columns, F.coalesce("component", "id").alias("comp")
    )


def _joined(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of known ones and more links; a known one stands for its links as a star."""
    known = links if parts is None else links.union(parts.selectExpr("node as u", "component as v"))
    return materialize(components(known), "ngram-components")


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id, component_id, class_key.

    Words are runs of characters other than ASCII white space with A-Z lower-cased; a text's set
    holds its distinct word n-grams, or its whole sequence when it has fewer words. Two texts link
    when 100 x intersection >= percent x union. ``class_id`` is the smallest id with an equal set,
    ``component_id`` the smallest id reachable by links; ``class_key`` is the set's 128-bit key. Texts without words, nulls included, have
    an empty set and link with nothing: both ids are their own. A null doc_id is left in the result
    with null class and component and links with nothing. Rows that repeat an
    id share their component: they link by any of their texts. An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passed = materialize(_describe(rows, n), "ngram-sizes")
    described = passed.filter("n_shingles is not null").select("doc_id", "n_shingles", "key")
    classes = (
        described.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    )
    classes = materialize(classes, "ngram-classes")
    frequent_b = spark.sparkContext.broadcast(_frequent(passed, frequent))
    leaders = classes.select(F.col("class_id").alias("id"))
    prefixes = materialize(_prefixes(rows.filter("doc_id is not null"), n, percent, frequent_b), "ngram-prefixes")
    lists = prefixes.groupBy("gram").agg(F.min("id").alias("i0"), F.max("id").alias("i1")).filter("i0 <> i1")
    met = prefixes.join(lists.select("gram"), "gram", "left_semi").join(leaders, "id", "left_semi")
    met = materialize(met, "ngram-lists")
    # sets at the bound lie in one size band or in neighbouring ones, so lists are cut by band too
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent)).cast("long")
    banded = met.select("id", "size", "pos", F.explode(F.array(F.xxhash64("gram", band), F.xxhash64("gram", band + 1))).alias("gram"))
    shared = banded.groupBy("gram").agg(F.min("id").alias("i0"), F.max("id").alias("i1")).filter("i0 <> i1")
    met = materialize(banded.join(shared.select("gram"), "gram", "left_semi"), "ngram-bands")
    met_ids = materialize(met.select("id").distinct(), "ngram-ids")
    drop_table(prefixes)
    bins = passed.filter("n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("size"), "bins")
    bins = materialize(bins.join(met_ids.hint("merge"), "id", "left_semi").distinct(), "ngram-bins")

    parts, texts = None, met_ids.count()
    for k in range(LEADER_ROUNDS):
        here = _with_components(met, parts)
        leader = F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "size", "pos", "comp"))
        led = here.groupBy("gram").agg(leader.alias("l"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
        pairs = (
            here.join(led, "gram")
            .filter(F.col("comp") != F.col("l.comp"))
            .filter(_positions_allow(percent))
            .select(F.least("id", "l.id").alias("u"), F.greatest("id", "l.id").alias("v"))
            .distinct()
        )
        found = _verify(pairs, bins, rows, n, percent)
        parts = _joined(parts, found)
        if found.count() <= LINKING * texts:
            break
    parts = _joined(parts, _across(_with_components(met, parts), bins, rows, n, percent))
    parts = classes.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "key", "class_id", F.coalesce("component", "class_id").alias("component")
    )
    found = described.join(parts, "key", "left")
    lone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    own = lambda c: F.when(lone, F.col("doc_id")).otherwise(F.col(c))
    return found.select("doc_id", "n_shingles", own("class_id").alias("class_id"), own("component").alias("component_id"), F.col("key").alias("class_key"))


def drop_near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, all columns as they are.

    Texts without words and rows without an id stay. So do rows whose id repeats under different
    sets, as it does not tell which of them is linked; other rows still go for them. Rows that
    repeat id and set go or stay together. An empty table stays empty.
    """

    def dropped() -> DataFrame:
        found = near_duplicates(docs, n, percent).groupBy("doc_id").agg(
            F.min("class_key").alias("k0"), F.max("class_key").alias("k1"), F.min("component_id").alias("component_id")
        )
        return found.filter("k0 = k1 and component_id <> doc_id").select("doc_id")

    gone = settle(dropped, "ngram-dropped").toDF("gone").hint("merge")
    key = F.col("c0").cast("long") == F.col("gone")
    names = ["doc_id", *[c for c in docs.columns if c != "doc_id"]]
    rows = docs.select(*names).toDF(*[f"c{k}" for k in range(len(names))]).join(gone, key, "left_anti")
    return rows.toDF(*names).select(*docs.columns)


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90).drop("class_key")
