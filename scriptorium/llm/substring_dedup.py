"""Removal of repeated passages through sharded FM-indexes.

A passage of ``WINDOW`` words that two documents share has the same smallest k-gram in both, so
runs of windows are dealt to shards by that k-gram. Runs of one content are one entry, which knows
the smallest document that has it and whether others have it too. The entries are the text of their
shard's FM-index and are streamed backwards against it: for the others that have an entry, and, if
a side of its k-gram is found elsewhere, for its smallest document, to report the windows that still
smaller documents hold in other entries. Entries with neither share no window and stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .fm_index import FmIndex, matched_windows
from .hashing import gram_hashes, hashed_texts

WINDOW = 50
GRAM = 8
#: Windows of a run at most; longer runs are cut.
RUN = 64
#: Entries of a shard on average.
SHARD_ENTRIES = 4000
LEAST_SHARDS = 64
#: Most entries of one k-gram in a shard, a bound on its memory; the windows of k-grams with more are
#: matched by 128-bit hashes and pre-aggregated minima, as exact as the rest.
HOT = 4000
_P = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_P_INVERSE = tuple(np.uint64(pow(int(p), -1, 2**64)) for p in _P)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def exact_words(text: str | None) -> list[bytes]:
    """Runs of characters other than the six ASCII white spaces, unchanged."""
    return as_bytes(text).split()


class Rolling:
    """Hashes of word spans in constant time each."""

    def __init__(self, which: int):
        self.p, self.inverse = _P[which], _P_INVERSE[which]
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if len(words) >= len(self.up):
            size = 2 * len(words) + 2
            grow = lambda x: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)]))
            self.up, self.down = grow(self.p), grow(self.inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[: len(words)], dtype=np.uint64)])
        out = (sums[stop] - sums[start]) * self.down[start]
        return (out ^ (out >> np.uint64(31))) * _P[1]


def window_minima(grams: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` consecutive values."""
    out, have = grams, 1
    while 2 * have <= span:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(grams) - span + 1], out[span - have :][: len(grams) - span + 1])


def _sides(hashes: np.ndarray, grams: np.ndarray, least: np.ndarray, a: np.ndarray, b: np.ndarray, window: int, rolling: Rolling):
    """For each run a..b with the smallest k-gram ``least``: a hash of its words; hashes of the words before
    and after the k-gram, and whether the run has them; and whether it has the k-gram twice. A window
    holds at least one side of its k-gram, so runs that share a window share a side. A run with
    the k-gram twice has no sides."""
    reach, n = (window - GRAM + 1) // 2, len(grams)
    # the k-gram's first place in the run and the next one, among all places in the order of k-grams
    order = np.argsort(grams, kind="stable")
    values = grams[order]
    group = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
    own = group[np.searchsorted(values, least)]
    at = np.searchsorted(group * n + order, own * n + a)
    place, after = order[at], np.minimum(at + 1, n - 1)
    twice = (at + 1 < n) & (group[after] == own) & (order[after] <= b + window - GRAM)
    starts, stops, has = [a], [b + window], []
    for start in (place - reach, place + GRAM):
        inside = ~twice & (start >= a) & (start + reach <= b + window)
        starts.append(np.where(inside, start, 0))
        stops.append(np.where(inside, start + reach, 0))
        has.append(inside)
    found = rolling.of(hashes, np.concatenate(starts), np.concatenate(stops)).view(np.int64)
    whole, left, right = np.split(found, 3)
    return whole, np.where(has[0], left, 0), has[0], np.where(has[1], right, 0), has[1], twice


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """m, h, doc_id, key, a, b, left, has_left, right, has_right, twice: runs of windows a..b whose
    smallest k-gram is m, h hashing their words, and the sides of the k-gram."""
    names = ["m", "h", "doc_id", "key", "a", "b", "left", "has_left", "right", "has_right", "twice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(0)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece, out = batch.slice(at, 1024), []
                texts = [as_bytes(t) for t in piece.column("text").to_pylist()]
                for doc, key, hashes in zip(piece.column("doc_id").to_pylist(), piece.column("key").to_pylist(), hashed_texts(texts), strict=True):
                    if len(hashes) < window:
                        continue
                    grams = gram_hashes(hashes, GRAM)
                    least = window_minima(grams, window - GRAM + 1)
                    a = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
                    size = np.diff(np.append(a, len(least)))
                    if size.max() > RUN:
                        parts = -(-size // RUN)
                        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                        end = np.repeat(a + size, parts)
                        a = np.repeat(a, parts) + step * RUN
                        size = np.minimum(RUN, end - a)
                    b = a + size - 1
                    whole, *sides = _sides(hashes, grams, least[a], a, b, window, rolling)
                    out.append((least[a].view(np.int64), whole, np.full(len(a), doc, np.int64), np.full(len(a), key, np.int64), a.astype(np.int32), b.astype(np.int32), *sides))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    return docs.mapInArrow(run, "m long, h long, doc_id long, key long, a int, b int, left long, has_left boolean, right long, has_right boolean, twice boolean")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """The entries' words as hashes, or for entries of hot k-grams a row per window."""
    names = ["m", "h", "doc_id", "more", "searched", "words", "rel", "w0", "w1"]
    kinds = {"words": pa.binary(), "more": pa.bool_(), "searched": pa.bool_()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = (Rolling(0), Rolling(1))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cold, hot = [], []
                rows = batch.slice(at, 256).to_pylist()
                for row, hashes in zip(rows, hashed_texts([as_bytes(r["text"]) for r in rows]), strict=True):
                    for e in row["entries"]:
                        stop = e["b"] + window
                        if not e["hot"]:
                            cold.append((e["m"], e["h"], row["doc_id"], e["more"], e["searched"], hashes[e["a"] : stop].tobytes()))
                            continue
                        first = np.arange(e["a"], e["b"] + 1)
                        w = [r.of(hashes, first, first + window).view(np.int64) for r in rolling]
                        n = len(first)
                        hot.append((np.full(n, e["m"]), np.full(n, e["h"]), np.full(n, row["doc_id"]), first - e["a"], *w))
                if cold:
                    m, h, d, more, searched, words = zip(*cold, strict=True)
                    none = pa.nulls(len(m), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(h), pa.array(d), pa.array(more), pa.array(searched), pa.array(words, pa.binary()), none, none, none], schema=schema)
                if hot:
                    m, h, d, rel, w0, w1 = (pa.array(np.concatenate(x), pa.int64()) for x in zip(*hot, strict=True))
                    yield pa.RecordBatch.from_arrays([m, h, d, pa.nulls(len(m), pa.bool_()), pa.nulls(len(m), pa.bool_()), pa.nulls(len(m), pa.binary()), rel, w0, w1], schema=schema)

    return docs.mapInArrow(run, "m long, h long, doc_id long, more boolean, searched boolean, words binary, rel long, w0 long, w1 long")


def _search_shard(group: pd.DataFrame, window: int) -> pd.DataFrame:
    """Builds a shard's index and streams its entries through it; m, h, doc_id, others, ra, rb: runs of
    windows, counted from the entry's first, that a document smaller than doc_id holds, or with
    ``others`` one smaller than those which have the entry besides doc_id."""
    # rows that repeat id and text have the same entries
    group = group.drop_duplicates(["m", "h"]).sort_values(["doc_id", "m", "h"]).reset_index(drop=True)
    pieces = [np.frombuffer(w, np.uint64) for w in group["words"]]
    lengths = np.array([len(p) for p in pieces])
    _, ids = np.unique(np.concatenate(pieces), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text = np.zeros(int((lengths + 1).sum()) + 1, np.int64)
    places = np.arange(len(ids)) + np.repeat(np.arange(len(pieces)), lengths)
    text[places] = ids + 1
    _, ranks = np.unique(group["doc_id"].to_numpy(), return_inverse=True)
    owners = np.full(len(text), len(group), np.int32)
    owners[places] = np.repeat(ranks, lengths)
    index = FmIndex(text, owners, RUN + window)
    first, more = (np.flatnonzero(group[c].to_numpy(bool)) for c in ("searched", "more"))
    streamed = np.concatenate([first, more])
    below = np.concatenate([ranks[first], ranks[more] + 1]).astype(np.int32)
    found = matched_windows(index, text, starts[streamed], (lengths - window + 1)[streamed], below, window)
    rows = []
    for k, hit in enumerate(found):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        rows += [(k, a, b - 1) for a, b in edge.reshape(-1, 2).tolist()]
    k, ra, rb = np.array(rows, np.int64).reshape(-1, 3).T
    out = group[["m", "h", "doc_id"]].iloc[streamed[k]].reset_index(drop=True)
    return out.assign(others=k >= len(first), ra=ra, rb=rb)


def _that_may_share(entries: DataFrame) -> DataFrame:
    """The entries ``m, h`` of a k-gram with several of which a side is that of another too."""
    grams = entries.groupBy("m").agg(F.count("*").alias("n"), F.min("rep.doc_id").alias("d0"), F.max("top").alias("d1"), F.max("rep.twice").alias("twice"))
    several = entries.join(grams.filter("n > 1 and d0 <> d1").select("m", F.col("twice").alias("any_twice")), "m")
    side = lambda k, name: F.when(F.col(f"rep.has_{name}"), F.struct(F.lit(k).alias("side"), F.col(f"rep.{name}").alias("words")))
    sides = several.filter("not any_twice").select("m", "h", F.explode(F.array(side(0, "left"), side(1, "right"))).alias("s")).filter("s is not null")
    shared = sides.groupBy("m", "s").agg(F.count("*").alias("n")).filter("n > 1")
    return sides.join(shared, ["m", "s"], "left_semi").select("m", "h").union(several.filter("any_twice").select("m", "h")).distinct()


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, spans: the word spans [start, stop) of each document that a window covers whose
    words also start somewhere in a document with a smaller id. Documents without any are left out.

    Words are runs of characters other than ASCII white space, unchanged; a null text has none.
    Rows with a null id neither lose nor take anything. Repeats within one document do not count.
    Rows that repeat an id are one document of several texts, told apart by ``key``, a hash of the text.
    """
    rows = _keyed(docs).filter("doc_id is not null")
    runs = materialize(_runs(rows, window), "runs")
    rep = F.min(F.struct("doc_id", "key", "a", "b", "left", "has_left", "right", "has_right", "twice")).alias("rep")
    entries = materialize(runs.groupBy("m", "h").agg(rep, F.max("doc_id").alias("top")), "entries")
    more = F.col("rep.doc_id") != F.col("top")
    wanted = _that_may_share(entries).withColumn("searched", F.lit(True))
    wanted = entries.join(wanted, ["m", "h"], "left").filter(more | F.col("searched"))
    searched = F.coalesce("searched", F.lit(False)).alias("searched")
    wanted = materialize(wanted.select("m", "h", "rep.doc_id", "rep.key", "rep.a", "rep.b", more.alias("more"), searched), "wanted")
    crowds = wanted.groupBy("m").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("m", F.lit(True).alias("hot"))
    dealt = wanted.join(crowds, "m", "left").select("m", "h", "doc_id", "key", "a", "b", "more", "searched", F.coalesce("hot", F.lit(False)).alias("hot"))
    dealt = dealt.groupBy("doc_id", "key").agg(F.collect_list(F.struct("m", "h", "a", "b", "more", "searched", "hot")).alias("entries"))
    cut = materialize(_cut(rows.join(dealt, ["doc_id", "key"]), window), "cut")
    cold = cut.filter("words is not null").select("m", "h", "doc_id", "more", "searched", "words")
    shards = max(LEAST_SHARDS, cold.count() // SHARD_ENTRIES)
    hits = (
        cold.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(lambda g: _search_shard(g.drop(columns="shard"), window), "m long, h long, doc_id long, others boolean, ra long, rb long")
    )
    hot = cut.filter("rel is not null")
    least = hot.groupBy("w0", "w1").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("top")).filter("least <> top")
    no = F.lit(False).alias("others")
    windows = hot.join(least, ["w0", "w1"]).filter("doc_id > least").select("m", "h", "doc_id", no, F.col("rel").alias("ra"), F.col("rel").alias("rb"))
    whole = wanted.join(crowds, "m").filter("more").select("m", "h", "doc_id", F.lit(True), F.lit(0).cast("long"), (F.col("b") - F.col("a")).cast("long"))
    found = materialize(hits.union(windows).union(whole).withColumnRenamed("doc_id", "of"), "found")
    mine = F.when(F.col("others"), F.col("doc_id") > F.col("of")).otherwise(F.col("doc_id") == F.col("of"))
    parts = runs.join(found, ["m", "h"]).filter(mine).select(
        "doc_id", "key", F.struct((F.col("a") + F.col("ra")).cast("int").alias("start"), (F.col("a") + F.col("rb") + window).cast("int").alias("stop")).alias("span")
    )
    return parts.groupBy("doc_id", "key").agg(F.array_distinct(F.collect_list("span")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of ``docs``; kept words are joined by one
    space. An empty table gives no rows."""
    spans = repeated_spans(docs, window).withColumnsRenamed({"doc_id": "span_id", "key": "span_key"})
    rows = _keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                n, gone, kept = [], [], []
                for text, found in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                    words = exact_words(text)
                    n.append(len(words))
                    if found:
                        keep = np.ones(len(words), bool)
                        for s in found:
                            keep[s["start"] : s["stop"]] = False
                        words = [words[k] for k in np.flatnonzero(keep).tolist()]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    joined = rows.join(spans, (F.col("doc_id") == F.col("span_id")) & (F.col("key") == F.col("span_key")), "left").select("doc_id", "text", "spans")
    done = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string")
    return done.select("doc_id", "n_words", "n_removed", F.decode("kept", "UTF-8").alias("kept_text"), "kept_sha256")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
