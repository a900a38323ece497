"""Concatenate-and-cut packing of documents into fixed windows of token ids.

Pass one encodes each partition and keeps, with every document, the number of ids before it in its
partition; partition totals are prefix-summed; pass two adds them and cuts the global stream at
multiples of the window, leaving one record for each piece of a document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k"
CHUNK = 512


def load_encoder(ranks_path: str, pattern: str, end_of_text: int, tokenizer_path: str | None = None):
    """The byte-level BPE as a function from text to a numpy array of uint32 ids.

    The rank file holds the same vocabulary and merges as the tokenizers file of that name and
    gives the same ids several times faster (a test holds both against each other). The special
    token's string in a text becomes its id, as the tokenizers file does. Texts that the fast coder
    refuses, such as those with some hundred thousand white spaces in a row, go to the tokenizers file.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {"<|endoftext|>": end_of_text}
    coder = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    slow = []

    def encode(text: str) -> np.ndarray:
        try:
            return coder.encode_to_numpy(text, allowed_special="all")
        except Exception:
            if tokenizer_path is None:
                raise
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(tokenizer_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def default_encoder():
    import public_tokenizers as tokenizers_of

    return load_encoder(tokenizers_of.path(f"{VOCABULARY}.tiktoken"), tokenizers_of.PATTERN, 50256, tokenizers_of.path(f"{VOCABULARY}.json"))


_ENCODED = pa.schema(
    [("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
)


def _encode(batches: Iterator[pa.RecordBatch], make_encoder, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, part, before = make_encoder(), TaskContext.get().partitionId(), 0
    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            ids = [encode(t or "").astype("<u4").tobytes() + end for t in piece.column(1).to_pylist()]
            counts = [len(x) // 4 for x in ids]
            starts = before + np.concatenate([[0], np.cumsum(counts)])
            before = int(starts[-1])
            columns = [[part] * len(ids), starts[:-1], piece.column(0), counts, ids]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ENCODED, strict=True)],
                schema=_ENCODED,
            )


def encode_documents(docs: DataFrame, make_encoder=default_encoder, end_id: int = END_ID) -> DataFrame:
    """Pass one: part, before (ids before the document in its partition), doc_id, n, ids (binary,
    little-endian unsigned 32-bit), written to the scratch folder so that text is encoded once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = rows.mapInArrow(
        lambda batches: _encode(batches, make_encoder, end_id),
        "part int, before long, doc_id long, n long, ids binary",
    )
    return materialize(encoded, "ids")


def pack(docs: DataFrame, window: int = WINDOW, make_encoder=default_encoder, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    Each document is its ids followed by ``end_id``; a null or empty text is ``end_id`` alone; a
    null or repeated doc_id is packed like any other row. All sequences but the last are full, so
    that padding is below one window for the whole table. An empty table gives no pieces.
    """
    encoded = encode_documents(docs, make_encoder, end_id)
    # one row per input partition
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    running = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialize(totals.select("part", F.coalesce(running, F.lit(0)).alias("base")), "bases")
    first = F.col("base") + F.col("before")
    placed = encoded.join(bases, "part").select(
        "doc_id", "ids", F.col("n").alias("doc_tokens"), first.alias("first"),
        F.explode(F.sequence(F.expr(f"(base + before) div {window}"), F.expr(f"(base + before + n - 1) div {window}"))).alias("sequence_id"),
    )
    start = F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * window - F.col("first"))
    stop = F.least(F.col("doc_tokens"), (F.col("sequence_id") + 1) * window - F.col("first"))
    cut = placed.withColumns({"start": start, "length": stop - start})
    return cut.select(
        "doc_id",
        "start",
        "length",
        F.expr("substring(ids, int(4 * start + 1), int(4 * length))").alias("ids"),
        "doc_tokens",
        "sequence_id",
        (F.col("first") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
